"""Licence scans: lines, whole texts and windows of words against licence templates, by the Dice coefficient over word bigrams.

Text is normalised: lower case, runs of letters and digits are words. A unit (a line, or the whole text of a document of more than one line)
has a set of word bigrams; its coefficient with a template is twice the shared bigrams over both sets' sizes. For a
coefficient of t or more, a unit of n bigrams fits only templates of n * t / (2 - t) to n * (2 - t) / t bigrams, so other
templates are left out before any bigrams are compared; units too short for every template are dropped first.

A notice that is wrapped over lines, or shares its line with other words, is found by windows: runs of a text's words, over
line ends, that begin and end with a bigram of the template (other ends only lower the coefficient). A template of m bigrams
shares m * t / (2 - t) or more with a window, so only starts with as many hits ahead, and all their ends, are compared. Of
windows of one template that overlap the best stays. A window inside a matched line, a matched whole text or a
longer window is no notice of its own.

Before any of it, texts are left out that hold none of a few words: a template may miss so many bigrams at most, so of any
words that more of its bigrams hold, a match has one at least (``telling``). Long words are taken first, which are rare.

Templates are a constant table. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import once

THRESHOLD = 0.8
# Short notices and the notice texts that the licences themselves ask to be used.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)


def bigrams_of(text: str) -> list[str]:
    """A template's distinct word bigrams; the templates are plain ASCII."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


#: Words that most texts have; they tell least.
FREQUENT = set("the of and to in a is that it for on was be with by as at are this from or an any all under not can you may if use more other which have has be been which their its".split())


def telling(grams: list[str], need: int) -> list[str]:
    """Words of which any text has one that shares ``need`` of the bigrams: all others' bigrams are too few."""
    out: list[str] = []
    for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in FREQUENT, -len(w), w)):
        if sum(not set(out).isdisjoint(g.split()) for g in grams) > len(grams) - need:
            break
        out.append(word)
    return out


def _words(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(w: F.Column) -> F.Column:
    return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(F.array().cast("array<string>"))


def _dice(own: F.Column, t: F.Column) -> F.Column:
    return 2 * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + t["n"])


def _windows(t: F.Column, threshold: float) -> F.Column:
    """Windows ``(dice, length, s, e)`` of a template, in bigrams from 1; signs of the first two turned, so the best is the smallest.

    Reads the columns ``grams`` (a text's bigrams in order) and ``at`` (places of those that any template has).
    """

    def of(h: F.Column) -> F.Column:
        enough = F.size(h) >= t["need"]
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - t["need"] + 1)), lambda k: enough & (F.get(h, k + t["need"] - 2) - F.get(h, k - 1) < t["longest"]))

        def ends(k: F.Column) -> F.Column:
            s = F.get(h, k - 1)

            def window(e: F.Column) -> F.Column:
                own = F.array_distinct(F.slice("grams", s, e - s + 1))
                return F.struct((-_dice(own, t)).alias("dice"), (s - e).alias("length"), s.alias("s"), e.alias("e"))

            return F.transform(F.filter(F.slice(h, k + t["need"] - 1, F.size(h)), lambda e: e - s < t["longest"]), window)

        return F.filter(F.flatten(F.transform(starts, ends)), lambda x: x["dice"] <= -threshold)

    hits = F.filter("at", lambda p: F.array_contains(t["grams"], F.get("grams", p - 1)))
    # one-item arrays, so that hits are worked out once
    found = F.array_sort(F.flatten(F.transform(F.array(hits), of)))
    none = F.array().cast("array<struct<dice:double,length:int,s:int,e:int>>")
    return F.aggregate(found, none, lambda kept, x: F.when(F.exists(kept, lambda y: (y["s"] <= x["e"] + 1) & (x["s"] <= y["e"] + 1)), kept).otherwise(F.concat(kept, F.array(x))))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(doc_id, unit, licence, template, dice)``: each unit or window of ``docs(doc_id, text)`` and template at ``threshold`` or more.

    ``unit`` is the line's number from 1, or 0 for the whole text of a document of several lines; for a window, the
    number of the line where it begins. ``template`` is the
    template's number. Null and empty texts, and lines of fewer than two words, match nothing. Repeated rows give repeated
    rows, repeated lines are units of their own. Without templates there are no rows. Texts of any length are
    compared whole; other columns are left out.
    """
    made = [(i, name, grams) for i, (name, text) in enumerate(templates) if (grams := bigrams_of(text))]
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    if not made:
        return docs.select("doc_id", F.lit(0).alias("unit"), F.lit("").alias("licence"), F.lit(0).alias("template"), F.lit(0.0).alias("dice")).where("false")
    table = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("licence"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n"), F.lit(math.ceil(len(grams) * low)).alias("need"), F.lit(math.floor(len(grams) * high)).alias("longest")) for i, name, grams in made])
    some = sorted({w for _, _, grams in made for w in telling(grams, math.ceil(len(grams) * low))}, key=lambda w: (-len(w), w))
    docs = once(docs.select("doc_id", "text"), "low", F.lower("text")).where(reduce(or_, [F.contains(F.col("low"), F.lit(w)) if len(w) > 3 else F.col("low").rlike(rf"(^|[^\p{{L}}\p{{N}}]){w}([^\p{{L}}\p{{N}}]|$)") for w in some])).select("doc_id", "text")
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    unit = lambda i, line, whole: F.struct(i.alias("unit"), line.alias("line"), whole.alias("whole"))
    several = F.size(parts) > 1
    whole = F.when(several, F.array(unit(F.lit(0), F.col("text"), F.lit(True)))).otherwise(F.array().cast("array<struct<unit:int,line:string,whole:boolean>>"))
    units = F.concat(whole, F.transform(parts, lambda x, i: unit(i + 1, x, ~several)))
    each = docs.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*")
    each = once(each, "w", _words(F.col("line")))
    smallest, largest = min(len(g) for *_, g in made), max(len(g) for *_, g in made)
    # n - 1 bigrams at most, repeats included
    each = each.where(F.size("w") - 1 >= F.lit(smallest * low)).where("size(w) > 1")
    each = once(each.select("doc_id", "unit", F.when(F.col("whole"), F.col("line")).alias("text"), "whole", "w"), "grams", _bigrams(F.col("w"))).drop("w")
    each = once(each, "own", F.array_distinct("grams"))
    every = sorted({g for *_, grams in made for g in grams})
    at = F.when(F.col("whole"), F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.get("grams", i - 1).isin(every))).otherwise(F.array().cast("array<int>"))
    least = min(math.ceil(len(g) * low) for *_, g in made)
    each = once(each, "at", at).where((F.size("own") <= F.lit(largest * high)) | (F.size("at") >= least))
    fits = F.filter(table, lambda t: (t["n"] >= F.size("own") * low) & (t["n"] <= F.size("own") * high))
    match = lambda t, dice, s, e: F.struct(t["licence"].alias("licence"), t["template"].alias("template"), dice.alias("dice"), s.alias("s"), e.alias("e"))
    as_unit = F.filter(F.transform(fits, lambda t: match(t, _dice(F.col("own"), t), F.lit(0), F.lit(0))), lambda m: m["dice"] >= threshold)
    each = once(each, "as_unit", as_unit).where((F.size("as_unit") > 0) | (F.size("at") >= least))
    windows = F.flatten(F.transform(table, lambda t: F.transform(_windows(t, threshold), lambda x: match(t, -x["dice"], x["s"], x["e"]))))
    each = once(each, "windows", F.when((F.size("as_unit") == 0) & (F.size("at") >= least), windows).otherwise(F.filter("as_unit", lambda _: F.lit(False))))
    inner = lambda x, y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])
    alone = F.filter("windows", lambda x: ~F.exists("windows", lambda y: inner(x, y)))
    each = each.select("doc_id", "unit", "text", F.explode(F.concat("as_unit", alone)).alias("m"))
    # the lines of a window: line i ends after the i-th of ``ends`` words
    parts = F.split("text", "\n")
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(_words(x)))))
    each = once(each, "ends", F.when(F.col("m.s") > 0, ends).otherwise(F.array().cast("array<int>")))
    line = lambda word: F.size(F.filter("ends", lambda e: e < word))
    each = once(once(each, "first", line(F.col("m.s"))), "last", line(F.col("m.e") + 1))
    around = F.when((F.col("first") > 0) & (F.col("first") == F.col("last")), F.array_distinct(_bigrams(_words(F.get(parts, F.col("first") - 1))))).otherwise(F.array().cast("array<string>"))
    each = once(each, "around", around)
    each = each.where(~F.exists(table, lambda t: _dice(F.col("around"), t) >= threshold))
    return each.select("doc_id", F.when(F.col("m.s") > 0, F.col("first")).otherwise(F.col("unit")).alias("unit"), "m.licence", "m.template", "m.dice")


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {q(name)}, [{', '.join(map(q, bigrams_of(text)))}])" for i, (name, text) in enumerate(templates))
    return rf"""
WITH t(template, licence, grams) AS (VALUES {rows}),
p AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS unit, unnest(parts) AS line FROM p UNION ALL SELECT doc_id, 0, text FROM p WHERE len(parts) > 1),
w AS (SELECT doc_id, unit, list_filter(string_split_regex(lower(line), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, unit, licence, template, 2 * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM g, t)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, licence, template, CAST(dice AS DOUBLE) AS dice FROM d WHERE dice >= {threshold}
"""
