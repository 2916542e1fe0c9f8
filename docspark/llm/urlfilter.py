"""URL filter: rules first, then gradient-boosted trees over lexical features of the URL.

A rule names a host and the beginning of a path, and fits that host and all its subdomains; the longest rule that fits decides.
URLs that no rule fits are judged by boosted trees, which learn from labelled URLs. Their features are lengths, depth, digit
ratio, entropy, numbers of labels, hyphens and parameters, and statistics of affixes: for the host's last label, its last two
labels, the path's first segment and its extension, in how many rows it comes and the smoothed share of blocked ones. The
shares are learnt from one half of the labelled URLs, the trees from a sample of the other half, so a share tells nothing about
the label of the row that it is a feature of. Which half a URL is in is told by its hash, so equal URLs are in one.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import new_path, written

#: The query's rules: a fixed value.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Labelled URLs that trees are learnt from, at most but for chance; trees, their depth and what each adds.
ROWS, TREES, DEPTH, STEP = 20_000, 20, 4, 0.2
#: Weight of the mean share in that of an affix; so many rules are part of the plan, more are joined.
PRIOR, INLINE = 20.0, 200
#: Tables of affixes are broadcast up to so many bytes, joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20
AFFIXES = ("last", "domain", "segment", "extension")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    """What follows the first ``://``; of a null url, or one without, null."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(of: Column) -> Column:
    """The host and all its parents: ``a.b.c``, ``b.c``, ``c``."""
    labels = F.split(of, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def ruled(urls: DataFrame, rules: DataFrame, inline: int = INLINE) -> DataFrame:
    """``urls(host, path)`` with ``rule`` and ``ruled``, its verdict: those of the longest of ``rules(rule, verdict)`` that fits, else null.

    A rule is a host, and a path that begins with ``/``; it fits its host and subdomains, if the path begins with its own. Of
    rules of one length the largest in code-point order is taken, of one rule's verdicts the largest (block before allow).
    Rules that are null or have no ``/`` fit nothing; rules without a verdict are left out.
    """
    cut = rules.where("instr(rule, '/') > 0 and verdict is not null").select("rule", F.col("verdict").alias("ruled")).distinct()
    some = cut.limit(inline + 1).collect()
    if len(some) <= inline:
        fit = F.lit(None).cast("struct<size: int, rule: string, ruled: string>")
        for rule, verdict in sorted(some, key=lambda r: (len(r[0]), r[0], r[1])):
            at, begin = rule[: rule.index("/")], rule[rule.index("/") :]
            hit = ((F.col("host") == at) | F.col("host").endswith(f".{at}")) & F.col("path").startswith(begin)
            fit = F.when(hit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("ruled"))).otherwise(fit)
        return urls.withColumn("_fit", fit).select(*urls.columns, "_fit.rule", "_fit.ruled")
    parts = cut.select(F.substring_index("rule", "/", 1).alias("_of"), F.expr("substring(rule, instr(rule, '/'))").alias("_begin"), "rule", "ruled")
    places = urls.select("host", "path").distinct()
    hits = places.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("_of")).join(parts, "_of").where(F.col("path").startswith(F.col("_begin")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "ruled")).alias("_fit"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "_fit.rule", "_fit.ruled")


def _lexical(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df(url, host, path)`` with the columns of lexical features, which are named; a null url counts as an empty one."""
    url, of, at = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda x, c: (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("double")
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    letters = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    made = {
        "f_length": F.length(url).cast("double"),
        "f_host": F.length(of).cast("double"),
        "f_path": F.length(at).cast("double"),
        "f_depth": count(at, "/"),
        "f_labels": count(of, "."),
        "f_hyphens": count(url, "-"),
        "f_parameters": F.when(F.instr(url, "?") > 0, count(url, "&") + count(url, ";") + 1).otherwise(0.0),
        "f_fragment": (F.instr(url, "#") > 0).cast("double"),
        "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
        "f_host_digits": F.length(F.regexp_replace(of, "[^0-9]", "")) / F.greatest(F.length(of), F.lit(1)),
        "f_entropy": F.aggregate(letters, F.lit(0.0), lambda a, b: a + b),
    }
    return df.withColumns(made), list(made)


def _affixes(df: DataFrame) -> DataFrame:
    last = F.substring_index("host", ".", -1)
    segment = F.regexp_extract("path", "^/([^/]*)/", 1)
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)
    return df.withColumns({"last": last, "domain": F.substring_index("host", ".", -2), "segment": segment, "extension": extension})


def _statistics(of: DataFrame) -> dict[str, DataFrame]:
    """For each affix a table of two features, from the rows ``of(…, label)``: label is 1 for block, 0 for allow, null where only the row counts."""
    mean = of.agg(F.avg("label")).first()[0]
    prior, out = PRIOR * (mean if mean is not None else 0.5), {}
    for c in AFFIXES:
        stats = of.groupBy(c).agg((F.count("*") - F.count("label")).alias("_rows"), F.count("label").alias("_known"), F.sum("label").alias("_blocked"))
        stats = written(stats.select(c, F.log1p("_rows").alias(f"f_{c}_rows"), ((F.coalesce("_blocked", F.lit(0.0)) + prior) / (F.col("_known") + PRIOR)).alias(f"f_{c}_share")), "affixes")
        small = (stats.agg(F.sum(F.octet_length(c) + 32)).first()[0] or 0) <= BROADCAST_BYTES
        out[c] = F.broadcast(stats) if small else stats
    return out


def _features(df: DataFrame, stats: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """``df(url, host, path)`` with all features, and their names."""
    df, names = _lexical(_affixes(df))
    for c, table in stats.items():
        df = df.join(table, c, "left")
        names += [f"f_{c}_rows", f"f_{c}_share"]
    return df.fillna(0.0, names), names


def judged(urls: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """``urls(url)`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score``, one row for each; other columns stay if their names differ.

    ``host`` is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in small letters; ``path`` goes on up to ``?``,
    ``#`` or the end; both are empty where url is null or has no ``://``. ``verdict`` is that of the longest rule that fits (see
    ``ruled``), else ``block`` if ``score``, the trees' probability of block, is above 0.5, and ``allow`` otherwise; ``score`` is null where
    a rule decides. ``labelled(url, label)`` are what the trees learn from (label 1: block; 0: allow; null: left out), by default
    the urls that rules decide; about ``rows`` of them at most. If they are all of one label, all get it; if there are none, allow. Repeated
    rows are judged alike; empty tables give no rows; URLs of any length are read whole.
    """
    clash = {"host", "path", "rule", "ruled", "verdict", "score", "label"} & set(urls.columns)
    own = urls.drop(*clash).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    keep = own.columns
    own = ruled(own, rules)
    if labelled is None:
        known = own.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        known = labelled.where("label is not null").select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    half = F.xxhash64(F.lit("half"), "url")
    teach = known.where(F.pmod(half, F.lit(2)) == 0)
    learn = known.where(F.pmod(half, F.lit(2)) == 1)
    total, kinds = learn.agg(F.count("*"), F.collect_set("label")).first()
    if len(kinds) < 2:
        sure = sorted(kinds or [r[0] for r in known.select("label").distinct().collect()])
        score = F.lit(sure[0] if len(sure) == 1 else 0.0)
        out = own.withColumn("score", F.when(F.col("ruled").isNull(), score))
    else:
        seen = _affixes(own.select("host", "path", F.lit(None).cast("double").alias("label"))).select(*AFFIXES, "label")
        of = seen.unionByName(_affixes(teach).select(*AFFIXES, "label"))
        place = F.pmod(F.xxhash64(F.lit("sample"), "url"), F.lit(1 << 30))
        sample = learn.where(place < int(min(1.0, rows / total) * (1 << 30)))
        stats = _statistics(of)
        sample, names = _features(sample, stats)
        file = new_path(urls.sparkSession, "sample")
        # one file of numbers in one order, so reruns learn the same trees
        sample.select("label", *names).coalesce(1).sortWithinPartitions("label", *names).write.parquet(file)
        ready = VectorAssembler(inputCols=names, outputCol="_features")
        model = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_said", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1).setRawPredictionCol("_raw").setProbabilityCol("_chance")
        trees = model.fit(ready.transform(urls.sparkSession.read.parquet(file).coalesce(1)))
        full = trees.transform(ready.transform(_features(own, stats)[0]))
        out = full.withColumn("score", F.when(F.col("ruled").isNull(), vector_to_array("_chance")[1]))
    method = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return out.select(*keep, "rule", F.coalesce("ruled", method).alias("verdict"), "score")
