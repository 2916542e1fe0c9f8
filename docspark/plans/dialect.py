"""One declarative plan, two spellings: Spark SQL for the engine, and DuckDB's SQL for the check of its rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.ranking import places
from docspark.operators.tables import written

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "region", "nation", "customer", "supplier", "part", "orders", "lineitem")


class SparkSql:
    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def like(self, col: str, pattern: str) -> str:
        return f"({col} RLIKE {self.text(pattern)})"

    def sub(self, col: str, pattern: str, to: str) -> str:
        return f"regexp_replace({col}, {self.text(pattern)}, {self.text(to)})"

    def group(self, n: int) -> str:
        return f"${n}"

    def extract(self, col: str, pattern: str, n: int = 0) -> str:
        return f"regexp_extract({col}, {self.text(pattern)}, {n})"

    def extract_all(self, col: str, pattern: str, n: int = 0) -> str:
        return f"regexp_extract_all({col}, {self.text(pattern)}, {n})"

    def split(self, col: str, pattern: str) -> str:
        return f"split({col}, {self.text(pattern)}, -1)"

    def each(self, array: str, item: str, pos: str) -> str:
        """A lateral join to an array's items, numbered from 0."""
        return f"LATERAL VIEW posexplode({array}) _{item} AS {pos}, {item}"

    def map(self, array: str, x: str, expr: str) -> str:
        return f"transform({array}, {x} -> {expr})"

    def keep(self, array: str, x: str, expr: str) -> str:
        return f"filter({array}, {x} -> {expr})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, {self.text(sep)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def strings(self, expr: str, sep: str, order: str) -> str:
        return f"listagg({expr}, {self.text(sep)}) WITHIN GROUP (ORDER BY {order})"

    def has(self, array: str, item: str) -> str:
        return f"array_contains({array}, {item})"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def sorted(self, array: str) -> str:
        return f"array_sort({array})"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def minus(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def contains(self, a: str, b: str) -> str:
        return f"contains({a}, {b})"

    def cued(self, cue: str, test: str) -> str:
        """``test``, which the engine tries only where a cheaper ``cue`` holds; the cue must hold wherever the test does."""
        return f"({cue} AND {test})"

    def int(self, expr: str) -> str:
        return f"CAST({expr} AS INT)"

    def long(self, expr: str) -> str:
        return f"CAST({expr} AS BIGINT)"

    def at(self, array: str, i: str) -> str:
        """The item at ``i``, from 0; null beyond."""
        return f"get({array}, {i})"

    def seconds(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000"

    def last_seen(self, expr: str, over: str) -> str:
        """The last value that isn't null in a frame."""
        return f"last_value({expr}) IGNORE NULLS OVER ({over})"

    def string(self, expr: str) -> str:
        return f"CAST({expr} AS STRING)"

    def stored(self, name: str, sql: Callable[[SparkSql], str]) -> str:
        """A relation that several places of a plan read; the engine writes it once (see ``table``)."""
        return f"SELECT * FROM {name}"


class DuckSql(SparkSql):
    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def like(self, col: str, pattern: str) -> str:
        return f"regexp_matches({col}, {self.text(pattern)})"

    def sub(self, col: str, pattern: str, to: str) -> str:
        return f"regexp_replace({col}, {self.text(pattern)}, {self.text(to)}, 'g')"

    def group(self, n: int) -> str:
        return f"\\{n}"

    def split(self, col: str, pattern: str) -> str:
        return f"string_split_regex({col}, {self.text(pattern)})"

    def each(self, array: str, item: str, pos: str) -> str:
        return f", LATERAL (SELECT unnest({array}) AS {item}, unnest(range(0, len({array}))) AS {pos}) _{item}"

    def map(self, array: str, x: str, expr: str) -> str:
        return f"list_transform({array}, lambda {x}: {expr})"

    def keep(self, array: str, x: str, expr: str) -> str:
        return f"list_filter({array}, lambda {x}: {expr})"

    def size(self, array: str) -> str:
        return f"len({array})"

    def join(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, {self.text(sep)})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def strings(self, expr: str, sep: str, order: str) -> str:
        return f"string_agg({expr}, {self.text(sep)} ORDER BY {order})"

    def has(self, array: str, item: str) -> str:
        return f"list_contains({array}, {item})"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def sorted(self, array: str) -> str:
        return f"list_sort({array})"

    def both(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def minus(self, a: str, b: str) -> str:
        return f"list_filter({a}, lambda _m: NOT list_contains({b}, _m))"

    def cued(self, cue: str, test: str) -> str:
        return test

    def at(self, array: str, i: str) -> str:
        return f"({array})[{i} + 1]"

    def seconds(self, ts: str) -> str:
        return f"epoch_us({ts}) / 1000000"

    def last_seen(self, expr: str, over: str) -> str:
        return f"last_value({expr} IGNORE NULLS) OVER ({over})"

    def string(self, expr: str) -> str:
        return f"CAST({expr} AS VARCHAR)"

    def stored(self, name: str, sql: Callable[[SparkSql], str]) -> str:
        return sql(self)


SPARK, DUCK = SparkSql(), DuckSql()
PLANS: dict[str, Callable[[SparkSql], str]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


STORED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(name: str):
    """Registers a function ``(spark, sf_dir) -> DataFrame`` as a relation that plans read by name; it is written before."""

    def of(fn: Callable[[SparkSession, str], DataFrame]):
        STORED[name] = fn
        return fn

    return of


_made: dict[str, None] | None = None


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """The tables that ``sql`` names, as views; stored relations are made and written, once for all that a query reads."""
    global _made
    names, outermost = set(re.findall(r"(?i)\b(?:from|join)\s+(\w+)", sql)), _made is None
    for name in names.intersection(TABLES):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    if outermost:
        _made = {}
    try:
        for name in sorted(names.intersection(STORED)):
            if name not in _made:
                df = written(STORED[name](spark, sf_dir), name)
                df.createOrReplaceTempView(name)
                _made[name] = None
    finally:
        if outermost:
            _made = None


def plan(fn: Callable[[SparkSql], str]):
    """Registers a function of a dialect that gives a plan's SQL, under the function's name."""
    name = fn.__name__
    PLANS[name] = fn

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = fn(SPARK)
        views(spark, sf_dir, sql)
        return spark.sql(sql)

    QUERIES[name], ORACLES[name] = run, fn(DUCK)
    return fn


def frame(oracle: Callable[[SparkSql], str] | None = None):
    """Registers a function ``(spark, sf_dir) -> DataFrame``, with SQL for the check if there is any."""

    def of(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle(DUCK)
        return fn

    return of


def placed(column: str, *order: str, drop: str | None = None):
    """Registers a function of a dialect that gives SQL, whose rows get their place in ``order`` (columns, with `` DESC`` or not).

    The engine deals rows out by ranges of the order, so no task has them all; the check's SQL numbers them by a window.
    """

    def of(fn: Callable[[SparkSql], str]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            sql = fn(SPARK)
            views(spark, sf_dir, sql)
            by = [F.col(c.split()[0]).desc() if c.endswith(" DESC") else F.col(c) for c in order]
            out = places(spark.sql(sql), column, *by)
            return out.drop(drop) if drop else out

        names = f"* EXCLUDE ({drop})" if drop else "*"
        QUERIES[fn.__name__], ORACLES[fn.__name__] = run, f"SELECT {names}, CAST(row_number() OVER (ORDER BY {', '.join(order)}) AS INTEGER) AS {column} FROM ({fn(DUCK)}) x"
        return fn

    return of


def rows(*values: tuple, names: str) -> str:
    """An inline table."""

    def one(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in values)
    return f"(SELECT * FROM (VALUES {body}) AS _v({names}))"
