"""Relational building blocks (projections, predicates, joins, subqueries,
aggregation, ordering, set operations) as plain DataFrame -> DataFrame
functions.  Everything is expressed with built-in Column expressions so
Catalyst can push filters into scans, prune columns and pick join strategies
(AQE converts a join to broadcast only after measuring the build side).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- type buckets

NUMBER, TEXT, TIME = "number", "text", "time"


def type_bucket(dt: T.DataType) -> str | None:
    """Total mapping of Spark types onto the three attribute kinds used by
    query shapes.  Nested types are excluded (None)."""
    if isinstance(dt, T.NumericType):
        return NUMBER
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TIME
    if isinstance(dt, (T.StringType, T.BooleanType, T.BinaryType)):
        return TEXT
    return None


def attributes_by_type(df: DataFrame, qualifier: str | None = None) -> dict[str, list[str]]:
    """``{"number": [...], "text": [...], "time": [...]}`` for a scan; with a
    qualifier the names come back as ``alias.column``."""
    out: dict[str, list[str]] = {NUMBER: [], TEXT: [], TIME: []}
    for f in df.schema.fields:
        b = type_bucket(f.dataType)
        if b:
            out[b].append(f"{qualifier}.{f.name}" if qualifier else f.name)
    return out


def typed_projection(df: DataFrame, kind: str, n: int, exclude_ids: bool = False) -> DataFrame:
    """Pick the first ``n`` columns of one kind (P-2)."""
    cols = attributes_by_type(df)[kind]
    if exclude_ids:
        cols = [c for c in cols if not c.endswith("key") and not c.endswith("_id")]
    return df.select(*cols[:n])


# ----------------------------------------------------------------- predicates

COMPARISON_OPS = ("=", "!=", "<>", ">", "<", ">=", "<=")


def compare(c: Column, op: str, value) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    if op == "=":
        return c == v
    if op in ("!=", "<>"):
        return c != v
    if op == ">":
        return c > v
    if op == "<":
        return c < v
    if op == ">=":
        return c >= v
    if op == "<=":
        return c <= v
    raise ValueError(op)


# The ten named LIKE criteria of the query generator and the
# pattern text it emits for each.
LIKE_CRITERIA = {
    "starts_with_a": "a%",
    "ends_with_ing": "%ing",
    "contains_apple": "%apple%",
    "exactly_5_characters": "_____",
    "ends_with_at": "%at%",
    "does_not_contain_xyz": "%[^xyz]%",
    "starts_with_A_or_B": "[AB]%",
    "ends_with_ing_or_ed": "%(ing|ed)",
    "alphanumeric": "%[A-Za-z0-9]%",
    "starts_with_vowel": "[AEIOU]%",
}

# Bracket and alternation forms are not LIKE syntax; the named intent is
# evaluated as a regular expression instead (find semantics).
_INTENT_REGEX = {
    "does_not_contain_xyz": ("not", "[xyz]"),
    "starts_with_A_or_B": ("", "^[AB]"),
    "ends_with_ing_or_ed": ("", "(ing|ed)$"),
    "alphanumeric": ("", "[A-Za-z0-9]"),
    "starts_with_vowel": ("", "^[AEIOU]"),
}


def named_pattern(c: Column, criteria: str) -> Column:
    """Predicate for one of the ten named criteria (F-6)."""
    if criteria in _INTENT_REGEX:
        neg, rx = _INTENT_REGEX[criteria]
        p = c.rlike(rx)
        return ~p if neg else p
    return c.like(LIKE_CRITERIA[criteria])


def named_pattern_sql(x: str, criteria: str) -> str:
    """DuckDB spelling of :func:`named_pattern` for the oracle."""
    if criteria in _INTENT_REGEX:
        neg, rx = _INTENT_REGEX[criteria]
        p = f"regexp_matches({x}, '{rx}')"
        return f"(NOT {p})" if neg else p
    return f"{x} LIKE '{LIKE_CRITERIA[criteria]}'"


# ---------------------------------------------------------------------- joins

def hot_keys(df: DataFrame, key: str, share: int) -> Column:
    """Keys that hold about a ``share``-th of the rows or more, as a scalar
    subquery: an array of ``share`` keys at most, from a frequency sketch that
    merges in tasks.  NULL keys are not counted."""
    top = df.filter(F.col(key).isNotNull()).agg(
        F.call_function("approx_top_k", F.col(key), F.lit(share), F.lit(16 * share)).alias("top"), F.count(F.lit(1)).alias("n"))
    hot = F.transform(F.filter("top", lambda x: x["count"] * share >= F.col("n")), lambda x: x["item"])
    return top.select(hot).scalar()


def salted(df: DataFrame, key: str, hot: Column, salt_by: Sequence[str], salts: int) -> DataFrame:
    """``df`` with ``__salt``: rows of hot keys are dealt over ``salts`` values by
    the hash of ``salt_by``, so that a task run again deals them alike."""
    deal = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    return df.withColumn("__salt", F.when(F.array_contains(hot, F.col(key)), deal).otherwise(0))


def skew_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salt_by: Sequence[str],
              share: int = 100, salts: int = 32) -> DataFrame:
    """Inner equi-join on columns that are no keys (J-6).  Keys that hold a
    ``share``-th of the left rows are split over ``salts`` tasks, and the right
    rows of these keys alone are repeated; all other keys join as they are.
    The sketch only chooses the path: every pair comes out exactly once.

    ``salt_by``: columns of the left side that tell rows of one key apart."""
    hot = hot_keys(left, left_key, share)
    spread = salted(left, left_key, hot, salt_by, salts)
    copies = F.when(F.array_contains(hot, F.col(right_key)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("__copy", F.explode(copies))
    return (spread.join(repeated, (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__copy")))
            .drop("__salt", "__copy"))


# ----------------------------------------------------------------- subqueries

def in_subquery(df: DataFrame, key: str, sub: DataFrame, sub_key: str) -> DataFrame:
    """``key IN (SELECT sub_key ...)``: a left-semi join (duplicates on the
    sub side never multiply rows)."""
    return df.join(sub.select(F.col(sub_key).alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def not_in_subquery(df: DataFrame, key: str, sub: DataFrame, sub_key: str) -> DataFrame:
    """Three-valued ``key NOT IN (SELECT sub_key ...)``.

    Built as a partitioned hash anti join on the non-NULL keys plus two
    scalar subqueries (row count and NULL count of the sub side), instead of
    the null-aware anti join that needs the whole sub side broadcast.
    """
    s = sub.select(F.col(sub_key).alias("__k"))
    stats = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__k").isNull()).alias("n_null"))
    n = stats.select("n").scalar()
    n_null = stats.select("n_null").scalar()
    kept = df.join(s.filter(F.col("__k").isNotNull()), F.col(key) == F.col("__k"), "left_anti")
    return kept.filter((n == 0) | (F.col(key).isNotNull() & (n_null == 0)))


def exists(df: DataFrame, child: DataFrame, on: Column | str | list) -> DataFrame:
    """Correlated EXISTS -> left semi join."""
    return df.join(child, on, "left_semi")


def not_exists(df: DataFrame, child: DataFrame, on: Column | str | list) -> DataFrame:
    """Correlated NOT EXISTS -> left anti join."""
    return df.join(child, on, "left_anti")


def compare_to_aggregate(df: DataFrame, c: str, op: str, sub: DataFrame, agg: str, sub_c: str) -> DataFrame:
    """``c op (SELECT AGG(sub_c) FROM sub)``: the aggregate is a scalar
    subquery computed once (partial + final aggregation), not a join."""
    fn = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum, "count": F.count}[agg.lower()]
    scalar = sub.agg(fn(sub_c)).scalar()
    return df.filter(compare(F.col(c), op, scalar))


# ---------------------------------------------------------------- aggregation

def loose_group_by(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column],
                   bare: Sequence[str]) -> DataFrame:
    """GROUP BY with extra non-grouped columns (SQLite loose grouping).

    SQLite returns an arbitrary row's value; we pin it to the minimum so the
    answer is deterministic on every engine and partitioning.
    """
    return df.groupBy(*keys).agg(*aggs, *[F.min(b).alias(b) for b in bare])


# ------------------------------------------------------------ sort and limit

def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Sort + limit -> TakeOrderedAndProject (each task keeps k rows)."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """LIMIT n OFFSET m over a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


# ------------------------------------------------------------ set operations

def set_op(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    kind = kind.lower().replace("_", " ")
    if kind == "union":
        return left.union(right).distinct()
    if kind == "union all":
        return left.unionAll(right)
    if kind == "intersect":
        return left.intersect(right)
    if kind == "intersect all":
        return left.intersectAll(right)
    if kind in ("except", "minus"):
        return left.subtract(right)
    if kind == "except all":
        return left.exceptAll(right)
    raise ValueError(kind)
