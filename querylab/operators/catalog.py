"""Catalog and graph operators (K family).

A catalog feed is a DataFrame with one row per database in the usual
benchmark catalog shape::

    db_id string, table_names_original array<string>,
    column_names_original array<array<string>>   -- [table_idx, name], idx -1 = '*'
    column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>

Relations are obtained with ``posexplode`` and joins, so a feed of any number
of databases is processed in one job.  Graph operators take any edge
DataFrame ``(src, dst)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylab.operators.compare import dense_positions
from querylab.operators.relational import type_bucket
from querylab.session import saved

CATALOG_SCHEMA = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("table_names_original", T.ArrayType(T.StringType())),
    T.StructField("column_names_original", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("column_types", T.ArrayType(T.StringType())),
    T.StructField("primary_keys", T.ArrayType(T.IntegerType())),
    T.StructField("foreign_keys", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def catalog_type(dt: T.DataType) -> str:
    """Total mapping onto the catalog type tags (nested types -> 'others')."""
    return type_bucket(dt) or "others"


def catalog_row(db_id: str, tables: dict[str, T.StructType], pks: Sequence[tuple[str, str]],
                fks: Sequence[tuple[str, str, str, str]]) -> tuple:
    """Build one catalog row from table schemas (metadata only) and key lists."""
    names = list(tables)
    cols = [["-1", "*"]]
    types = ["text"]
    index = {}
    for ti, tn in enumerate(names):
        for f in tables[tn].fields:
            index[(tn, f.name)] = len(cols)
            cols.append([str(ti), f.name])
            types.append(catalog_type(f.dataType))
    return (db_id, names, cols, types, [index[k] for k in pks],
            [[index[(a, b)], index[(c, d)]] for a, b, c, d in fks])


def catalog_df(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), CATALOG_SCHEMA)


# ------------------------------------------------- keys and counts from data

def is_key_like(name: str) -> bool:
    return name.endswith(("key", "_id"))


#: A column whose estimated distinct values fall below this share of its rows
#: has repeated ones (six deviations of a sketch of 4,096 entries).
UNIQUE_SHARE = 0.9


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, likely, whole, n_rows, n_values, values, n_distinct): one
    scan a table, for all its columns at once.  ``values`` is a theta sketch of
    a key-like or integer column's values, ``n_distinct`` its estimate."""
    parts = []
    for n, df in tables.items():
        whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
        sketch = lambda c: (F.theta_sketch_agg(F.col(c).cast("long" if c in whole else "string"))
                            if c in whole or is_key_like(c) else F.lit(None).cast("binary"))
        rows = [F.struct(F.lit(n).alias("table"), F.lit(c).alias("column"), F.lit(is_key_like(c)).alias("likely"),
                         F.lit(c in whole).alias("whole"), F.count("*").alias("n_rows"), F.count(F.col(c)).alias("n_values"),
                         sketch(c).alias("values")) for c in df.columns]
        parts.append(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    return reduce(DataFrame.unionAll, parts).withColumn("n_distinct", F.theta_sketch_estimate("values"))


def _unique(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """One row: are ``cols`` together non-null and distinct in every row?"""
    some = df.select(*cols).groupBy(*cols).agg(F.count("*").alias("n"))
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return some.agg((F.coalesce(F.max("n") == 1, F.lit(False)) & ~F.coalesce(F.bool_or(null), F.lit(False))).alias("ok")).select(
        F.lit(table).alias("table"), F.array(*map(F.lit, cols)).alias("cols"), "ok")


#: One in how many values of a pair's first column are looked through for a repeated pair first.
SLICE = 64


def _repeated(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """One row: does a pair of ``cols`` come twice among every ``SLICE``-th
    value of the first?  If so it is no key; if not, all rows must tell."""
    some = df.select(*cols).filter(F.pmod(F.xxhash64(cols[0]), F.lit(SLICE)) == 0).groupBy(*cols).agg(F.count("*").alias("n"))
    return some.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("twice")).select(
        F.lit(table).alias("table"), F.array(*map(F.lit, cols)).alias("cols"), "twice")


def infer_primary_keys(tables: dict[str, DataFrame], columns: DataFrame) -> list[tuple[str, str]]:
    """(table, column) of primary keys: the first key-like column that is
    unique, else the first pair of a table's first key-like column with another
    integer column.  The profile's ``columns`` rule out what has nulls or too
    few values; only what they leave is scanned exactly.  Pairs are searched
    only for tables without a single key, and only where the columns' values
    multiply to the number of rows."""
    # A row a column, without its sketch.
    rows = columns.select("table", "column", "likely", "whole", "n_rows", "n_values", "n_distinct").collect()
    full = {(r.table, r.column): r for r in rows if r.n_rows and r.n_values == r.n_rows}

    def first(candidates: list[tuple[str, list[str]]]) -> dict[str, list[str]]:
        if not candidates:
            return {}
        found = reduce(DataFrame.unionAll, [_unique(tables[n], n, c) for n, c in candidates]).filter("ok").collect()
        good = {(r["table"], tuple(r["cols"])) for r in found}
        out: dict[str, list[str]] = {}
        for n, c in candidates:
            if (n, tuple(c)) in good:
                out.setdefault(n, c)
        return out

    likely = {n: [c for c in df.columns if is_key_like(c)] for n, df in tables.items()}
    keys = first([(n, [c]) for n, cs in likely.items() for c in cs
                  if (n, c) in full and full[n, c].n_distinct >= UNIQUE_SHARE * full[n, c].n_rows])
    pairs = [(n, [cs[0], c]) for n, cs in likely.items() if cs and n not in keys and (n, cs[0]) in full
             for c in tables[n].columns if c != cs[0] and (n, c) in full and full[n, c].whole
             and full[n, cs[0]].n_distinct * full[n, c].n_distinct >= UNIQUE_SHARE ** 2 * full[n, c].n_rows]
    # A repeated pair found in a part of the rows spares the scan of all; every pair left is checked on all rows.
    if pairs:
        found = reduce(DataFrame.unionAll, [_repeated(tables[n], n, c) for n, c in pairs]).filter("twice").collect()
        twice = {(r["table"], tuple(r["cols"])) for r in found}
        pairs = [(n, c) for n, c in pairs if (n, tuple(c)) not in twice]
    keys |= first(pairs)
    return [(n, c) for n in tables for c in keys.get(n, [])]


def infer_foreign_keys(tables: dict[str, DataFrame], pks: Sequence[tuple[str, str]],
                       columns: DataFrame) -> list[tuple[str, str, str, str]]:
    """(table, column, referenced table, referenced column): key-like columns
    named like another table's single-column key (the same name, or the same
    ending after the first underscore, other than ``id``) all of whose values
    occur there.  A value of the child's sketch that the parent's lacks is a
    value that is missing, so only pairs without one are anti-joined."""
    per = {n: [c for t, c in pks if t == n] for n in tables}
    parents = [(n, cs[0]) for n, cs in per.items() if len(cs) == 1]
    ending = lambda c: c.split("_", 1)[-1]
    pairs = [(a, c, b, k) for a, df in tables.items() for c in df.columns if is_key_like(c)
             for b, k in parents if a != b and (c == k or ending(c) == ending(k) != "id")]
    if not pairs:
        return []
    named = columns.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, c string, b string, k string")
    sides = [columns.select(F.col("table").alias(t), F.col("column").alias(c), F.col("values").alias(v))
             for t, c, v in (("a", "c", "own"), ("b", "k", "theirs"))]
    lacking = F.theta_sketch_estimate(F.theta_difference("own", "theirs")) > 0
    left = {r.i for r in named.join(sides[0], ["a", "c"]).join(sides[1], ["b", "k"]).filter(~lacking).select("i").collect()}
    if not left:
        return []

    def missing(i: int, a: str, c: str, b: str, k: str) -> DataFrame:
        child = tables[a].select(F.col(c).cast("long").alias("v")).filter("v is not null").distinct()
        parent = tables[b].select(F.col(k).cast("long").alias("v"))
        return child.join(parent, "v", "left_anti").agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n")
    rows = reduce(DataFrame.unionAll, [missing(i, *pairs[i]) for i in sorted(left)]).filter("n = 0").collect()
    return [pairs[i] for i in sorted(r["i"] for r in rows)]


# ----------------------------------------------------------- K-1 .. K-3

def columns_relation(catalog: DataFrame, include_star: bool = False) -> DataFrame:
    """(db_id, col_idx, table, column, type) (K-1)."""
    ex = catalog.select("db_id", "table_names_original", "column_types",
                        F.posexplode("column_names_original").alias("col_idx", "tc"))
    t_idx = F.col("tc")[0].cast("int")
    out = ex.select("db_id", "col_idx",
                    F.when(t_idx >= 0, F.element_at("table_names_original", t_idx + 1)).alias("table"),
                    F.col("tc")[1].alias("column"),
                    F.element_at("column_types", F.col("col_idx") + 1).alias("type"))
    return out if include_star else out.filter(F.col("table").isNotNull())


def primary_keys(catalog: DataFrame) -> DataFrame:
    """(db_id, table, column) for every primary-key column (K-2): every
    listed key is kept, so composite and missing keys are handled."""
    pk = catalog.select("db_id", F.explode("primary_keys").alias("col_idx"))
    return pk.join(columns_relation(catalog), ["db_id", "col_idx"]).select("db_id", "table", "column")


def foreign_keys(catalog: DataFrame) -> DataFrame:
    """FK edges (db_id, table1, column1, table2, column2) with the degree of
    each table, most-connected table first, each table pair once (K-3)."""
    fk = catalog.select("db_id", F.explode("foreign_keys").alias("p")).select(
        "db_id", F.col("p")[0].alias("c1"), F.col("p")[1].alias("c2"))
    cols = columns_relation(catalog).select("db_id", "col_idx", "table", "column")
    a = cols.select("db_id", F.col("col_idx").alias("c1"), F.col("table").alias("table1"), F.col("column").alias("column1"))
    b = cols.select("db_id", F.col("col_idx").alias("c2"), F.col("table").alias("table2"), F.col("column").alias("column2"))
    e = fk.join(a, ["db_id", "c1"]).join(b, ["db_id", "c2"]).select("db_id", "table1", "column1", "table2", "column2")
    ends = e.select("db_id", F.col("table1").alias("t")).unionAll(e.select("db_id", F.col("table2").alias("t")))
    deg = ends.groupBy("db_id", "t").agg(F.count(F.lit(1)).alias("degree"))
    d1 = deg.select("db_id", F.col("t").alias("table1"), F.col("degree").alias("degree1"))
    d2 = deg.select("db_id", F.col("t").alias("table2"), F.col("degree").alias("degree2"))
    return e.join(d1, ["db_id", "table1"]).join(d2, ["db_id", "table2"])


def table_edges(fk: DataFrame) -> DataFrame:
    """Undirected table-level edges (db_id, src, dst), one row per pair."""
    return (fk.select("db_id", F.least("table1", "table2").alias("src"), F.greatest("table1", "table2").alias("dst"))
            .filter(F.col("src") != F.col("dst")).distinct())


# ----------------------------------------------------- K-4 / K-5 components

def chain_edges(df: DataFrame, group: Sequence[str], order_col: str, node_col: str) -> DataFrame:
    """Link each row to the next one of its group in ``order_col`` order.

    No window per group (a hot group would land in one task): a global sort
    (range partitioned, balanced whatever the group sizes) gives dense
    positions, and each row joins the row at position + 1 when it belongs to
    the same group, an equi join on a unique key."""
    pos = dense_positions(df.select(*group, order_col, node_col), [*[F.col(g) for g in group], F.col(order_col)])
    a = pos.select(*[F.col(g).alias(f"a_{g}") for g in group], F.col(node_col).alias("src"), F.col("pos").alias("p"))
    b = pos.select(*[F.col(g).alias(f"b_{g}") for g in group], F.col(node_col).alias("dst"),
                   (F.col("pos") - 1).alias("p"))
    same = [F.col(f"a_{g}").eqNullSafe(F.col(f"b_{g}")) for g in group]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return a.join(b, "p").filter(cond).select("src", "dst")


def _sym(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(
        e.select(F.col("dst").alias("u"), F.col("src").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with component = smallest node id of its component
    (K-4), by contraction: every node goes to the first of itself and its
    neighbours, in an order that a hash draws anew each round, and the edges
    between what is left go on.  Each round leaves about half of the nodes,
    of chains and stars alike, so all rounds together cost about two of the
    first.  Then the last round's names are handed back, round by round.
    Every step is a few grouped aggregations and joins, written to the shared
    checkpoint folder so lineage stays short and a lost executor only
    recomputes the current step."""
    e = edges.select(F.col("src"), F.col("dst")).filter(F.col("src") != F.col("dst"))
    e = saved(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    none, rounds = e.select(F.col("src").alias("node"), F.col("dst").alias("component")), []
    while not e.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(len(rounds)), c)  # noqa: E731, B023
        near = _sym(e).groupBy("u").agg(F.min_by("v", rank(F.col("v"))).alias("v"))
        to = saved(near.select("u", F.when(rank(F.col("v")) < rank(F.col("u")), F.col("v")).otherwise(F.col("u")).alias("to")), "contracted")
        rounds.append(to)
        left = (e.join(to.toDF("src", "a"), "src").join(to.toDF("dst", "b"), "dst").filter("a <> b")
                .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        e = saved(left, "edges")
    if not rounds:
        return none
    named = rounds.pop().toDF("node", "name")
    while rounds:
        # What is in no later round has its last name.
        later = named.toDF("to", "name")
        named = saved(rounds.pop().join(later, "to", "left").select(F.col("u").alias("node"), F.coalesce("name", "to").alias("name")), "names")
    least = named.groupBy("name").agg(F.min("node").alias("component"))
    return named.join(least, "name").select("node", "component")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def max_joins(components: DataFrame) -> DataFrame:
    """Largest joinable component size minus one (K-5)."""
    return component_sizes(components).agg((F.max("size") - 1).alias("max_joins"))


# ------------------------------------------------------------- K-6 subsets

def connected_subsets(edges: DataFrame, k: int) -> DataFrame:
    """All connected k-node subsets with their edges (K-6).

    k-1 rounds of frontier x edge expansion, each an equi join of exploded
    members with the (symmetric) edge list; sets are sorted arrays so a set
    reached in several ways is kept once."""
    e = edges.select(F.col("src"), F.col("dst"))
    sym = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(
        e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    frontier = e.select(F.array_sort(F.array("src", "dst")).alias("nodes")).distinct()
    for _ in range(k - 2):
        members = frontier.select("nodes", F.explode("nodes").alias("a"))
        grown = (members.join(sym, "a").filter(~F.array_contains(F.col("nodes"), F.col("b")))
                 .select(F.array_sort(F.array_union("nodes", F.array("b"))).alias("nodes")).distinct())
        frontier = grown
    members = frontier.select("nodes", F.explode("nodes").alias("src"))
    inside = (members.join(e, "src").filter(F.array_contains(F.col("nodes"), F.col("dst")))
              .groupBy("nodes").agg(F.array_sort(F.collect_set(F.concat_ws("-", "src", "dst"))).alias("edges")))
    return inside


# ------------------------------------------------------------ K-7 .. K-10

def column_owners(columns: DataFrame) -> DataFrame:
    """Column name -> owning tables (K-7)."""
    return (columns.groupBy("db_id", "column")
            .agg(F.array_join(F.array_sort(F.collect_set("table")), ",").alias("tables"),
                 F.count(F.lit(1)).alias("n_tables")))


def qualified_attributes(columns: DataFrame) -> DataFrame:
    """Type buckets with ambiguous names qualified as ``table.column`` (K-8)."""
    owners = column_owners(columns).select("db_id", "column", "n_tables")
    return (columns.join(owners, ["db_id", "column"])
            .select("db_id", "table", "column", F.col("type").alias("bucket"),
                    F.when(F.col("n_tables") > 1, F.concat_ws(".", "table", "column"))
                    .otherwise(F.col("column")).alias("attribute")))


def fk_neighbours(fk: DataFrame) -> DataFrame:
    """(db_id, table, neighbour) over both edge directions (K-9)."""
    a = fk.select("db_id", F.col("table1").alias("table"), F.col("table2").alias("neighbour"))
    b = fk.select("db_id", F.col("table2").alias("table"), F.col("table1").alias("neighbour"))
    return a.unionAll(b).distinct()


def groupable_columns(columns: DataFrame, pks: DataFrame) -> DataFrame:
    """Non-primary-key columns eligible for GROUP BY (K-10)."""
    return columns.join(pks, ["db_id", "table", "column"], "left_anti")
