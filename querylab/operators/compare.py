"""Distributed comparison of query results (bag, ordered and column-permuted
equality, partial answers, multi-database verdicts, cached verdicts).

Results travel in one long table so any number of (gold, prediction) pairs,
over any number of databases, are compared in a single job:

    keys..., side ('gold' | 'pred'), pos (bigint, NULL when unordered),
    cells array<string>

``cells`` holds one canonical string per output column: a type-class tag plus
the value, so ``1`` and ``1.0`` compare equal (both numbers) while ``1`` and
``'1'`` do not, and NULL stays NULL (distinct from the empty string).

All work is joins and aggregations keyed by (keys, row); no pair, group or
result is collected on the driver, so a hot pair holding a third of all rows
is split across tasks by its row values and partially aggregated map-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylab.session import saved

GOLD, PRED = "gold", "pred"


# ------------------------------------------------------------ canonical cells

def canonical_cell_sql(name: str, dt: T.DataType) -> str:
    """Canonical string of one output cell, as SQL (one large UNION ALL is
    built from these instead of many chained DataFrame unions).

    Numbers compare by value across types: integers and decimals give their
    exact digits; a double that is a whole number gives those digits too (so
    1, 1.0 and 1.00 agree, and 2^53 and 2^53 + 1 differ), any other its
    shortest decimal form."""
    q = f"`{name}`"
    if isinstance(dt, (T.BooleanType, T.IntegralType)):
        return f"concat('n|', CAST(CAST({q} AS BIGINT) AS STRING))"
    if isinstance(dt, T.DecimalType):
        plain = f"CAST({q} AS STRING)"
        if dt.scale == 0:
            return f"concat('n|', {plain})"
        # whole numbers lose the point; -0.00 is 0
        bare = f"regexp_replace(regexp_replace({plain}, '0+$', ''), '[.]$', '')"
        return f"concat('n|', CASE WHEN {q} = 0 THEN '0' ELSE {bare} END)"
    if isinstance(dt, T.FractionalType):
        d = f"CAST({q} AS DOUBLE)"
        whole = f"CAST(CAST({d} AS DECIMAL(38, 0)) AS STRING)"
        dec = f"try_cast(CAST({d} AS STRING) AS DECIMAL(38, 18))"
        part = f"regexp_replace(CAST({dec} AS STRING), '0+$', '')"
        return (f"concat('n|', CASE WHEN {d} = rint({d}) AND abs({d}) < 1e37 THEN {whole} "
                f"WHEN CAST({dec} AS DOUBLE) = {d} THEN {part} ELSE CAST({d} AS STRING) END)")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return f"concat('t|', CAST({q} AS STRING))"
    if isinstance(dt, T.StringType):
        return f"concat('s|', {q})"
    return f"concat('x|', to_json(named_struct('v', {q})))"


def cells_sql(schema: T.StructType) -> str:
    return "array(" + ", ".join(canonical_cell_sql(f.name, f.dataType) for f in schema.fields) + ")"


def cells_of(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    cols = list(columns) if columns is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.expr("array(" + ", ".join(canonical_cell_sql(c, types[c]) for c in cols) + ")")


def _numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows in ``order`` (none: the query's own) with ``__pid`` and a number
    ``__mid`` rising inside each partition, written once to the shared folder:
    every later read sees the same partitions, whatever columns it needs."""
    s = df.orderBy(*order) if order else df
    return (s.withColumn("__pid", F.spark_partition_id())
            .withColumn("__mid", F.monotonically_increasing_id()).checkpoint(eager=True))


def _offsets(s: DataFrame, value: Column) -> DataFrame:
    """Sum of ``value`` over all earlier partitions: one row a partition."""
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = s.groupBy("__pid").agg(F.sum(value).alias("__t"))
    return totals.select("__pid", F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__off"))


def dense_positions(df: DataFrame, order: Sequence[Column], pos_col: str = "pos") -> DataFrame:
    """Attach 0-based consecutive positions in ``order`` without a global
    single-partition window: sort (range partitioned), number rows inside
    each partition, then add per-partition offsets from a table with one row
    per partition (its size is bounded by the partition count)."""
    s = _numbered(df, order)
    out = s.join(F.broadcast(_offsets(s, F.lit(1))), "__pid")
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    return out.withColumn(pos_col, (F.col("__off") + local).cast("bigint")).drop("__pid", "__mid", "__off")


def running_sum(df: DataFrame, order: Sequence[Column], value: str, out_col: str = "cum_before") -> DataFrame:
    """Exclusive running sum of ``value`` in ``order`` without a global
    single-partition window: sort, sum within each partition (a window
    partitioned by the partition id, i.e. bounded by partition size), and add
    the totals of all earlier partitions (a table with one row per
    partition)."""
    s = _numbered(df, order)
    inner = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
    out = (s.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
           .join(F.broadcast(_offsets(s, F.col(value))), "__pid"))
    return out.withColumn(out_col, (F.col("__off") + F.col("__in")).cast("long")).drop("__pid", "__mid", "__off", "__in")


def result_rows(df: DataFrame, side: str, keys: dict | None = None,
                order: Sequence[Column] | None = None, key_cols: Sequence[str] = ()) -> DataFrame:
    """Turn a query result into long result rows.

    ``keys`` are constant key values (e.g. ``{"pair": "p1"}``); ``key_cols``
    are columns of ``df`` that are keys rather than output (e.g. a database
    column when one query ran over many databases at once).  With ``order``
    the rows get positions (ordered comparison)."""
    out_cols = [c for c in df.columns if c not in key_cols]
    base = df.select(*key_cols, cells_of(df, out_cols).alias("cells"))
    if order is not None:
        base = dense_positions(df.select(*key_cols, *out_cols), order).select(
            *key_cols, "pos", cells_of(df, out_cols).alias("cells"))
    else:
        base = base.withColumn("pos", F.lit(None).cast("bigint"))
    for k, v in (keys or {}).items():
        base = base.withColumn(k, F.lit(v))
    return base.withColumn("side", F.lit(side)).select(*(list(keys or {}) + list(key_cols)), "side", "pos", "cells")


# ------------------------------------------------------------ digests

_LANE = (1 << 21) - 1


def _two(*c) -> Column:
    """Two independent 64-bit hashes of columns, summed over rows in lanes of 21
    bits (exact below 2^42 rows): with the row count a digest of the multiset
    of rows that does not depend on their order.  Unequal multisets share it
    with a chance of about 2^-126."""
    def lanes(k: int) -> list[Column]:
        h = F.xxhash64(F.lit(k), *c)
        return [F.sum(F.shiftrightunsigned(h, 21 * i).bitwiseAND(F.lit(_LANE).cast("long"))).alias(f"h{k}_{i}") for i in range(3)]
    return F.struct(*lanes(1), *lanes(2))


def entity_rows(results: DataFrame, *ids: Column | str, ordered: bool = True) -> DataFrame:
    """(id, pos, cells) of results, an entity being one query's result on one
    database; NULL cells are empty texts, which no canonical cell is.  Rows
    without a position are a bag, rows with one a sequence."""
    pos = F.col("pos") if ordered else F.lit(None).cast("bigint").alias("pos")
    return results.select(F.struct(*ids).alias("id"), pos, F.transform("cells", lambda x: F.coalesce(x, F.lit(""))).alias("cells"))


def digests(rows: DataFrame) -> DataFrame:
    """One row an entity: n, arity, whether it is ordered, and digests of its
    rows as they stand and with their cells sorted (hashes leave out a position
    that is null)."""
    return rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("arity"), F.bool_or(F.col("pos").isNotNull()).alias("ordered"),
        _two("pos", "cells").alias("direct"), _two("pos", F.array_sort("cells")).alias("sorted"))


def set_digests(rows: DataFrame) -> DataFrame:
    """(id, rows_set): digest of the distinct rows with their cells sorted."""
    hashes = rows.select("id", F.xxhash64(F.lit(1), F.array_sort("cells")).alias("a"), F.xxhash64(F.lit(2), F.array_sort("cells")).alias("b"))
    return hashes.distinct().groupBy("id").agg(_two("a", "b").alias("rows_set"))


# ------------------------------------------------------------ refinement

def refine(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Colours of the columns of ``marked(id, mark, arity)``, by refinement.

    A row's colour is the bag of its cells with their columns' colours; a
    column's colour the bag of its cells with their rows' colours.  Both are
    made anew until no column class splits (at most as many rounds as there are
    columns).  Columns that some isomorphism maps onto each other get the same
    colour, in whatever order rows and columns come.  ``mark`` lists columns
    that start with a colour of their own.  Returns (id, mark, cols), ``cols``
    being structs of colour, own (equal only for columns that are the same in
    every row) and col."""
    start = marked.select("id", "mark", F.transform(
        F.sequence(F.lit(0), F.col("arity") - 1), lambda i: F.array_position("mark", i).cast("long")).alias("colours"))
    n_columns, n_classes = marked.agg(F.sum("arity")).first()[0], None
    while True:
        row = F.xxhash64("pos", F.array_sort(F.zip_with("cells", "colours", lambda v, c: F.xxhash64(v, c))))
        cells = rows.join(start, "id").select(
            "id", "mark", row.alias("row"), F.xxhash64("pos", "cells").alias("whole"),
            F.posexplode(F.arrays_zip("cells", "colours")).alias("col", "x"))
        total = cells.groupBy("id", "mark", "col").agg(
            _two("x.cells", "row").alias("seen"), F.first("x.colours").alias("old"), _two("x.cells", "whole").alias("own"))
        coloured = saved(total.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct(
            "col", F.xxhash64("old", "seen").alias("colour"), "own"))).alias("cols")), "colours")
        n = coloured.agg(F.sum(F.size(F.array_distinct(F.transform("cols", lambda x: x["colour"]))))).first()[0]
        if n in (n_classes, n_columns):
            return coloured.select("id", "mark", F.array_sort(F.transform(
                "cols", lambda x: F.struct(x["colour"].alias("colour"), x["own"].alias("own"), x["col"].alias("col")))).alias("cols"))
        n_classes, start = n, coloured.select("id", "mark", F.transform("cols", lambda x: x["colour"]).alias("colours"))


def _same(cols: Column, colour: Column) -> Column:
    return F.filter(cols, lambda y: y["colour"] == colour)


def _different(cols: Column) -> Column:
    """One of each group of neighbouring columns that are the same in every row."""
    return F.filter(cols, lambda y, k: (k == 0) | (F.get(cols, k - 1)["own"] != y["own"]))


def permuted_equal(rows: DataFrame, links: DataFrame, sums: DataFrame) -> DataFrame:
    """Keys of ``links(key, gold, pred)`` whose results are equal after some
    permutation of the columns (E-4).

    Refined colours pair the columns; one representative of the pairings they
    leave is verified by the digest of the permuted rows.  Only if that fails,
    and columns of one colour differ, the first such gold column is told apart
    and tried against each such predicted column, and colours are refined again.
    Results are coloured once, whatever the number of links they are in."""
    none = F.array().cast("array<int>")
    states, found = links.select("key", "gold", "pred", none.alias("gmark"), none.alias("pmark")), None
    arity = sums.select("id", "arity")
    while True:
        marked = states.select(F.col("gold").alias("id"), F.col("gmark").alias("mark")).unionByName(
            states.select(F.col("pred").alias("id"), F.col("pmark").alias("mark"))).distinct().join(arity, "id")
        coloured = refine(rows, marked)
        colours = lambda c: F.transform(c, lambda x: x["colour"])
        paired = F.array_sort(F.zip_with("gcols", "pcols", lambda a, b: F.struct(a["col"].alias("g"), b["col"].alias("p"))))
        tried = saved(
            states.join(coloured.toDF("gold", "gmark", "gcols"), ["gold", "gmark"]).join(coloured.toDF("pred", "pmark", "pcols"), ["pred", "pmark"])
            .filter(colours("gcols") == colours("pcols")).withColumn("perm", F.transform(paired, lambda x: x["p"])), "pairings")
        turned = rows.join(tried.select(F.col("pred").alias("id"), "key", "gold", "pmark", "perm"), "id").withColumn(
            "cells", F.transform("perm", lambda j: F.get("cells", j)))
        proved = turned.groupBy("key", "gold", "pmark").agg(_two("pos", "cells").alias("turned"))
        proved = saved(proved.join(sums.select(F.col("id").alias("gold"), "direct"), "gold").filter(F.col("turned") == F.col("direct"))
                       .select("key").distinct(), "proved")
        found = proved if found is None else found.unionByName(proved)
        class_of = F.get(F.filter("gcols", lambda x: F.size(_different(_same(F.col("gcols"), x["colour"]))) > 1), F.lit(0))
        open_ = tried.join(proved, "key", "left_anti").withColumn("class", class_of).filter("class is not null")
        states = saved(open_.select(
            "key", "gold", "pred", F.concat("gmark", F.array("class.col")).alias("gmark"), "pmark",
            F.explode(_different(_same(F.col("pcols"), F.col("class.colour")))).alias("x")).select(
            "key", "gold", "pred", "gmark", F.concat("pmark", F.array("x.col")).alias("pmark")), "states")
        if states.isEmpty():
            return found.distinct()


# ------------------------------------------------------------ partial answers

#: Paths a link may hold before rows prune them.
PATHS = 64


def partial_cover(rows: DataFrame, links: DataFrame, sums: DataFrame) -> DataFrame:
    """(key, partial) for ``links(key, gold, pred)``: every gold row is an
    ordered sub-sequence of some predicted row (E-5).

    A gold column can only meet a predicted one that shares a value with it, so
    values are joined first, and rising paths through such columns are extended
    one gold column at a time; where a link holds many, those on which no rows
    begin alike go.  The gold rows are anti-joined with the predicted rows'
    cells on the whole paths.  Nothing grows with the number of column subsets
    as such."""
    gold, pred = (rows.join(links.select("key", F.col(side).alias("id")), "id").select("key", "cells") for side in ("gold", "pred"))
    values = [x.select("key", F.posexplode("cells").alias(c, "v")).select("key", c, F.xxhash64("v").alias("v")).distinct()
              for x, c in ((gold, "g"), (pred, "p"))]
    shared = saved(values[0].join(values[1], ["key", "v"]).select("key", "g", "p").distinct(), "shared")
    arity = links.join(sums.select(F.col("id").alias("gold"), F.col("arity").alias("k")), "gold").select("key", "k")
    on = lambda: F.transform("path", lambda j: F.get("cells", j)).alias("cells")
    paths = arity.withColumn("path", F.array().cast("array<int>"))
    for g in range(arity.agg(F.max("k")).first()[0]):
        last = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(-1))
        longer = paths.join(shared.filter(F.col("g") == g).select("key", "p"), "key").filter((F.col("p") > last) & (F.col("k") > g))
        paths = saved(longer.withColumn("path", F.concat("path", F.array("p"))).drop("p").unionByName(paths.filter(F.col("k") <= g)), "paths")
        if paths.groupBy("key").count().filter(F.col("count") > PATHS).isEmpty():
            continue
        begins = gold.select("key", F.slice("cells", 1, g + 1).alias("cells")).distinct()
        seen = pred.join(paths.filter(F.col("k") > g), "key").select("key", "k", "path", on()).distinct()
        paths = saved(seen.join(begins, ["key", "cells"], "left_semi").select("key", "k", "path").distinct()
                      .unionByName(paths.filter(F.col("k") <= g)), "paths")
    covers = pred.join(paths, "key").select("key", on())
    missing = gold.join(covers, ["key", "cells"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n_missing"))
    return links.select("key").join(missing, "key", "left").select("key", F.col("n_missing").isNull().alias("partial"))


# ------------------------------------------------------------------ verdicts

VERDICTS = ("direct_equal", "quick_ok", "equal", "partial")


def compare_links(rows: DataFrame, links: DataFrame, verdicts: Sequence[str] = VERDICTS) -> DataFrame:
    """Verdicts of ``links(key, gold, pred)`` between the entities of ``rows``.

    An entity's digests are made once, however many links it is in; rows are
    read again only for links that the digests leave undecided."""
    sums = digests(rows)
    sums = saved(sums.join(set_digests(rows), "id") if "quick_ok" in verdicts else sums, "digests")
    v = links
    for side in ("gold", "pred"):
        v = v.join(sums.select(F.col("id").alias(side), F.struct(*[c for c in sums.columns if c != "id"]).alias(f"of_{side}")), side, "left")
    at = lambda side, c: F.col(f"of_{side}.{c}")
    both_empty = F.col("of_gold").isNull() & F.col("of_pred").isNull()
    same = lambda c: F.coalesce((at("gold", "arity") == at("pred", "arity")) & (
        at("gold", "n") == at("pred", "n")) & (at("gold", c) == at("pred", c)), F.lit(False))
    out = [F.coalesce(at(s, c), F.lit(0)).cast(t).alias(f"{c}_{s}") for c, t in (("n", "long"), ("arity", "int")) for s in ("gold", "pred")]
    out += [(both_empty | same("direct")).alias("direct_equal"), same("sorted").alias("maybe")]
    if "quick_ok" in verdicts:
        out.append((both_empty | F.when(at("gold", "ordered"), same("sorted")).otherwise(same("rows_set"))).alias("quick_ok"))
    v = v.select("key", "gold", "pred", *out)
    if "equal" in verdicts or "partial" in verdicts:
        v = saved(v, "verdicts")
    if "equal" in verdicts:
        todo = v.filter("maybe and not direct_equal").select("key", "gold", "pred")
        if todo.isEmpty():
            v = v.withColumn("equal", F.col("direct_equal"))
        else:
            found = permuted_equal(rows, todo, sums).withColumn("found", F.lit(True))
            v = v.join(found, "key", "left").withColumn("equal", F.col("direct_equal") | F.coalesce("found", F.lit(False))).drop("found")
    if "partial" in verdicts:
        wider = v.filter("arity_pred > arity_gold and n_gold > 0").select("key", "gold", "pred")
        if wider.isEmpty():
            v = v.withColumn("partial", F.lit(False))
        else:
            v = v.join(partial_cover(rows, wider, sums), "key", "left").withColumn("partial", F.coalesce("partial", F.lit(False)))
    return v


def compare_results(results: DataFrame, keys: Sequence[str], order_matters: bool = False,
                    pairs: DataFrame | None = None, verdicts: Sequence[str] = VERDICTS) -> DataFrame:
    """Full result equality per key (the evaluator's ``result_eq``):

    both empty -> equal; else row counts and arities must agree, the bags
    (or sequences) of unordered rows must agree (cheap reject), and some
    column permutation must make the rows equal as bags (or as sequences when
    ``order_matters``).

    ``pairs`` lists every key (a pair whose both results are empty has no
    rows at all).  Returns keys + n_gold, n_pred, arity_gold, arity_pred,
    direct_equal, quick_ok, equal, partial.
    """
    keys = list(keys)
    every = results.select(*keys).distinct() if pairs is None else pairs.select(*keys)
    links = every.select(F.struct(*keys).alias("key"), *[F.struct(*keys, F.lit(s).alias("side")).alias(s) for s in (GOLD, PRED)])
    v = compare_links(entity_rows(results, *keys, "side", ordered=order_matters), links, verdicts)
    return v.select("key.*", "n_gold", "n_pred", "arity_gold", "arity_pred", *[x for x in VERDICTS if x in verdicts])


def test_suite_verdict(per_db: DataFrame, pair_keys: Sequence[str], db_col: str = "db",
                       status_col: str | None = None) -> DataFrame:
    """E-6: a prediction passes only if it is equal on every database; an
    execution error on any database is a failure and a missing prediction
    ('Not Found') scores 0."""
    ok = F.coalesce(F.col("equal"), F.lit(False))
    if status_col:
        ok = ok & (F.col(status_col) == "ok")
    return per_db.groupBy(*pair_keys).agg(
        F.bool_and(ok).alias("exec_pass"), F.count(F.lit(1)).alias("n_dbs"),
        F.count_if(~ok).alias("n_failed_dbs"))


def accuracy(verdicts: DataFrame, group_cols: Sequence[str], flag: str = "exec_pass") -> DataFrame:
    """E-7: accuracy overall and per group (``rollup`` adds the overall row
    with NULL group values)."""
    return (verdicts.rollup(*group_cols)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("n_pass"),
                 F.avg(F.col(flag).cast("double")).alias("acc")))


def with_cached_verdicts(pairs: DataFrame, cache: DataFrame, keys: Sequence[str], compute) -> DataFrame:
    """E-8: reuse verdicts from a cache table keyed by ``keys`` and compute
    only the misses (``compute(missing_pairs) -> keys + verdict``)."""
    hit = pairs.join(cache, list(keys), "inner").withColumn("from_cache", F.lit(True))
    miss = pairs.join(cache.select(*keys), list(keys), "left_anti")
    fresh = compute(miss).withColumn("from_cache", F.lit(False))
    return hit.unionByName(fresh, allowMissingColumns=True)


__all__ = [
    "GOLD", "PRED", "canonical_cell_sql", "cells_of", "dense_positions", "result_rows", "entity_rows", "digests", "set_digests",
    "refine", "permuted_equal", "partial_cover", "compare_links", "compare_results", "test_suite_verdict", "accuracy",
    "with_cached_verdicts",
]
