"""Result comparison (E-1..E-8) over result pairs built from the driver tables.

Gold and predicted SQL run in Spark (``spark.sql`` on the table views) and are
compared by :mod:`querylab.operators.compare` in one job.  The DuckDB oracle
runs the same SQL and decides equality by brute force: every column
permutation is tried with EXCEPT ALL in both directions, an independent check
of the signature-pruned search.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylab.operators import compare as C
from querylab.plans.registry import query
from querylab.session import saved
from querylab.tables import Tables

N, S, T = "n", "s", "t"   # type classes of result columns (number, string, time)


@dataclass(frozen=True)
class Pair:
    name: str
    gold: str
    pred: str
    gold_types: tuple
    pred_types: tuple
    gold_order: str | None = None    # ORDER BY keys of an ordered gold (for the oracle's positions)
    pred_order: str | None = None

    @property
    def order_matters(self) -> bool:
        return "order by" in self.gold.lower()


_W = "FROM orders"
_G = f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus {_W}"
_MINK = "(SELECT MIN(o_orderkey) FROM orders)"
_TOP = "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey"

PAIRS = [
    Pair("identical", _G, _G, (N, N, N, S), (N, N, N, S)),
    Pair("row_shuffled", _G, f"{_G} ORDER BY o_totalprice, o_orderkey", (N, N, N, S), (N, N, N, S)),
    Pair("column_swapped", _G, f"SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice {_W}",
         (N, N, N, S), (N, N, S, N)),
    Pair("duplicate_added", _G, f"{_G} UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus "
         f"FROM orders WHERE o_orderkey = {_MINK}", (N, N, N, S), (N, N, N, S)),
    Pair("null_changed", _G, "SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey = "
         f"{_MINK} THEN NULL ELSE o_orderstatus END AS o_orderstatus {_W}", (N, N, N, S), (N, N, N, S)),
    Pair("wider", _G, f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate {_W}",
         (N, N, N, S), (N, N, N, S, T)),
    Pair("wider_reordered", _G, f"SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, o_orderstatus {_W}",
         (N, N, N, S), (N, T, N, N, S)),
    Pair("both_empty", f"{_G} WHERE o_totalprice < 0", f"SELECT o_orderkey, o_custkey {_W} WHERE o_totalprice < -1",
         (N, N, N, S), (N, N)),
    Pair("int_vs_double", _G, f"SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, o_orderstatus {_W}",
         (N, N, N, S), (N, N, N, S)),
    Pair("number_vs_text", _G, f"SELECT o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, o_totalprice, o_orderstatus {_W}",
         (N, N, N, S), (N, S, N, S)),
    Pair("swapped_and_changed", _G, "SELECT o_custkey, o_orderkey + 1 AS o_orderkey, o_orderstatus, o_totalprice "
         f"{_W}", (N, N, N, S), (N, N, S, N)),
    Pair("tied_columns", f"SELECT o_orderkey, o_orderstatus AS a, o_orderstatus AS b {_W}",
         f"SELECT o_orderstatus AS b, o_orderkey, o_orderstatus AS a {_W}", (N, S, S), (S, N, S)),
    Pair("ordered_same", _TOP, _TOP, (N, N), (N, N), "c_acctbal DESC, c_custkey", "c_acctbal DESC, c_custkey"),
    Pair("ordered_reversed", _TOP, f"SELECT * FROM ({_TOP}) t ORDER BY c_acctbal ASC, c_custkey DESC",
         (N, N), (N, N), "c_acctbal DESC, c_custkey", "c_acctbal ASC, c_custkey DESC"),
    Pair("ordered_permuted_columns", _TOP,
         "SELECT c_acctbal, c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey",
         (N, N), (N, N), "c_acctbal DESC, c_custkey", "c_acctbal DESC, c_custkey"),
]


# ---------------------------------------------------------------- Spark side

def _run_sql(t: Tables, sql: str) -> DataFrame:
    t.register_views()
    return t.spark.sql(sql)


def pair_entities(t: Tables, pairs) -> tuple[DataFrame, dict[tuple[str, bool], int]]:
    """(id, pos, cells) of the pairs' queries, each text run once however many
    pairs it is in, and the number of each (text, ordered).  Unordered results
    are glued with one SQL UNION ALL (one analysis instead of a chain of
    unions); ordered results get dense positions from their own ORDER BY."""
    t.register_views()
    number: dict[tuple[str, bool], int] = {}
    selects, ordered = [], []
    for p in pairs:
        for sql in (p.gold, p.pred):
            if (sql, p.order_matters) in number:
                continue
            i = number[sql, p.order_matters] = len(number)
            df = t.spark.sql(sql)
            if p.order_matters:
                ordered.append(C.result_rows(df, C.GOLD, {"run": i}, order=[]).drop("side"))
                continue
            view = f"__querylab_result_{i}"
            df.createOrReplaceTempView(view)
            selects.append(f"SELECT {i} AS run, CAST(NULL AS BIGINT) AS pos, {C.cells_sql(df.schema)} AS cells FROM {view}")
    out = t.spark.sql("\nUNION ALL\n".join(selects)) if selects else None
    for x in ordered:
        out = x if out is None else out.unionByName(x)
    # Several stages read the results: written once in the shared folder.
    return saved(C.entity_rows(out, "run"), "results"), number


def compare_pairs(t: Tables, pairs=PAIRS, verdicts=C.VERDICTS) -> DataFrame:
    """Verdicts per pair."""
    rows, number = pair_entities(t, pairs)
    links = t.spark.createDataFrame([((p.name,), *(((number[sql, p.order_matters],)) for sql in (p.gold, p.pred))) for p in pairs],
                                    "key struct<pair: string>, gold struct<run: int>, pred struct<run: int>")
    return C.compare_links(rows, links, verdicts).drop("gold", "pred").select("key.*", "*").drop("key")


# ---------------------------------------------------------------- oracle side

def _canon(x: str, cls: str) -> str:
    if cls == N:
        return f"('n|' || CAST(CAST({x} AS DOUBLE) + 0.0 AS VARCHAR))"
    if cls == T:
        return f"('t|' || CAST({x} AS VARCHAR))"
    return f"('s|' || {x})"


def _canon_select(sql: str, types, perm=None, order: str | None = None, extra: str = "") -> str:
    cols = [f"c{i}" for i in range(len(types))]
    idx = perm if perm is not None else range(len(types))
    body = ", ".join(f"{_canon(cols[j], types[j])} AS k{n}" for n, j in enumerate(idx))
    pos = f", ROW_NUMBER() OVER (ORDER BY {order}) AS pos" if order else ""
    # Rename output columns positionally so any SQL can be wrapped.
    return f"SELECT {body}{pos}{extra} FROM (SELECT * FROM ({sql}) q0({', '.join(cols)})) q1"


def _bag_eq(a: str, b: str) -> str:
    return (f"(NOT EXISTS (SELECT * FROM ({a} EXCEPT ALL {b}) x) AND "
            f"NOT EXISTS (SELECT * FROM ({b} EXCEPT ALL {a}) y))")


def _pair_oracle(p: Pair, gold_cols: list[str], pred_cols: list[str]) -> str:
    kg, kp = len(p.gold_types), len(p.pred_types)
    ng, np_ = f"(SELECT COUNT(*) FROM ({p.gold}) g)", f"(SELECT COUNT(*) FROM ({p.pred}) p)"
    eqs, direct, quick = [], "FALSE", "FALSE"
    if kg == kp:
        def side(sql, types, perm, order, cols):
            if not p.order_matters:
                return _canon_select(sql, types, perm)
            o = ", ".join(f"c{cols.index(w.split()[0])}" + (" " + " ".join(w.split()[1:]) if len(w.split()) > 1 else "")
                          for w in order.split(", "))
            return _canon_select(sql, types, perm, o)
        g = side(p.gold, p.gold_types, None, p.gold_order, gold_cols)
        for perm in permutations(range(kp)):
            if any(p.pred_types[j] != p.gold_types[i] for i, j in enumerate(perm)):
                eqs.append("FALSE")   # a number never equals a string
                continue
            eqs.append(_bag_eq(g, side(p.pred, p.pred_types, list(perm), p.pred_order, pred_cols)))
        direct = eqs[0]
        # quick reject: (sequence or set of) rows with cells sorted
        def urow(sql, types, order, cols):
            inner = side(sql, types, None, order, cols)
            ks = ", ".join(f"k{i}" for i in range(len(types)))
            if p.order_matters:
                return f"SELECT list_sort([{ks}]) AS u, pos FROM ({inner}) z"
            return f"SELECT DISTINCT list_sort([{ks}]) AS u FROM ({inner}) z"
        ug, up = urow(p.gold, p.gold_types, p.gold_order, gold_cols), urow(p.pred, p.pred_types, p.pred_order, pred_cols)
        quick = _bag_eq(ug, up)
    equal = " OR ".join(eqs) if eqs else "FALSE"
    partial = "FALSE"
    if kp > kg:
        g = _canon_select(p.gold, p.gold_types)
        projs = []
        for sub in combinations(range(kp), kg):
            if any(p.pred_types[j] != p.gold_types[i] for i, j in enumerate(sub)):
                continue
            projs.append(_canon_select(p.pred, p.pred_types, list(sub)))
        if projs:
            partial = f"({ng} > 0 AND NOT EXISTS (SELECT * FROM ({g} EXCEPT ({' UNION '.join(projs)})) w))"
    shaped = f"({ng} = {np_} AND {kg} = {kp})"
    return f"""SELECT '{p.name}' AS pair, {ng} AS n_gold, {np_} AS n_pred,
  CASE WHEN {ng} = 0 THEN 0 ELSE {kg} END AS arity_gold,
  CASE WHEN {np_} = 0 THEN 0 ELSE {kp} END AS arity_pred,
  (({ng} = 0 AND {np_} = 0) OR ({shaped} AND {direct})) AS direct_equal,
  (({ng} = 0 AND {np_} = 0) OR ({shaped} AND {quick})) AS quick_ok,
  (({ng} = 0 AND {np_} = 0) OR ({shaped} AND ({equal}))) AS equal,
  {partial} AS partial"""


def _cols(sql: str) -> list[str]:
    head = sql.split(" FROM ")[0].replace("SELECT ", "", 1)
    if head.strip() == "*":
        return ["c_custkey", "c_acctbal"]
    out = []
    for part in head.split(", "):
        out.append(part.split(" AS ")[-1].strip())
    return out


def pairs_oracle_sql(pairs=PAIRS) -> str:
    return "\nUNION ALL\n".join(_pair_oracle(p, _cols(p.gold), _cols(p.pred)) for p in pairs)


_ALL_COLS = ["pair", "n_gold", "n_pred", "arity_gold", "arity_pred", "direct_equal", "quick_ok", "equal", "partial"]
_ORACLE = pairs_oracle_sql()


def _proj(cols):
    return "SELECT " + ", ".join(cols) + f" FROM ({_ORACLE}) o"


@query("E1_bag_equality", _proj(["pair", "n_gold", "n_pred", "direct_equal"]), ids=("E-1", "U-6"))
def e1(t: Tables) -> DataFrame:
    """Multiset equality of each (gold, pred) result pair as they stand."""
    return compare_pairs(t, verdicts=["direct_equal"]).select("pair", "n_gold", "n_pred", "direct_equal")


@query("E2_ordered_equality", _proj(["pair", "equal"]) + " WHERE pair LIKE 'ordered%'", ids=("E-2",))
def e2(t: Tables) -> DataFrame:
    """Ordered equality when the gold query has ORDER BY (positions from a
    distributed dense numbering of the sorted result)."""
    ordered = [p for p in PAIRS if p.order_matters]
    return compare_pairs(t, ordered, ["equal"]).select("pair", "equal")


@query("E3_quick_reject", _proj(["pair", "arity_gold", "arity_pred", "quick_ok"]), ids=("E-3",))
def e3(t: Tables) -> DataFrame:
    return compare_pairs(t, verdicts=["quick_ok"]).select("pair", "arity_gold", "arity_pred", "quick_ok")


@query("E4_result_eq_with_permutations", _proj(_ALL_COLS), ids=("E-4", "E-1", "E-2", "E-3", "E-5"))
def e4(t: Tables) -> DataFrame:
    """Full ``result_eq``: cheap rejects, then column permutations pruned by
    per-column multiset signatures, verified as bags or sequences."""
    return compare_pairs(t).select(*_ALL_COLS)


@query("E5_partial_answers", _proj(["pair", "partial"]), ids=("E-5",))
def e5(t: Tables) -> DataFrame:
    return compare_pairs(t, verdicts=["partial"]).select("pair", "partial")


# ------------------------------------------------- E-6 .. E-8 test suites

# Each "database" is one event_type partition of events; a query runs over
# all databases at once with the database as a key column.
SUITE_GOLD = "SELECT event_type AS db, user_id, COUNT(*) AS n FROM events GROUP BY event_type, user_id"
SUITE_PREDS = [
    ("same_count", "A", "SELECT event_type AS db, user_id, COUNT(event_id) AS n FROM events GROUP BY event_type, user_id"),
    ("swapped_columns", "A", "SELECT event_type AS db, COUNT(*) AS n, user_id FROM events GROUP BY event_type, user_id"),
    ("drops_rows_in_one_db", "B", "SELECT event_type AS db, user_id, COUNT(*) AS n FROM events "
     "WHERE NOT (event_type = 'error' AND value > 400) GROUP BY event_type, user_id"),
    ("wrong_measure", "B", "SELECT event_type AS db, user_id, SUM(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS n "
     "FROM events GROUP BY event_type, user_id"),
    ("missing_db", "C", "SELECT event_type AS db, user_id, COUNT(*) AS n FROM events WHERE event_type <> 'view' "
     "GROUP BY event_type, user_id"),
    ("not_found", "C", None),
]


def suite_per_db(t: Tables, preds=SUITE_PREDS) -> DataFrame:
    """Equality verdict per (pair, database).  The gold query is run, digested
    and coloured once, whatever the number of predictions."""
    t.register_views()
    known = [(name, sql) for name, _, sql in preds if sql is not None]
    parts = [C.result_rows(t.spark.sql(sql), C.GOLD, {"query": name}, key_cols=["db"]) for name, sql in [("gold", SUITE_GOLD), *known]]
    rows = saved(C.entity_rows(reduce(DataFrame.unionByName, parts), "query", "db"), "results")
    names = t.spark.createDataFrame([(name,) for name, _ in known], "pair string")
    # A database counts for a prediction if either query has rows on it.
    dbs = rows.select("id.query", "id.db").distinct()
    of_gold = dbs.filter(F.col("query") == "gold").select("db").join(F.broadcast(names))  # the names are listed above
    links = of_gold.select("pair", "db").unionByName(dbs.filter(F.col("query") != "gold").withColumnRenamed("query", "pair")).distinct()
    links = links.select(F.struct("pair", "db").alias("key"), F.struct(F.lit("gold").alias("query"), "db").alias("gold"),
                         F.struct(F.col("pair").alias("query"), "db").alias("pred"))
    return C.compare_links(rows, saved(links, "links"), verdicts=["equal"]).select("key.*", "equal")


def suite_pairs(t: Tables, preds=SUITE_PREDS) -> DataFrame:
    return t.spark.createDataFrame([(n, m, "ok" if s else "notfound") for n, m, s in preds],
                                   "pair string, model string, status string")


def suite_verdicts(t: Tables, preds=SUITE_PREDS) -> DataFrame:
    """E-6: pass only when equal on every database; 'Not Found' scores 0."""
    per_pair = C.test_suite_verdict(suite_per_db(t, preds), ["pair"])
    return (suite_pairs(t, preds).join(per_pair, "pair", "left")
            .select("pair", "model",
                    (F.coalesce("exec_pass", F.lit(False)) & (F.col("status") == "ok")).alias("exec_pass"),
                    F.coalesce("n_dbs", F.lit(0)).cast("bigint").alias("n_dbs"),
                    F.coalesce("n_failed_dbs", F.lit(0)).cast("bigint").alias("n_failed_dbs")))


def _suite_oracle() -> str:
    def canon(sql, order):
        cols = ", ".join(f"CAST({c} AS DOUBLE) AS k{i}" for i, c in enumerate(order))
        return f"SELECT db, {cols} FROM ({sql}) s"
    gold = canon(SUITE_GOLD, ["user_id", "n"])
    rows = []
    for name, model, sql in SUITE_PREDS:
        if sql is None:
            rows.append(f"SELECT '{name}' AS pair, '{model}' AS model, FALSE AS exec_pass, 0 AS n_dbs, 0 AS n_failed_dbs")
            continue
        head = sql.split(" FROM ")[0]
        outs = [c.strip().split(" AS ")[-1] for c in head.replace("SELECT ", "", 1).split(", ")][1:]
        renamed = f"SELECT db, {outs[0]} AS a, {outs[1]} AS b FROM ({sql}) q"
        perms = []
        for order in (["a", "b"], ["b", "a"]):
            p = canon(renamed, order)
            perms.append(f"(SELECT db, COUNT(*) AS mm FROM (({gold} EXCEPT ALL {p}) UNION ALL ({p} EXCEPT ALL {gold})) d "
                         f"GROUP BY db)")
        dbs = f"(SELECT db FROM ({SUITE_GOLD}) x UNION SELECT db FROM ({sql}) y)"
        per_db = (f"SELECT dbs.db, (COALESCE(p0.mm, 0) = 0 OR COALESCE(p1.mm, 0) = 0) AS eq FROM {dbs} dbs "
                  f"LEFT JOIN {perms[0]} p0 ON dbs.db = p0.db LEFT JOIN {perms[1]} p1 ON dbs.db = p1.db")
        rows.append(f"SELECT '{name}' AS pair, '{model}' AS model, BOOL_AND(eq) AS exec_pass, COUNT(*) AS n_dbs, "
                    f"COUNT_IF(NOT eq) AS n_failed_dbs FROM ({per_db}) v")
    return "\nUNION ALL\n".join(rows)


_SUITE_SQL = _suite_oracle()


@query("E6_test_suite_verdicts", _SUITE_SQL, ids=("E-6",))
def e6(t: Tables) -> DataFrame:
    """Predictions compared with the gold query on every database (event
    type); one failing database, an execution error or 'Not Found' fails."""
    return suite_verdicts(t)


@query("E7_accuracy_by_model", f"SELECT COALESCE(model, 'all') AS model, COUNT(*) AS n, COUNT_IF(exec_pass) AS n_pass, "
       f"AVG(CAST(exec_pass AS DOUBLE)) AS acc FROM ({_SUITE_SQL}) v GROUP BY ROLLUP (model)", ids=("E-7",))
def e7(t: Tables) -> DataFrame:
    acc = C.accuracy(suite_verdicts(t), ["model"])
    return acc.select(F.coalesce("model", F.lit("all")).alias("model"), "n", "n_pass", "acc")


@query("E8_cached_verdicts", f"SELECT pair, exec_pass, model = 'A' AS from_cache FROM ({_SUITE_SQL}) v", ids=("E-8",))
def e8(t: Tables) -> DataFrame:
    """Verdicts of model A's pairs come from a cache table written by an
    earlier run (parquet in the shared checkpoint folder); only the misses
    are executed."""
    from querylab.session import scratch_path
    import uuid
    cached_preds = [p for p in SUITE_PREDS if p[1] == "A"]
    path = scratch_path(t.spark, f"verdict-cache-{uuid.uuid4().hex}")
    suite_verdicts(t, cached_preds).select("pair", "exec_pass").write.mode("overwrite").parquet(path)
    cache = t.spark.read.parquet(path)
    pairs = suite_pairs(t).select("pair")

    def compute(missing: DataFrame) -> DataFrame:
        # The missing pair names are a handful of query ids; each one is a
        # query to execute, so the list is taken to the driver.
        names = {r["pair"] for r in missing.select("pair").collect()}
        todo = [p for p in SUITE_PREDS if p[0] in names]
        return suite_verdicts(t, todo).select("pair", "exec_pass")

    return C.with_cached_verdicts(pairs, cache, ["pair"], compute).select("pair", "exec_pass", "from_cache")
