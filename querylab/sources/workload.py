"""Derived workload view: a table of SQL text built from ``events``.

The driver tables hold no SQL text, so the workload (query-log) operators run
on a view where every ``events`` row becomes one gold query and one predicted
query.  The text is assembled from integer columns only (clause shapes from
``event_id`` moduli, literals from ``user_id``), with expressions that Spark
SQL and DuckDB evaluate identically, so both engines build byte-identical
text.  The predicted query is the same generator with perturbed parameters.

Because the shape parameters are known, the oracle can derive the clause
counts straight from the moduli (:func:`truth_sql`) while Spark re-derives
them from the text with regular expressions: an independent check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ----------------------------------------------------------------- shapes
# Each parameter is an integer SQL expression over event_id / user_id.

SHAPE_PARAMS = {
    "s": "event_id % 6",    # select list
    "j": "event_id % 5",    # FROM: 1, 2 or 3 tables
    "w": "event_id % 12",   # WHERE kind
    "g": "event_id % 7",    # GROUP BY / HAVING kind
    "o": "event_id % 13",   # ORDER BY / LIMIT kind
    "x": "event_id % 17",   # set operation
    "L": "user_id",         # literal source
}

SELECTS = [
    "SELECT *",
    "SELECT o_orderstatus",
    "SELECT o_orderstatus, o_totalprice",
    "SELECT count(*)",
    "SELECT max(o_totalprice), min(o_totalprice)",
    "SELECT DISTINCT o_orderstatus",
]

FROMS = [
    " FROM orders", " FROM orders", " FROM orders",
    " FROM orders JOIN customer ON o_custkey = c_custkey",
    " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
]


def _lit(expr: str, dialect: str) -> str:
    return f"CAST({expr} AS STRING)" if dialect == "spark" else f"CAST({expr} AS VARCHAR)"


def _where(p: dict, d: str) -> list[tuple[int, str]]:
    L = p["L"]
    v100 = _lit(f"({L}) * 100", d)
    return [
        (0, "''"), (1, "''"),
        (2, "' WHERE o_orderdate IS NOT NULL'"),
        (3, f"concat(' WHERE o_totalprice > ', {v100})"),
        (4, f"concat(' WHERE o_totalprice > ', {v100}, ' AND o_orderstatus = ''F''')"),
        (5, f"concat(' WHERE o_totalprice > ', {v100}, ' OR o_orderstatus = ''F''')"),
        (6, f"concat(' WHERE o_totalprice BETWEEN ', {_lit(L, d)}, ' AND ', {_lit(f'({L}) + 1000', d)})"),
        (7, f"concat(' WHERE o_orderpriority LIKE ''%', {_lit(f'({L}) % 5 + 1', d)}, '%''')"),
        (8, f"concat(' WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > ', {_lit(L, d)}, ')')"),
        (9, "' WHERE EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey)'"),
        (10, "' WHERE o_orderstatus NOT IN (''P'', ''O'')'"),
        (11, "' WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)'"),
    ]


def _group(p: dict, d: str) -> list[tuple[int, str]]:
    L = p["L"]
    return [
        (0, "''"), (1, "''"), (2, "''"), (3, "''"),
        (4, "' GROUP BY o_orderstatus'"),
        (5, f"concat(' GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > ', {_lit(f'({L}) % 7', d)})"),
        (6, f"concat(' GROUP BY o_orderstatus HAVING count(*) > ', {_lit(f'({L}) % 3', d)}, "
            f"' AND max(o_totalprice) > 1000')"),
    ]


def _order(p: dict, d: str) -> list[tuple[int, str]]:
    L = p["L"]
    return [(i, "''") for i in range(8)] + [
        (8, "' ORDER BY count(*) DESC'"),
        (9, "' ORDER BY o_totalprice DESC'"),
        (10, f"concat(' ORDER BY o_totalprice DESC LIMIT ', {_lit(f'({L}) % 10 + 1', d)})"),
        (11, "' ORDER BY o_orderstatus, o_totalprice'"),
        (12, "' LIMIT 5'"),
    ]


def _setop() -> list[tuple[int, str]]:
    return [(0, "' UNION SELECT c_name FROM customer'"),
            (1, "' INTERSECT SELECT c_name FROM customer'"),
            (2, "' EXCEPT SELECT c_name FROM customer'")]


def _case(param: str, options: list[tuple[int, str]], default: str = "''") -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in options)
    return f"CASE ({param}) {whens} ELSE {default} END"


def query_text_sql(p: dict, dialect: str) -> str:
    """SQL expression producing the query text for parameter expressions ``p``."""
    sel = _case(p["s"], [(i, "'" + s.replace("'", "''") + "'") for i, s in enumerate(SELECTS)])
    frm = _case(p["j"], [(i, "'" + s + "'") for i, s in enumerate(FROMS)])
    return ("concat(" + ", ".join([sel, frm, _case(p["w"], _where(p, dialect)), _case(p["g"], _group(p, dialect)),
                                   _case(p["o"], _order(p, dialect)), _case(p["x"], _setop())]) + ")")


# The prediction perturbs one thing, chosen by v = (event_id * 7 + user_id) % 5:
# 0 same query, 1 other literal, 2 no ORDER BY/LIMIT, 3 no WHERE, 4 next select list.
VARIANT = "((event_id * 7 + user_id) % 5)"


# With several models, model m predicts variant (event_id * 7 + user_id + m) % 5.
MODEL_VARIANT = "((event_id * 7 + user_id + model) % 5)"


def pred_params(variant: str = VARIANT) -> dict:
    b = SHAPE_PARAMS
    return {
        "s": f"CASE WHEN {variant} = 4 THEN ({b['s']} + 1) % 6 ELSE {b['s']} END",
        "j": b["j"],
        "w": f"CASE WHEN {variant} = 3 THEN 0 ELSE {b['w']} END",
        "g": b["g"],
        "o": f"CASE WHEN {variant} = 2 THEN 0 ELSE {b['o']} END",
        "x": b["x"],
        "L": f"CASE WHEN {variant} = 1 THEN user_id + 1 ELSE user_id END",
    }


def _idiv(a: str, b: int, dialect: str) -> str:
    return f"({a} DIV {b})" if dialect == "spark" else f"({a} // {b})"


def workload_columns(dialect: str) -> list[str]:
    """Column expressions of the workload view over ``events``."""
    return [
        "event_id AS query_id",
        f"{_idiv('event_id', 6, dialect)} AS session_id",
        "CAST(event_id % 6 + 1 AS INT) AS turn",
        "event_type AS db_id",
        "CAST(event_id % 3 AS INT) AS model",
        f"{query_text_sql(SHAPE_PARAMS, dialect)} AS gold_sql",
        f"{query_text_sql(pred_params(), dialect)} AS pred_sql",
        "CAST(event_id % 4 + 1 AS INT) AS attempt",
        "CAST(event_id % 5 + 2 AS INT) AS iter",
        "((event_id + user_id) % 3 <> 0) AS flag",
        "CAST(event_id % 2 AS INT) AS method",
    ]


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, session_id, turn, db_id, model, gold_sql, pred_sql, attempt,
    iter, flag, method`` for every events row (narrow projection: no shuffle)."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return ev.selectExpr(*workload_columns("spark"))


_MEMO: dict = {}


#: Files that are listed one by one from the driver; more are listed by a Spark job.
LISTED = 256


def file_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of the files of tables (no content is read)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, many = [], []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        if fs.getContentSummary(at).getFileCount() > LISTED:
            many.append(p)
            continue
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    if many:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(many)
        found.append(tuple(f.agg(F.count("*"), F.sum("length"), F.max("modificationTime"),
                                 F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()))
    return tuple(sorted(map(str, found)))


def _memo(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Materialise a table derived from ``events`` once per Spark application
    and state of its files (a reliable checkpoint in the shared folder), so
    the queries that read it do not re-derive it and their plans stay small.
    The rows are dealt evenly as they are written."""
    k = (spark.sparkContext.applicationId, name, sf_dir, file_state(spark, [f"{sf_dir.rstrip('/')}/events.parquet"]))
    if k not in _MEMO:
        _MEMO[k] = build().hint("rebalance").checkpoint(eager=True)
    return _MEMO[k]


def workload_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workload view, materialised once per application."""
    return _memo(spark, sf_dir, "workload", lambda: workload(spark, sf_dir))


def workload_sql() -> str:
    """The same view for DuckDB."""
    return "SELECT " + ",\n  ".join(workload_columns("duckdb")) + "\nFROM events"


N_MODELS = 3


def _multi_columns(dialect: str) -> list[str]:
    return ["event_id AS query_id", "event_type AS db_id", "model",
            f"{query_text_sql(SHAPE_PARAMS, dialect)} AS gold_sql",
            f"{query_text_sql(pred_params(MODEL_VARIANT), dialect)} AS pred_sql"]


def multi_model_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gold query predicted by each of N_MODELS models (one row per
    event and model; the model list is exploded in place, no join)."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    ev = ev.selectExpr("*", f"explode(sequence(0, {N_MODELS - 1})) AS model")
    return ev.selectExpr(*_multi_columns("spark"))


def multi_model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "multi_model", lambda: multi_model_workload(spark, sf_dir))


def multi_model_sql() -> str:
    return ("SELECT " + ",\n  ".join(_multi_columns("duckdb"))
            + f"\nFROM events, (SELECT UNNEST(range({N_MODELS})) AS model) m")


# ------------------------------------------------ ground truth from moduli

def truth_columns(prefix: str = "") -> dict[str, str]:
    """Clause counts of the gold query derived from its parameters (DuckDB
    SQL over ``events``), following the evaluator's counting rules."""
    s, j, w, g, o, x = (SHAPE_PARAMS[k] for k in "sjwgox")
    n_select = f"(CASE WHEN ({s}) IN (2, 4) THEN 2 ELSE 1 END)"
    agg_select = f"(CASE ({s}) WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END)"
    n_tables = f"(CASE ({j}) WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 1 END)"
    has_where = f"(CASE WHEN ({w}) >= 2 THEN 1 ELSE 0 END)"
    where_conds = f"(CASE WHEN ({w}) IN (4, 5) THEN 2 WHEN ({w}) >= 2 THEN 1 ELSE 0 END)"
    n_or = f"(CASE WHEN ({w}) = 5 THEN 1 ELSE 0 END)"
    n_like = f"(CASE WHEN ({w}) = 7 THEN 1 ELSE 0 END)"
    n_not = f"(CASE WHEN ({w}) = 10 THEN 1 ELSE 0 END)"
    nested_where = f"(CASE WHEN ({w}) IN (8, 9, 11) THEN 1 ELSE 0 END)"
    has_group = f"(CASE WHEN ({g}) >= 4 THEN 1 ELSE 0 END)"
    n_group = f"(CASE ({g}) WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END)"
    having_conn = f"(CASE WHEN ({g}) = 6 THEN 1 ELSE 0 END)"
    has_having = f"(CASE WHEN ({g}) IN (5, 6) THEN 1 ELSE 0 END)"
    n_having_conds = f"(CASE ({g}) WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 0 END)"
    has_order = f"(CASE WHEN ({o}) BETWEEN 8 AND 11 THEN 1 ELSE 0 END)"
    n_order = f"(CASE ({o}) WHEN 11 THEN 2 WHEN 8 THEN 1 WHEN 9 THEN 1 WHEN 10 THEN 1 ELSE 0 END)"
    agg_order = f"(CASE WHEN ({o}) = 8 THEN 1 ELSE 0 END)"
    has_limit = f"(CASE WHEN ({o}) IN (10, 12) THEN 1 ELSE 0 END)"
    set_op = f"(CASE ({x}) WHEN 0 THEN 'union' WHEN 1 THEN 'intersect' WHEN 2 THEN 'except' ELSE 'none' END)"
    has_setop = f"(CASE WHEN ({x}) <= 2 THEN 1 ELSE 0 END)"
    comp1 = f"({has_where} + {has_group} + {has_order} + {has_limit} + ({n_tables} - 1) + {n_or} + {n_like})"
    comp2 = f"({nested_where} + {has_setop})"
    agg_count = f"({agg_select} + {n_not} + {agg_order} + {having_conn})"
    others = (f"((CASE WHEN {agg_count} > 1 THEN 1 ELSE 0 END) + (CASE WHEN {n_select} > 1 THEN 1 ELSE 0 END)"
              f" + (CASE WHEN {where_conds} > 1 THEN 1 ELSE 0 END) + (CASE WHEN {n_group} > 1 THEN 1 ELSE 0 END))")
    return {
        "n_select": n_select, "n_agg_select": agg_select, "n_tables": n_tables,
        "n_where_conds": where_conds, "n_or": n_or, "n_like": n_like, "n_not": n_not,
        "n_nested": comp2, "n_group": n_group, "has_having": has_having, "n_order": n_order,
        "has_limit": has_limit, "set_op": set_op, "n_having_conds": n_having_conds,
        "w_kind": f"({w})", "s_kind": f"({s})", "g_kind": f"({g})", "o_kind": f"({o})",
        "comp1": comp1, "comp2": comp2, "others": others,
    }


def hardness_sql(c1: str, c2: str, o: str) -> str:
    return (f"(CASE WHEN {c1} <= 1 AND {o} = 0 AND {c2} = 0 THEN 'easy' "
            f"WHEN ({o} <= 2 AND {c1} <= 1 AND {c2} = 0) OR ({c1} <= 2 AND {o} < 2 AND {c2} = 0) THEN 'medium' "
            f"WHEN ({o} > 2 AND {c1} <= 2 AND {c2} = 0) OR ({c1} > 2 AND {c1} <= 3 AND {o} <= 2 AND {c2} = 0) "
            f"OR ({c1} <= 1 AND {o} = 0 AND {c2} <= 1) THEN 'hard' ELSE 'extra' END)")


def truth_sql() -> str:
    """DuckDB: query_id, db_id + ground-truth features + hardness."""
    t = truth_columns()
    cols = ",\n  ".join(f"{v} AS {k}" for k, v in t.items())
    return (f"SELECT event_id AS query_id, event_type AS db_id,\n  {cols},\n  "
            f"{hardness_sql(t['comp1'], t['comp2'], t['others'])} AS hardness\nFROM events")
