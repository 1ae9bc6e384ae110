"""Workload analytics (C family) over the derived workload view.

Spark derives every count from the SQL *text* (regex Column expressions);
the DuckDB oracle derives the same counts from the generator's parameters
(``truth_sql``), so each query checks the text analysis independently.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylab.operators import workload as WL
from querylab.plans.registry import query
from querylab.session import scratch_path
from querylab.sources import workload as W
from querylab.tables import TABLE_NAMES, Tables

TRUTH = f"WITH t AS ({W.truth_sql()})\n"
WORK = f"WITH w AS ({W.workload_sql()})\n"
TRUTH_WORK = f"WITH t AS ({W.truth_sql()}),\nw AS ({W.workload_sql()})\n"


def featured(t: Tables) -> DataFrame:
    """Workload view + gold-query features, components and hardness."""
    return WL.with_hardness(W.workload_table(t.spark, t.sf_dir), "gold_sql")


_C1 = ["n_select", "n_agg_select", "n_tables", "n_where_conds", "n_or", "n_like", "n_not", "n_group",
       "has_having", "n_order", "has_limit", "set_op"]


@query("C1_clause_features", TRUTH + "SELECT query_id, " + ", ".join(_C1) + ", n_nested FROM t", ids=("C-1",))
def c1(t: Tables) -> DataFrame:
    f = WL.clause_features(W.workload_table(t.spark, t.sf_dir), "gold_sql")
    nested = F.col("n_nested_where") + (F.col("set_op") != "none").cast("int")
    return f.select("query_id", *_C1, nested.alias("n_nested"))


@query("C2_component_counts", TRUTH + "SELECT query_id, comp1, comp2, others FROM t", ids=("C-2",))
def c2(t: Tables) -> DataFrame:
    return featured(t).select("query_id", "comp1", "comp2", "others")


@query("C3_hardness", TRUTH + "SELECT query_id, db_id, hardness FROM t", ids=("C-3",))
def c3(t: Tables) -> DataFrame:
    return featured(t).select("query_id", "db_id", "hardness")


_PROFILE_SQL = ("SELECT db_id, " + ", ".join(f"COUNT_IF(hardness = '{lv}') AS {lv}" for lv in WL.LEVELS) + ", "
                + ", ".join(f"COUNT_IF(n_tables = {k}) AS table_{k}" for k in range(1, 8))
                + ", COUNT_IF(n_tables < 1 OR n_tables > 7) AS table_other, COUNT_IF(comp2 > 0) AS nested, COUNT(*) AS \"all\" FROM t GROUP BY db_id")


@query("C4_db_profile", TRUTH + _PROFILE_SQL, ids=("C-4",))
def c4(t: Tables) -> DataFrame:
    return WL.db_profile(featured(t))


_TOTAL_COLS = list(WL.LEVELS) + [f"table_{k}" for k in range(1, 8)] + ["table_other", "nested", "all"]


@query("C5_profile_totals", TRUTH + f"SELECT COUNT(*) AS n_dbs, "
       + ", ".join(f"CAST(SUM(\"{c}\") AS BIGINT) AS total_{c}" for c in _TOTAL_COLS)
       + f", SUM(\"all\") / COUNT(*) AS mean_per_db FROM ({_PROFILE_SQL}) p", ids=("C-5",))
def c5(t: Tables) -> DataFrame:
    return WL.profile_totals(WL.db_profile(featured(t)))


_HIST_DIMS = {
    "select_items": "n_select", "from_tables": "n_tables", "from_subquery": "0", "group_items": "n_group",
    "order_items": "n_order", "having_conds": "n_having_conds", "limit": "has_limit",
}
_HIST_SQL = (TRUTH + "SELECT clause, value, n, FLOOR((n * 2000 + tot) / (2 * tot)) / 1000.0 AS share FROM ("
             "SELECT clause, value, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY clause) AS tot FROM ("
             + " UNION ALL ".join(f"SELECT '{k}' AS clause, CAST({v} AS INT) AS value FROM t" for k, v in _HIST_DIMS.items())
             + ") s GROUP BY clause, value) c")


@query("C6_clause_histograms", _HIST_SQL, ids=("C-6",))
def c6(t: Tables) -> DataFrame:
    return WL.clause_histograms(featured(t))


_CATS = {
    "logical_op": "w_kind IN (4, 5)", "between": "w_kind = 6", "in": "w_kind = 10", "like": "w_kind = 7",
    "in_subquery": "w_kind = 8", "comparison_subquery": "w_kind = 11", "exists": "w_kind = 9",
    "null": "w_kind = 2", "none": "w_kind IN (0, 1)",
}


@query("C7_where_categories", TRUTH + " UNION ALL ".join(
    f"SELECT '{k}' AS category, COUNT_IF({v}) AS n FROM t" for k, v in _CATS.items()), ids=("C-7",))
def c7(t: Tables) -> DataFrame:
    return WL.where_categories(featured(t))


_ERR_SQL = ("CASE WHEN s_kind = 0 AND g_kind >= 4 THEN 'select * with group by' "
            "WHEN o_kind = 8 AND g_kind < 4 AND s_kind IN (0, 1, 2, 5) THEN 'aggregate in order by without group by' "
            "ELSE NULL END")


@query("C8_validity_split", TRUTH + f"SELECT db_id, COALESCE({_ERR_SQL}, 'ok') AS status, COUNT(*) AS n "
       "FROM t GROUP BY ALL", ids=("C-8",))
def c8(t: Tables) -> DataFrame:
    """Valid and quarantined rows per database, written to their two sinks in
    one pass and read back."""
    rows = WL.validity(featured(t), "gold_sql").select("db_id", "query_id", "gold_sql", "error")
    valid, quarantined, _ = WL.write_split(rows, scratch_path(t.spark, f"split-{uuid.uuid4().hex}"))
    both = valid.select("db_id", F.lit("ok").alias("status")).unionByName(quarantined.select("db_id", F.col("error").alias("status")))
    return both.groupBy("db_id", "status").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------- templates

def catalog_names(t: Tables) -> tuple[list[str], list[str]]:
    """Table and column names of the catalog (the driver tables' schemas)."""
    cols = sorted({f.name for n in TABLE_NAMES for f in t.table(n).schema.fields})
    return list(TABLE_NAMES), cols


# Column names of the driver tables (used only by the oracle).
_DRIVER_COLUMNS = sorted(set("""
r_regionkey r_name n_nationkey n_name n_regionkey c_custkey c_name c_nationkey c_acctbal c_mktsegment
s_suppkey s_name s_nationkey s_acctbal p_partkey p_name p_brand p_type p_size p_retailprice
o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority
l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus
l_shipdate event_id ts user_id event_type value props doc_id text lang source n_chars vec_id embedding label
page_id url html item_id quality toxic conv_id turn role
""".split()))


def _alt(names) -> str:
    return "|".join(sorted(names, key=lambda s: (-len(s), s)))


def _template_sql(x: str) -> str:
    # the workload's literals only: a pattern of the oracle's own
    lit = r"''[^'']*''|\b[0-9]+\b"
    s = f"regexp_replace({x}, '{lit}', '#VALUE#', 'g')"
    s = f"regexp_replace({s}, '(?i)\\s+as\\s+\\w+', '', 'g')"
    s = f"regexp_replace({s}, '\\b\\w+\\.(\\w+)', '\\1', 'g')"
    s = f"regexp_replace({s}, '(?i)\\b(?:{_alt(_DRIVER_COLUMNS)})\\b', '#COLUMN#', 'g')"
    s = f"regexp_replace({s}, '(?i)\\b(?:{_alt(TABLE_NAMES)})\\b', '#TABLE#', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def _template_col(t: Tables, col: str = "gold_sql"):
    tables, cols = catalog_names(t)
    tables = sorted(tables, key=lambda s: (-len(s), s))
    cols = sorted(cols, key=lambda s: (-len(s), s))
    return WL.template(F.col(col), tables, cols)


@query("C9_templates", WORK + f"SELECT query_id, {_template_sql('gold_sql')} AS template FROM w", ids=("C-9",))
def c9(t: Tables) -> DataFrame:
    return W.workload_table(t.spark, t.sf_dir).select("query_id", _template_col(t).alias("template"))


@query("C10_template_dedup", WORK + f"SELECT db_id, template, MIN(query_id) AS query_id FROM ("
       f"SELECT db_id, query_id, {_template_sql('gold_sql')} AS template FROM w) x GROUP BY db_id, template",
       ids=("C-10",))
def c10(t: Tables) -> DataFrame:
    w = W.workload_table(t.spark, t.sf_dir).select("db_id", "query_id", _template_col(t).alias("template"))
    return WL.first_per_key(w, ["db_id", "template"], "query_id").select("db_id", "template", "query_id")


_SPEC = ["db_id", "n_select", "n_tables", "n_where_conds", "n_group", "n_order", "has_limit", "set_op"]


@query("C11_spec_dedup", TRUTH + f"SELECT MIN(query_id) AS first_query_id, COUNT(*) AS n_copies FROM t "
       f"GROUP BY {', '.join(_SPEC)}", ids=("C-11",))
def c11(t: Tables) -> DataFrame:
    """Dedup by SHA-1 of the key-sorted JSON of the spec columns; keep the
    first query and the number of copies."""
    f = featured(t).withColumn("spec", WL.spec_hash(_SPEC))
    return f.groupBy("spec").agg(F.min("query_id").alias("first_query_id"),
                                 F.count(F.lit(1)).alias("n_copies")).drop("spec")


@query("C12_merge_and_split", WORK + "SELECT db_id, query_id, gold_sql AS query FROM w", ids=("C-12",))
def c12(t: Tables) -> DataFrame:
    """Queries of one key merged with a blank line, then split back: the
    round trip must give every query once."""
    w = W.workload_table(t.spark, t.sf_dir)
    merged = WL.merge_queries(w, ["db_id"], "query_id", "gold_sql")
    return WL.split_queries(merged, ["db_id"])


# Per-level quota of the back-translation sampler.
QUOTA = {"easy": 7, "medium": 13, "hard": 5, "extra": 5}


@query("C13_quota_fill", TRUTH + "SELECT db_id, hardness, query_id FROM ("
       "SELECT db_id, hardness, query_id, ROW_NUMBER() OVER (PARTITION BY db_id, hardness ORDER BY query_id) AS rn "
       "FROM t) r JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in QUOTA.items())
       + ") q(level, quota) ON r.hardness = q.level WHERE rn <= quota", ids=("C-13",))
def c13(t: Tables) -> DataFrame:
    quota = t.spark.createDataFrame(list(QUOTA.items()), "hardness string, quota int")
    kept = WL.fill_quota(featured(t), quota, ["db_id"], "hardness", [F.col("query_id")])
    return kept.select("db_id", "hardness", "query_id")


_HASH_SQL = "md5(doc_id::VARCHAR)"


@query("C14_stratified_sample", f"SELECT source, doc_id FROM (SELECT source, doc_id, ROW_NUMBER() OVER "
       f"(PARTITION BY source ORDER BY {_HASH_SQL}, doc_id) AS rn FROM documents) s WHERE rn <= 5", ids=("C-14",))
def c14(t: Tables) -> DataFrame:
    """Five documents per source in a deterministic pseudo-random order."""
    d = t.documents.select("source", "doc_id")
    return WL.first_k_per_group(d, ["source"], [WL.hash_order("doc_id"), F.col("doc_id")], 5).select("source", "doc_id")


_W15 = "CAST(CAST(c_acctbal AS DECIMAL(15,2)) * 100 AS BIGINT) + 100000"
_C15_SQL = f"""
WITH cats AS (
  SELECT n_nationkey, SUM({_W15}) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE n_regionkey <> 0 GROUP BY n_nationkey),
iv AS (SELECT n_nationkey, COALESCE(SUM(w) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
              w FROM cats WHERE w > 0),
tot AS (SELECT SUM(w) AS total FROM iv),
d AS (SELECT o_orderkey, CAST('0x' || substr(md5(o_orderkey::VARCHAR), 1, 15) AS BIGINT) % (SELECT total FROM tot) AS r FROM orders)
SELECT n_nationkey, COUNT(*) AS n_draws FROM d JOIN iv ON d.r >= iv.lo AND d.r < iv.lo + iv.w GROUP BY n_nationkey
"""


@query("C15_weighted_sampling", _C15_SQL, ids=("C-15",))
def c15(t: Tables) -> DataFrame:
    """One weighted pick (with replacement) per order among the allowed
    nations (region 0 excluded, weights renormalised by construction)."""
    w = (F.col("c_acctbal").cast("decimal(15,2)") * 100).cast("bigint") + 100000
    cats = (t.customer.join(t.nation.filter(F.col("n_regionkey") != 0), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_nationkey").agg(F.sum(w).alias("w")))
    picks = WL.weighted_draws(cats, "n_nationkey", "w", t.orders.select("o_orderkey"), "o_orderkey")
    return picks.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n_draws"))


@query("C19_method_table_share", TRUTH_WORK + "SELECT method, n_tables, n, FLOOR((n * 2000 + tot) / (2 * tot)) / 10.0 AS pct "
       "FROM (SELECT method, n_tables, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY method) AS tot "
       "FROM t JOIN w USING (query_id) GROUP BY method, n_tables) c", ids=("C-19",))
def c19(t: Tables) -> DataFrame:
    """Share (percent) of each table count per generation method."""
    return WL.share_by(featured(t), "method", "n_tables")


@query("C20_refinement_summary", TRUTH_WORK + "SELECT 'attempt_' || CAST(attempt AS VARCHAR) AS outcome, COUNT(*) AS n "
       f"FROM t JOIN w USING (query_id) WHERE ({_ERR_SQL}) IS NULL GROUP BY attempt "
       f"UNION ALL SELECT 'still_bad', COUNT_IF(({_ERR_SQL}) IS NOT NULL) FROM t "
       "UNION ALL SELECT 'total', COUNT(*) FROM t", ids=("C-20",))
def c20(t: Tables) -> DataFrame:
    """Rows that became valid at each refinement attempt, still-bad rows, total."""
    v = WL.validity(featured(t), "gold_sql").withColumn("ok", F.col("error").isNull())
    return WL.refinement_summary(v, "attempt", "ok")


# ------------------------------------------------------------- C-18

_SPEC_COLS = ["event_id AS spec_id", "CAST(event_id % 3 AS INT) AS shape", "CAST(user_id % 3 AS INT) AS select_kind",
              "CAST(event_id % 4 AS INT) AS where_kind", "user_id AS value", "(event_id * 2654435761) % 1000003 AS h"]


def _c18_sql() -> str:
    from querylab.plans.catalog import _COLS_SQL, _FK_SQL
    return f"""WITH {_COLS_SQL}, {_FK_SQL},
tabs AS (SELECT "table", COUNT_IF(type = 'number') AS n_number, COUNT_IF(type = 'text') AS n_text,
                ROW_NUMBER() OVER (ORDER BY "table") - 1 AS t_idx FROM cols GROUP BY "table"),
num AS (SELECT "table", "column" AS num_col, ROW_NUMBER() OVER (PARTITION BY "table" ORDER BY "column") - 1 AS n_idx
        FROM cols WHERE type = 'number'),
txt AS (SELECT "table", "column" AS text_col, ROW_NUMBER() OVER (PARTITION BY "table" ORDER BY "column") - 1 AS x_idx
        FROM cols WHERE type = 'text'),
edges AS (SELECT *, ROW_NUMBER() OVER (ORDER BY table1, column1, table2, column2) - 1 AS e_idx FROM fks),
sp AS (SELECT {', '.join(_SPEC_COLS)} FROM events),
s AS (SELECT sp.*, tb."table", num.num_col, txt.text_col, e.table1, e.column1, e.table2, e.column2
      FROM sp JOIN tabs tb ON tb.t_idx = sp.h % (SELECT COUNT(*) FROM tabs)
      LEFT JOIN num ON num."table" = tb."table" AND tb.n_number > 0 AND num.n_idx = sp.h % NULLIF(tb.n_number, 0)
      LEFT JOIN txt ON txt."table" = tb."table" AND tb.n_text > 0 AND txt.x_idx = sp.h % NULLIF(tb.n_text, 0)
      LEFT JOIN edges e ON e.e_idx = sp.h % (SELECT COUNT(*) FROM edges))
SELECT spec_id, CASE WHEN shape = 2 THEN 'SELECT COUNT(*) FROM ' || table1 || ' JOIN ' || table2 || ' ON ' ||
    table1 || '.' || column1 || ' = ' || table2 || '.' || column2
  ELSE (CASE WHEN select_kind = 1 AND num_col IS NOT NULL THEN 'SELECT ' || num_col
             WHEN select_kind = 2 THEN 'SELECT COUNT(*)' ELSE 'SELECT *' END) || ' FROM ' || "table" ||
       (CASE WHEN where_kind = 1 AND num_col IS NOT NULL THEN ' WHERE ' || num_col || ' > ' || CAST(value AS VARCHAR)
             WHEN where_kind = 2 AND text_col IS NOT NULL THEN ' WHERE ' || text_col || ' LIKE ''a%'''
             WHEN where_kind = 3 AND num_col IS NOT NULL THEN ' WHERE ' || num_col || ' BETWEEN ' ||
                  CAST(value AS VARCHAR) || ' AND ' || CAST(value + 100 AS VARCHAR) ELSE '' END) END AS sql
FROM s"""


@query("C18_render_from_catalog", _c18_sql(), ids=("C-18",))
def c18(t: Tables) -> DataFrame:
    """SQL text rendered from one spec per event against the catalog of the
    driver tables (single-table and FK-join shapes)."""
    from querylab.operators import catalog as K
    from querylab.plans import catalog as KP
    cat = KP.catalog(t)
    cols = K.columns_relation(cat).select("table", "column", "type")
    fks = K.foreign_keys(cat).select("table1", "column1", "table2", "column2")
    specs = t.events.selectExpr(*_SPEC_COLS)
    return WL.render_from_catalog(specs, cols, fks)
