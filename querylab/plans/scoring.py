"""Scoring queries (E-9..E-20, E-22, E-23) over the workload view and the
conversation turns.

For component scores the oracle derives gold/pred totals and 0/1 scores from
the generator parameters (which clause the prediction perturbed), while Spark
compares clause units cut from the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylab.functions import sqltext as X
from querylab.operators import scoring as SC
from querylab.plans.catalog import column_classes
from querylab.plans.registry import query
from querylab.plans.workload import TRUTH, TRUTH_WORK, WORK, _template_col, _template_sql, featured
from querylab.session import saved
from querylab.sources import workload as W
from querylab.tables import Tables

# ------------------------------------------------------------ E-9 .. E-12

# The workload's literals are unsigned integers and single-quoted words: a
# pattern of the oracle's own, not the library's.
_LIT = r"''[^'']*''|\b[0-9]+\b"


@query("E9_cleanup", WORK + """SELECT query_id, array_to_string(list_transform(string_split(pred_sql, ''''),
  lambda p, i: CASE WHEN i % 2 = 1 THEN regexp_replace(regexp_replace(regexp_replace(p,
      '([<>!])\\s+=', '\\1=', 'g'), '(?i)\\bdistinct\\s+', '', 'g'), '(?i)\\bvalue\\b', '1', 'g') ELSE p END),
  '''') AS cleaned FROM w""", ids=("E-9",))
def e9(t: Tables) -> DataFrame:
    w = W.workload_table(t.spark, t.sf_dir)
    return w.select("query_id", SC.cleanup(F.col("pred_sql")).alias("cleaned"))


@query("E10_value_slots", WORK + f"""SELECT query_id,
  array_to_string(regexp_extract_all(pred_sql, '({_LIT})', 1), '|') AS vals,
  regexp_replace(pred_sql, '{_LIT}', '#VALUE#', 'g') AS slotted FROM w""", ids=("E-10",))
def e10(t: Tables) -> DataFrame:
    w = W.workload_table(t.spark, t.sf_dir)
    vals, slotted = SC.value_slots(F.col("pred_sql"))
    return w.select("query_id", F.array_join(vals, "|").alias("vals"), slotted.alias("slotted"))


@query("E11_value_plugin_counts", WORK + f"""SELECT query_id, n_values, n_slots,
  CAST(pow(n_values, n_slots) AS BIGINT) AS n_alternatives FROM (
  SELECT query_id, CAST(len(list_distinct(regexp_extract_all(gold_sql, '({_LIT})', 1))) AS INT) AS n_values,
         CAST(len(regexp_extract_all(pred_sql, '({_LIT})', 1)) AS INT) AS n_slots FROM w) x""", ids=("E-11",))
def e11(t: Tables) -> DataFrame:
    w = W.workload_table(t.spark, t.sf_dir)
    vals, slots, n_alt = SC.plug_alternatives(F.col("gold_sql"), F.col("pred_sql"))
    return w.select("query_id", F.size(vals).alias("n_values"), slots.alias("n_slots"), n_alt.alias("n_alternatives"))


@query("E11_value_plugins", WORK + f"""SELECT query_id, slot, predicted, value FROM (
  SELECT query_id, slot - 1 AS slot, p[slot] AS predicted, UNNEST(v) AS value FROM (
    SELECT query_id, p, v, UNNEST(range(1, len(p) + 1)) AS slot FROM (
      SELECT query_id, regexp_extract_all(pred_sql, '({_LIT})', 1) AS p,
             list_distinct(regexp_extract_all(gold_sql, '({_LIT})', 1)) AS v FROM w) x) y) z""", ids=("E-11",))
def e11_rows(t: Tables) -> DataFrame:
    """What each literal slot of a predicted query may be filled with."""
    w = W.workload_table(t.spark, t.sf_dir)
    return SC.plug_candidates(w, "gold_sql", "pred_sql", ["query_id"])


# Patterns of the oracle's own: one table, one blank on each side of an operator.
_CMP = r"([A-Za-z_.]+) ?(>=|<=|!=|=|>|<|LIKE) ?(''[^'']*''|[0-9]+)"
_BTW = r"([A-Za-z_.]+) BETWEEN ([0-9]+) AND ([0-9]+)"
_ONE_TABLE = """CASE WHEN len(list_distinct(regexp_extract_all(gold_sql, '(?:FROM|JOIN) ([a-z_]+)', 1))) = 1
  THEN regexp_extract(gold_sql, 'FROM ([a-z_]+)', 1) END"""


@query("E12_typed_comparisons", WORK + f"""
SELECT query_id, CASE WHEN c LIKE '%.%' THEN split_part(c, '.', 1) ELSE tab END AS "table",
       CASE WHEN c LIKE '%.%' THEN split_part(c, '.', 2) ELSE c END AS "column", lower(o) AS op, v AS value FROM (
  SELECT query_id, {_ONE_TABLE} AS tab, UNNEST(regexp_extract_all(gold_sql, '{_CMP}', 1)) AS c,
         UNNEST(regexp_extract_all(gold_sql, '{_CMP}', 2)) AS o,
         UNNEST(regexp_extract_all(gold_sql, '{_CMP}', 3)) AS v FROM w
  UNION ALL
  SELECT query_id, {_ONE_TABLE}, UNNEST(regexp_extract_all(gold_sql, '{_BTW}', 1)), '>=',
         UNNEST(regexp_extract_all(gold_sql, '{_BTW}', 2)) FROM w
  UNION ALL
  SELECT query_id, {_ONE_TABLE}, UNNEST(regexp_extract_all(gold_sql, '{_BTW}', 1)), '<=',
         UNNEST(regexp_extract_all(gold_sql, '{_BTW}', 3)) FROM w) x""", ids=("E-12",))
def e12(t: Tables) -> DataFrame:
    return SC.typed_comparisons(W.workload_table(t.spark, t.sf_dir), "gold_sql", ["query_id"])


# ------------------------------------------------------------ E-13 .. E-15

def unit_pairs(t: Tables, *more: str) -> DataFrame:
    """Clause units of gold (g) and predicted (p) queries, with the workload's ``more`` columns."""
    w = W.workload_table(t.spark, t.sf_dir)
    m = column_classes(t)
    w = w.select("query_id", "db_id", *more, SC.fk_canonical(F.col("gold_sql"), m).alias("gold"),
                 SC.fk_canonical(F.col("pred_sql"), m).alias("pred"))
    w = SC.with_units(SC.with_units(w, "gold", "g"), "pred", "p")
    return w.select("query_id", "db_id", *more, "g", "p")


def outcomes(t: Tables, *more: str) -> DataFrame:
    """(query_id, db_id, more, flag): does the prediction match exactly (E-14)?"""
    return unit_pairs(t, *more).select("query_id", "db_id", *more, (SC.exact() == 1).alias("flag"))


def featured_outcomes(t: Tables) -> DataFrame:
    """The featured workload with the outcome as its flag."""
    return featured(t).drop("flag").join(outcomes(t).select("query_id", "flag"), "query_id")


def scores(t: Tables) -> DataFrame:
    return SC.component_scores(unit_pairs(t), ["query_id"])


# Ground truth of the component scores from the generator parameters.
_P = W.SHAPE_PARAMS
_V = W.VARIANT
_s, _w, _g, _o, _x = (f"({_P[k]})" for k in "swgox")


def _perturbed(v: str):
    return (f"(CASE WHEN {v} = 4 THEN ({_s} + 1) % 6 ELSE {_s} END)",
            f"(CASE WHEN {v} = 3 THEN 0 ELSE {_w} END)",
            f"(CASE WHEN {v} = 2 THEN 0 ELSE {_o} END)")


_s2, _w2, _o2 = _perturbed(_V)


def _nsel(s):
    return f"(CASE WHEN {s} IN (2, 4) THEN 2 ELSE 1 END)"


def _nwhere(w):
    return f"(CASE WHEN {w} IN (4, 5) THEN 2 WHEN {w} >= 2 THEN 1 ELSE 0 END)"


def _ao(w):
    return f"(CASE {w} WHEN 4 THEN 'and' WHEN 5 THEN 'or' ELSE '' END)"


def _kw(w, g, o, x):
    b = lambda c: f"(CASE WHEN {c} THEN 1 ELSE 0 END)"
    return (f"({b(f'{w} >= 2')} + {b(f'{w} = 5')} + {b(f'{w} = 7')} + {b(f'{w} IN (8, 10)')} + {b(f'{w} = 10')}"
            f" + {b(f'{g} >= 4')} + {b(f'{g} IN (5, 6)')} + 2 * {b(f'{o} BETWEEN 8 AND 11')}"
            f" + {b(f'{o} IN (10, 12)')} + {b(f'{x} <= 2')})")


_WHERE_EQ = f"({_w} = {_w2} OR ({_w} < 2 AND {_w2} < 2))"
_KW_EQ = f"({_WHERE_EQ} AND ({_o} = {_o2} OR ({_o} < 8 AND {_o2} < 8)))"
_AO_EQ = f"({_ao(_w)} = {_ao(_w2)})"
_ORDER_OK = f"(NOT ({_o} BETWEEN 8 AND 11 AND {_o2} <> {_o}))"
_NGROUP = f"(CASE {_g} WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END)"
_HASG = f"(CASE WHEN {_g} >= 4 THEN 1 ELSE 0 END)"
_HASX = f"(CASE WHEN {_x} <= 2 THEN 1 ELSE 0 END)"


def _i(c):
    return f"(CASE WHEN {c} THEN 1 ELSE 0 END)"


_TRUTH_ROWS = {
    "select": (_nsel(_s), _nsel(_s2), _i(f"{_s} = {_s2}")),
    "select_no_agg": (_nsel(_s), _nsel(_s2), _i(f"{_s} = {_s2}")),
    "where": (_nwhere(_w), _nwhere(_w2), _i(_WHERE_EQ)),
    "where_no_op": (_nwhere(_w), _nwhere(_w2), _i(_WHERE_EQ)),
    "group_no_having": (_NGROUP, _NGROUP, "1"),
    "group": (_HASG, _HASG, "1"),
    "order": (_i(f"{_o} BETWEEN 8 AND 11"), _i(f"{_o2} BETWEEN 8 AND 11"), _i(_ORDER_OK)),
    "and_or": (f"(CASE WHEN {_AO_EQ} THEN 1 ELSE {_i(_ao(_w) + ' <> ' + chr(39) * 2)} END)",
               f"(CASE WHEN {_AO_EQ} THEN 1 ELSE {_i(_ao(_w2) + ' <> ' + chr(39) * 2)} END)", _i(_AO_EQ)),
    "iuen": (_HASX, _HASX, "1"),
    "keywords": (_kw(_w, _g, _o, _x), _kw(_w2, _g, _o2, _x), _i(_KW_EQ)),
}
_SCORES_SQL = " UNION ALL ".join(
    f"SELECT event_id AS query_id, '{k}' AS component, CAST({a} AS INT) AS label_total, CAST({b} AS INT) AS pred_total, "
    f"CAST({c} AS INT) AS score FROM events" for k, (a, b, c) in _TRUTH_ROWS.items())
def _exact_expr(v: str) -> str:
    s2, w2, o2 = _perturbed(v)
    where_eq = f"({_w} = {w2} OR ({_w} < 2 AND {w2} < 2))"
    kw_eq = f"({where_eq} AND ({_o} = {o2} OR ({_o} < 8 AND {o2} < 8)))"
    ao_eq = f"({_ao(_w)} = {_ao(w2)})"
    order_ok = f"(NOT ({_o} BETWEEN 8 AND 11 AND {o2} <> {_o}))"
    return _i(f"{_s} = {s2} AND {where_eq} AND {order_ok} AND {ao_eq} AND {kw_eq}")


_EXACT_SQL = f"SELECT event_id AS query_id, {_exact_expr(_V)} AS exact FROM events"


@query("E13_component_scores", _SCORES_SQL, ids=("E-13",))
def e13(t: Tables) -> DataFrame:
    return scores(t)


@query("E14_exact_match", _EXACT_SQL, ids=("E-14",))
def e14(t: Tables) -> DataFrame:
    return unit_pairs(t).select("query_id", SC.exact().alias("exact"))


_PARTIAL_SQL = f"""{TRUTH}, s AS ({_SCORES_SQL}),
j AS (SELECT t.hardness AS level, s.* FROM s JOIN t USING (query_id)),
agg AS (SELECT level, component,
          AVG(CASE WHEN pred_total > 0 THEN score END) AS acc, AVG(CASE WHEN label_total > 0 THEN score END) AS rec
        FROM j GROUP BY level, component
        UNION ALL
        SELECT 'all', component, AVG(CASE WHEN pred_total > 0 THEN score END),
               AVG(CASE WHEN label_total > 0 THEN score END) FROM j GROUP BY component),
f AS (SELECT level, component, COALESCE(acc, 0.0) AS acc, COALESCE(rec, 0.0) AS rec FROM agg)
SELECT level, component, acc, rec,
  CASE WHEN acc = 0 AND rec = 0 THEN 1.0 ELSE 2.0 * acc * rec / (acc + rec) END AS f1 FROM f"""


@query("E15_partial_rollup", _PARTIAL_SQL, ids=("E-15",))
def e15(t: Tables) -> DataFrame:
    lv = featured(t).select("query_id", "hardness")
    return SC.partial_rollup(scores(t).join(lv, "query_id"), "hardness").select("level", "component", "acc", "rec", "f1")


@query("E15_exact_rollup", f"""{TRUTH}, e AS ({_EXACT_SQL})
SELECT COALESCE(hardness, 'all') AS level, COUNT(*) AS n, AVG(CAST(exact AS DOUBLE)) AS exact
FROM t JOIN e USING (query_id) GROUP BY ROLLUP (hardness)""", ids=("E-15", "E-7"))
def e15_exact(t: Tables) -> DataFrame:
    ex = unit_pairs(t).select("query_id", SC.exact().alias("exact"))
    lv = featured(t).select("query_id", "hardness")
    return SC.exact_rollup(ex.join(lv, "query_id"), "hardness", ["exact"]).select("level", "n", "exact")


# ------------------------------------------------------------------ E-16

# The outcome of every workload query, as the generator's parameters give it.
_OUT = f", e AS ({_EXACT_SQL}), o AS (SELECT w.* EXCLUDE (flag), e.exact = 1 AS flag FROM w JOIN e USING (query_id)) "


@query("E16_turn_accuracy", WORK + _OUT + """
SELECT CASE WHEN turn <= 4 THEN 'turn ' || CAST(turn AS VARCHAR) ELSE 'turn > 4' END AS bucket, COUNT(*) AS n,
       AVG(CAST(flag AS DOUBLE)) AS exact FROM o GROUP BY 1
UNION ALL
SELECT 'joint_all', COUNT(*), AVG(CAST(x AS DOUBLE)) FROM (
  SELECT session_id, BOOL_AND(flag) AS x FROM o GROUP BY session_id) s""", ids=("E-16",))
def e16(t: Tables) -> DataFrame:
    """Per-turn and joint (all turns right) exact-match accuracy over sessions."""
    turns = outcomes(t, "session_id", "turn").withColumnRenamed("flag", "exact")
    return SC.turn_accuracy(turns, "session_id", "turn", ["exact"])


# ---------------------------------------------------------- E-17 .. E-20

@query("E17_success_by_iteration", WORK + _OUT + """SELECT db_id, iter - 2 AS iteration, COUNT(*) AS n_success
FROM o WHERE flag GROUP BY db_id, iter
UNION ALL SELECT 'all', iter - 2, COUNT(*) FROM o WHERE flag GROUP BY iter""", ids=("E-17",))
def e17(t: Tables) -> DataFrame:
    return SC.success_by_iteration(outcomes(t, "iter"), "db_id", "iter", "flag")


@query("E18_rate_by_hardness", TRUTH_WORK + _OUT + """SELECT COALESCE(hardness, 'total') AS level, COUNT(*) AS n,
COUNT_IF(flag) AS n_success, COUNT_IF(flag) / COUNT(*) AS rate FROM t JOIN o USING (query_id) GROUP BY ROLLUP (hardness)""",
       ids=("E-18",))
def e18(t: Tables) -> DataFrame:
    return SC.rate_by_level(featured_outcomes(t), "hardness", "flag").select("level", "n", "n_success", "rate")


@query("E19_summary", WORK + _OUT + """SELECT COUNT(*) AS n, COUNT_IF(flag) AS n_success, COUNT_IF(NOT flag) AS n_failed,
FLOOR((COUNT_IF(flag) * 20000 + COUNT(*)) / (2 * COUNT(*))) / 100.0 AS success_pct,
FLOOR((COUNT_IF(NOT flag) * 20000 + COUNT(*)) / (2 * COUNT(*))) / 100.0 AS fail_pct FROM o""", ids=("E-19",))
def e19(t: Tables) -> DataFrame:
    return SC.summary_rows(outcomes(t), "flag")


@query("E20_cumulative_success", TRUTH_WORK + _OUT + """, j AS (SELECT hardness, iter, flag FROM t JOIN o USING (query_id)),
per AS (SELECT hardness, iter, COUNT_IF(flag) AS n_success FROM j GROUP BY hardness, iter
        UNION ALL SELECT 'all', iter, COUNT_IF(flag) FROM j GROUP BY iter),
sz AS (SELECT hardness, COUNT(*) AS level_size FROM j GROUP BY hardness UNION ALL SELECT 'all', COUNT(*) FROM j)
SELECT hardness, iter, n_success, level_size,
  SUM(n_success) OVER (PARTITION BY hardness ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_success,
  SUM(n_success) OVER (PARTITION BY hardness ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / level_size AS cum_rate
FROM per JOIN sz USING (hardness)""", ids=("E-20",))
def e20(t: Tables) -> DataFrame:
    out = SC.cumulative_success(featured_outcomes(t), "hardness", "iter", "flag")
    return out.select("hardness", "iter", "n_success", "level_size",
                      F.col("cum_success").cast("bigint").alias("cum_success"), "cum_rate")


# ---------------------------------------------------------- E-22 / E-23

_FAIL_SQL = f"""WITH m AS ({W.multi_model_sql()}),
e AS (SELECT event_id AS query_id, model, {_exact_expr(W.MODEL_VARIANT)} AS exact
      FROM events, (SELECT UNNEST(range({W.N_MODELS})) AS model) mm),
fail AS (SELECT DISTINCT m.model, m.db_id, m.gold_sql FROM m JOIN e USING (query_id, model) WHERE exact = 0)"""


def failures(t: Tables) -> DataFrame:
    """(model, db, gold query) for every prediction that is not an exact match.
    Gold units depend on the query only, so they are cut once per query and
    joined to the per-model prediction units on the query id."""
    m = column_classes(t)
    gold = W.workload_table(t.spark, t.sf_dir).select(
        "query_id", "db_id", "gold_sql", SC.fk_canonical(F.col("gold_sql"), m).alias("gold"))
    gu = SC.with_units(gold, "gold", "g").select("query_id", "db_id", "gold_sql", "g")
    preds = W.multi_model_table(t.spark, t.sf_dir).select(
        "query_id", "model", SC.fk_canonical(F.col("pred_sql"), m).alias("pred"))
    pu = SC.with_units(preds, "pred", "p").select("query_id", "model", "p")
    u = pu.join(gu, "query_id").groupBy("model", "db_id", "gold_sql").agg(F.min(SC.exact()).alias("least"))
    return u.filter("least = 0").drop("least")


def _n_models(t: Tables) -> int:
    """How many models there are predictions of."""
    return W.multi_model_table(t.spark, t.sf_dir).agg(F.count_distinct("model")).first()[0]


@query("E22_common_failures", _FAIL_SQL + " SELECT db_id, gold_sql FROM fail GROUP BY db_id, gold_sql "
       "HAVING COUNT(DISTINCT model) = (SELECT COUNT(DISTINCT model) FROM m)", ids=("E-22",))
def e22(t: Tables) -> DataFrame:
    """Failed (db, gold template) pairs shared by all models."""
    return SC.common_failures(failures(t), ["db_id", "gold_sql"], "model", _n_models(t))


@query("E23_unique_failures", _FAIL_SQL + ", common AS (SELECT db_id, gold_sql FROM fail GROUP BY db_id, "
       "gold_sql HAVING COUNT(DISTINCT model) = (SELECT COUNT(DISTINCT model) FROM m)) SELECT f.model, f.db_id, f.gold_sql FROM fail f "
       "ANTI JOIN common c ON f.db_id = c.db_id AND f.gold_sql = c.gold_sql", ids=("E-23",))
def e23(t: Tables) -> DataFrame:
    k = ["db_id", "gold_sql"]
    # Read twice: written once, so that the units are cut once.
    f = saved(failures(t), "failures")
    return SC.unique_failures(f, SC.common_failures(f, k, "model", _n_models(t)), k)
