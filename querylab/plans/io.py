"""Source / sink round trips (S family) and log mining (S-7 + E-21).

Every query writes its files into a fresh folder under the shared checkpoint
directory (``spark.checkpoint.dir``), reads them back with the querylab
readers and returns what was read, so the oracle can compare it with the
tables it came from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylab.operators import catalog as K
from querylab.operators import scoring as SC
from querylab.plans import catalog as KP
from querylab.plans.registry import REGISTRY, query
from querylab.plans.scoring import _EXACT_SQL, unit_pairs
from querylab.plans.workload import TRUTH_WORK, WORK, c11, featured
from querylab.session import scratch_path
from querylab.sources import files as S
from querylab.sources import workload as W
from querylab.tables import Tables


def _tmp(t: Tables, name: str) -> str:
    return scratch_path(t.spark, f"{name}-{uuid.uuid4().hex}")


@query("S3_corpus_csv_read", WORK + "SELECT db_id, query_id, gold_sql AS query FROM w", ids=("S-3",))
def s3(t: Tables) -> DataFrame:
    """Corpus CSV folders (quoted multi-line fields) read back with the
    database name taken from each file's path."""
    path = _tmp(t, "corpus")
    w = W.workload_table(t.spark, t.sf_dir).select("db_id", "query_id", F.col("gold_sql").alias("query"))
    S.write_corpus(w, path, "db_id", "query")
    r = S.read_corpus(t.spark, path, "query_id BIGINT, query STRING")
    return r.select("db_id", "query_id", "query")


@query("S9_csv_sink_select_only", WORK + "SELECT db_id, COUNT(*) AS n FROM w GROUP BY db_id", ids=("S-9",))
def s9(t: Tables) -> DataFrame:
    """Per-database CSV sink that keeps only rows starting with SELECT (the
    parse-error rows mixed in are dropped), counted after reading back."""
    path = _tmp(t, "sink")
    w = W.workload_table(t.spark, t.sf_dir)
    good = w.select("db_id", "query_id", F.col("gold_sql").alias("query"))
    bad = w.filter(F.col("query_id") % 10 == 0).select(
        "db_id", "query_id", F.concat(F.lit("Error: could not parse "), F.col("pred_sql")).alias("query"))
    S.write_corpus(good.unionByName(bad), path, "db_id", "query")
    return S.read_corpus(t.spark, path, "query_id BIGINT, query STRING").groupBy("db_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("S4_gold_predict_sessions", """
SELECT CAST(DENSE_RANK() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS session,
       CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn,
       regexp_replace(text, '\\s+', ' ', 'g') AS sql, role AS db_id
FROM conversations""", ids=("S-4", "S-11"))
def s4(t: Tables) -> DataFrame:
    """Gold/prediction text (``sql<TAB>db``, blank line between sessions)
    written from the conversations and parsed back into (session, turn)."""
    path = _tmp(t, "sessions")
    S.write_sessions(t.conversations, path, "conv_id", "turn", "text", "role")
    return S.read_sessions(t.spark, path)


@query("S5_catalog_json", REGISTRY["K1_column_relation"].sql, ids=("S-5",))
def s5(t: Tables) -> DataFrame:
    """Catalog written as JSON and read back with the explicit catalog
    schema, then turned into the column relation."""
    path = _tmp(t, "catalog")
    S.write_json_lines(KP.catalog(t), path)
    cat = S.read_json(t.spark, path, K.CATALOG_SCHEMA)
    return KP.counted(t, K.columns_relation(cat)).select("db_id", "table", "column", "type", "n_values")


@query("S6_annotated_json", TRUTH_WORK + "SELECT gold_sql AS query, 'q' || CAST(query_id AS VARCHAR) AS question, "
       "db_id, hardness FROM w JOIN t USING (query_id, db_id)", ids=("S-6", "S-10"))
def s6(t: Tables) -> DataFrame:
    """Annotated set (query, question, db_id, hardness) as JSON and back."""
    path = _tmp(t, "annotated")
    f = featured(t).select(F.col("gold_sql").alias("query"),
                           F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("question"),
                           "db_id", "hardness")
    S.write_json_lines(f, path)
    return S.read_json(t.spark, path, "query STRING, question STRING, db_id STRING, hardness STRING")


@query("S8_repair_json_cells", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
       ids=("S-8",))
def s8(t: Tables) -> DataFrame:
    """Field of a JSON cell after repair: some cells are damaged on purpose
    (trailing comma, single quotes), some hold apostrophes, and all must yield
    the field."""
    p = F.col("props")
    broken = (F.when(F.col("event_id") % 5 == 0, F.regexp_replace(p, "}$", ", \"note\": \"it's {ok}\"}"))
              .when(F.col("event_id") % 7 == 0, F.regexp_replace(p, "}$", ", }"))
              .when(F.col("event_id") % 11 == 0, F.regexp_replace(p, '"', "'")).otherwise(p))
    return t.events.select("event_id", S.repaired_json_field(broken, "k").alias("k"))


@query("S10_spec_json_sink", REGISTRY["C11_spec_dedup"].sql, ids=("S-10",))
def s10(t: Tables) -> DataFrame:
    """Deduplicated specs written as JSON and read back (same rows as C11)."""
    path = _tmp(t, "specs")
    S.write_json_lines(c11(t), path)
    return S.read_json(t.spark, path, "first_query_id BIGINT, n_copies BIGINT")


@query("S12_resume_ledger", "SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1998-01-01')",
       ids=("S-12",))
def s12(t: Tables) -> DataFrame:
    """Resume: two earlier runs recorded the orders that they processed in a
    bucketed ledger; the rerun handles only the rest (anti join on the key, no
    exchange of the ledger)."""
    path, name = _tmp(t, "ledger"), f"ledger_{uuid.uuid4().hex}"
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    for start, end in (("0001-01-01", "1996-01-01"), ("1995-06-01", "1998-01-01")):
        day = lambda d: F.lit(d).cast("timestamp_ntz")
        done = t.orders.filter((F.col("o_orderdate") >= day(start)) & (F.col("o_orderdate") < day(end)))
        S.record_processed(done, name, path, ["o_orderkey"], buckets)
    return S.unprocessed(t.orders, t.spark.table(name), ["o_orderkey"]).select("o_orderkey")


@query("S13_pair_gold_predict_files", WORK + "SELECT DISTINCT CAST(model AS INT) AS model, db_id, TRUE AS has_gold, "
       "NOT (model = 2 AND db_id = 'signup') AS has_pred FROM w", ids=("S-13",))
def s13(t: Tables) -> DataFrame:
    """Gold and prediction files per (model, database); one prediction set
    is missing and is reported by the full outer join."""
    path = _tmp(t, "evalfiles")
    w = W.workload_table(t.spark, t.sf_dir)
    gold = w.select("model", "db_id", F.lit("gold").alias("kind"), F.col("gold_sql").alias("value"))
    pred = (w.filter(~((F.col("model") == 2) & (F.col("db_id") == "signup")))
            .select("model", "db_id", F.lit("predict").alias("kind"), F.col("pred_sql").alias("value")))
    gold.unionByName(pred).write.mode("overwrite").partitionBy("model", "db_id", "kind").text(path)
    paired = S.pair_files(S.list_files(t.spark, path), r"model=(\d+)/db_id=([^/]+)/", r"kind=([^/]+)/",
                          ["model", "db_id"])
    return paired.withColumn("model", F.col("model").cast("int"))


_LOG_SQL = (TRUTH_WORK + f", e AS ({_EXACT_SQL}) SELECT t.hardness AS level, w.pred_sql AS pred, w.gold_sql AS gold, "
            "'q' || CAST(w.query_id AS VARCHAR) AS question FROM w JOIN e USING (query_id) JOIN t USING (query_id) "
            "WHERE e.exact = 0 AND t.hardness = 'easy'")


@query("E21_failures_from_logs", _LOG_SQL, ids=("E-21", "S-7"))
def e21(t: Tables) -> DataFrame:
    """Failures written as an evaluation log (delimited text blocks), mined
    back and filtered to one hardness level."""
    path = _tmp(t, "evallog")
    # aggregated, so that the filter on the outcome is not pushed into the text work and runs it again
    ex = unit_pairs(t).groupBy("query_id").agg(F.max(SC.exact()).alias("exact"))
    f = (featured(t).join(ex.filter(F.col("exact") == 0), "query_id")
         .withColumn("question", F.concat(F.lit("q"), F.col("query_id").cast("string"))))
    S.write_log_blocks(f, path, "hardness", "pred_sql", "gold_sql", "question")
    return S.read_log_blocks(t.spark, path).filter(F.col("level") == "easy")

