"""ST-1: streaming corpus profile, run twice over arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylab.plans.registry import query
from querylab.plans.workload import TRUTH
from querylab.session import scratch_path
from querylab.sources import files as S
from querylab.sources import workload as W
from querylab.streaming.corpus_profile import read_profile, run_once
from querylab.tables import Tables


@query("ST1_streaming_corpus_profile", TRUTH + "SELECT db_id, hardness, COUNT(*) AS n FROM t GROUP BY db_id, hardness",
       ids=("ST-1", "S-12"))
def st1(t: Tables) -> DataFrame:
    """Half of the corpus arrives, the stream runs (availableNow) and stops; the
    other half arrives, some of the first half again with it, and the stream
    restarts from its checkpoint: the final counts cover every query once."""
    base = scratch_path(t.spark, f"stream-{uuid.uuid4().hex}")
    corpus, sink, ckpt = f"{base}/corpus", f"{base}/sink", f"{base}/checkpoint"
    w = W.workload_table(t.spark, t.sf_dir).select("db_id", "query_id", F.col("gold_sql").alias("query"))
    glob = f"{corpus}/*/*/*.csv"
    S.write_corpus(w.filter(F.col("query_id") % 2 == 0), f"{corpus}/arrival=1", "db_id", "query")
    run_once(t.spark, glob, sink, ckpt)
    again = (F.col("query_id") % 2 == 1) | (F.col("query_id") % 10 == 0)
    S.write_corpus(w.filter(again), f"{corpus}/arrival=2", "db_id", "query")
    run_once(t.spark, glob, sink, ckpt)
    run_once(t.spark, glob, sink, ckpt)          # nothing new: must not double count
    return read_profile(t.spark, sink)
