"""The streaming profile's sink: whole epochs, an interrupted one, repeated queries."""

import uuid

import pytest
from pyspark.sql import functions as F

from querylab.session import scratch_path
from querylab.sources import files as S
from querylab.streaming import corpus_profile as P


def test_interrupted_epoch_is_written_again(spark, monkeypatch):
    base = scratch_path(spark, f"stream-test-{uuid.uuid4().hex}")
    corpus, sink, ckpt = f"{base}/corpus", f"{base}/sink", f"{base}/checkpoint"
    assert P.read_profile(spark, sink).count() == 0
    rows = spark.range(40).select(F.concat(F.lit("d"), F.col("id") % 2).alias("db_id"), F.col("id").alias("query_id"),
                                  F.concat(F.lit("SELECT a FROM t WHERE b = "), F.col("id")).alias("query"))

    def total() -> int:
        return P.read_profile(spark, sink).agg(F.sum("n")).first()[0]

    S.write_corpus(rows.filter("query_id < 20"), f"{corpus}/arrival=1", "db_id", "query")
    P.run_once(spark, f"{corpus}/*/*/*.csv", sink, ckpt)
    assert total() == 20
    # Ended after the epoch's folder was written and before the pointer moved: readers keep the last whole epoch.
    S.write_corpus(rows.filter("query_id >= 10"), f"{corpus}/arrival=2", "db_id", "query")
    with monkeypatch.context() as m:
        def ended(*_):
            raise RuntimeError("ended")
        m.setattr(P, "point_to", ended)
        with pytest.raises(Exception):
            P.run_once(spark, f"{corpus}/*/*/*.csv", sink, ckpt)
    assert total() == 20
    P.run_once(spark, f"{corpus}/*/*/*.csv", sink, ckpt)
    assert total() == 40  # ten queries came twice and count once
    P.run_once(spark, f"{corpus}/*/*/*.csv", sink, ckpt)
    assert total() == 40
