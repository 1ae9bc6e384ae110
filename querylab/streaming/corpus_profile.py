"""ST-1: profile newly arriving query-corpus files, exactly once.

A file stream over a corpus folder (CSV, one folder per database) computes the
hardness of every query with the same Column expressions as the batch
operators and keeps running counts per (database, hardness).  Restarting with
the same checkpoint processes only files that arrived since the last run
(the file source's own ledger), so reruns are idempotent.

A query that arrives again (the same id in the same database) counts once: the
stream drops duplicates by that key, whose state lives in the checkpoint.

Every epoch writes a folder of its own and then moves a pointer to it, by a
rename; an epoch that was ended between write and commit is written again under
the same name.  Readers follow the pointer, so they see the last whole epoch at
all times, never an empty or half-written sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylab.operators import workload as WL
from querylab.sources.files import _CSV_OPTS, db_from_path

CORPUS_SCHEMA = "query_id BIGINT, query STRING"


POINTER = "_current"


def profile_stream(spark: SparkSession, corpus_glob: str) -> DataFrame:
    """Streaming DataFrame of running counts per (db_id, hardness)."""
    src = (spark.readStream.schema(CORPUS_SCHEMA).options(**_CSV_OPTS)
           .option("maxFilesPerTrigger", 64).csv(corpus_glob)
           .withColumn("db_id", db_from_path(F.input_file_name())))
    f = WL.with_hardness(src.dropDuplicates(["db_id", "query_id"]), "query")
    return f.groupBy("db_id", "hardness").agg(F.count(F.lit(1)).alias("n"))


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def point_to(spark: SparkSession, sink_dir: str, epoch: int) -> None:
    """Move the sink's pointer to an epoch: pointers are empty files named by
    their epoch, made under another name and renamed, the highest counts."""
    fs, path = _file_system(spark, sink_dir)
    made, final = path(f"{sink_dir}/{POINTER}/.new-{epoch}"), path(f"{sink_dir}/{POINTER}/epoch-{epoch}")
    fs.create(made, True).close()
    if not fs.rename(made, final):
        fs.delete(made, False)  # there already: the epoch was committed before


def current_epoch(spark: SparkSession, sink_dir: str) -> int | None:
    fs, path = _file_system(spark, sink_dir)
    at = path(f"{sink_dir}/{POINTER}")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n.split("-")[1]) for n in names if n.startswith("epoch-")), default=None)


def read_profile(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The counts of the last whole epoch."""
    epoch = current_epoch(spark, sink_dir)
    if epoch is None:
        return spark.createDataFrame([], "db_id string, hardness string, n bigint")
    return spark.read.parquet(f"{sink_dir}/epoch={epoch}")


def run_once(spark: SparkSession, corpus_glob: str, sink_dir: str, checkpoint: str) -> None:
    """Process everything available now, then stop.  Each micro-batch in
    complete mode carries the full (small) aggregate, written as its epoch's
    folder; the file source and the state store live in ``checkpoint``."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch}")
        point_to(spark, sink_dir, epoch)

    q = (profile_stream(spark, corpus_glob).writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint).foreachBatch(write)
         .trigger(availableNow=True).start())
    q.awaitTermination()
