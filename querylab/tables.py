"""Access to the driver tables (one parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy parquet readers: ``Tables(spark, sf_dir).lineitem``.

    Every access returns a fresh scan so Catalyst can prune columns and push
    filters into each reader independently.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(name)
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)

    def register_views(self) -> None:
        """Register every table as a temp view (once per session and folder)."""
        key = "querylab.views.dir"
        if self.spark.conf.get(key, None) == self.sf_dir and all(
                self.spark.catalog.tableExists(n) for n in ("lineitem", "conversations")):
            return
        for n in TABLE_NAMES:
            self.table(n).createOrReplaceTempView(n)
        self.spark.conf.set(key, self.sf_dir)
