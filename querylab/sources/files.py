"""Readers and writers for the benchmark's file formats.

* corpus CSV folders (quoted, multi-line fields, db name in the file path)
* gold / prediction text: ``sql<TAB>db`` per line, blank line between sessions
* catalog and annotated-set JSON
* evaluation logs made of delimited text blocks
* per-database CSV sinks, JSON sinks, a processed-key ledger for resumable runs
* listing and pairing of gold / prediction files

Readers never pull a whole file into one row except where the format's unit
is a block (a session, a log entry); record order inside files comes from
the file path, the split offset and the record id within the split.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylab.operators.compare import dense_positions
from querylab.session import saved

# File-name suffixes that follow the database name in corpus files.
CORPUS_SUFFIXES = ("_res", "_processed", "_correct_sqls")

_CSV_OPTS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


# --------------------------------------------------------------- corpus CSV

def db_from_path(path: Column) -> Column:
    """Database name from a corpus file path: the last path component that
    names a file or folder, without a known suffix."""
    suffix = "|".join(CORPUS_SUFFIXES)
    name = F.regexp_extract(path, r"([^/]+?)(?:\.csv)?(?:/part-[^/]*)?$", 1)
    name = F.regexp_replace(name, r"^[^=]*=", "")          # key=value folder names
    return F.regexp_replace(name, f"(?:{suffix})$", "")


_RECORDS = "file string, block bigint, edge string, first boolean, record string"


def _cut_records(batches):
    """Lines of a split (in order, with the split's state at its start) put
    together to records.  A record that crosses the split's ends comes out in
    pieces: ``tail`` where it begins, ``head`` where it ends, ``middle`` between."""
    split, held, inside, whole, first = None, [], False, True, False

    def flush(edge):
        out.append((*split, edge, first, "\n".join(held)))

    for batch in batches:
        out = []
        for file, block, odd_before, value in zip(batch["file"], batch["block"], batch["odd_before"], batch["value"]):
            if split != (file, block):
                if held:
                    flush("tail" if whole else "middle")
                split, held, inside = (file, block), [], bool(odd_before)
                whole, first = not inside, block == 0
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                flush("" if whole else "head")
                held, whole, first = [], True, False
        yield pd.DataFrame(out, columns=["file", "block", "edge", "first", "record"])
    out = []
    if held:
        flush("tail" if whole else "middle")
    yield pd.DataFrame(out, columns=["file", "block", "edge", "first", "record"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record) for quoted CSV files below ``path``; ``first`` marks
    a file's first record.  Large files are read by many tasks: one pass counts
    the quotes of each byte range, the parity of all earlier ranges of the file
    tells whether a range begins inside quotes, and a second pass cuts its lines
    into records.  Only the pieces of records that cross ranges are shuffled, at
    most two a range.

    Quotes stand around fields and are doubled inside them (RFC 4180); a line
    may end with a carriage return; an empty file has no records."""
    lines = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = saved(ranges.select("file", "block", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
                                 .alias("odd_before")), "csv-ranges")
    # The join may deal lines out anew, so they are put in order after it.
    ordered = (lines.withColumn("at", F.monotonically_increasing_id()).join(states, ["file", "block"])
               .sortWithinPartitions("file", "block", "at").select("file", "block", "odd_before", "value"))
    cut = saved(ordered.mapInPandas(_cut_records, _RECORDS), "csv-records")
    upto = Window.partitionBy("file").orderBy("block", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = (cut.filter("edge <> ''").withColumn("rank", F.expr("CASE edge WHEN 'tail' THEN 1 ELSE 0 END"))
              .withColumn("begun", F.max(F.when(F.col("edge") == "tail", F.col("block"))).over(upto)))
    joined = (pieces.groupBy("file", "begun")
              .agg(F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
              .select("file", "first", F.array_join("parts.record", "\n").alias("record")))
    return cut.filter("edge = ''").select("file", "first", "record").unionByName(joined)


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All corpus CSV files under ``path`` with a ``db_id`` taken from each
    file's path (S-3).  With a schema, large files are split; without one the
    columns must be inferred, a whole file a task."""
    if schema is None:
        df = spark.read.options(**_CSV_OPTS).option("recursiveFileLookup", "true").csv(path)
        return df.withColumn("db_id", db_from_path(F.col("_metadata.file_path")))
    ddl = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    record = F.regexp_replace("record", r"\r$", "")
    rows = read_records(spark, path).filter(~F.col("first") & (record != ""))
    return rows.select(F.from_csv(record, ddl, {"quote": '"', "escape": '"'}).alias("row"), "file").select(
        "row.*", db_from_path(F.col("file")).alias("db_id"))


def write_corpus(df: DataFrame, path: str, db_col: str, query_col: str, suffix: str = "_correct_sqls") -> None:
    """One folder of CSV files per database named ``<db><suffix>``; rows
    whose text does not start with SELECT are not written (S-9)."""
    out = (df.filter(F.upper(F.ltrim(F.col(query_col))).startswith("SELECT"))
           .withColumn("__file", F.concat(F.col(db_col), F.lit(suffix))).drop(db_col))
    out.write.mode("overwrite").options(**_CSV_OPTS).partitionBy("__file").csv(path)


# ---------------------------------------------------------- gold / predict

def write_sessions(df: DataFrame, path: str, session_col: str, turn_col: str, sql_col: str,
                   db_col: str | None) -> None:
    """Text file of ``sql<TAB>db`` lines, sessions separated by a blank line
    (S-11).  Sessions never straddle files: rows are range partitioned by
    session and sorted inside each partition, no per-session collect."""
    line = F.regexp_replace(F.col(sql_col), r"\s+", " ")
    if db_col:
        line = F.concat_ws("\t", line, F.col(db_col))
    body = df.select(F.col(session_col).alias("s"), F.col(turn_col).cast("double").alias("t"), line.alias("value"))
    ends = df.select(F.col(session_col).alias("s")).distinct().select(
        "s", F.lit(float("inf")).alias("t"), F.lit("").alias("value"))
    rows = body.unionByName(ends)
    (rows.repartitionByRange("s").sortWithinPartitions("s", "t").select("value")
     .write.mode("overwrite").text(path))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session, turn, sql, db_id) from a gold/prediction text file (S-4):
    one record per blank-line separated block, positions from file order."""
    blocks = (spark.read.option("lineSep", "\n\n").text(path)
              .withColumn("__f", F.col("_metadata.file_path"))
              .withColumn("__b", F.col("_metadata.file_block_start"))
              .withColumn("__r", F.monotonically_increasing_id())
              .filter(F.length(F.trim("value")) > 0))
    pos = dense_positions(blocks, [F.col("__f"), F.col("__b"), F.col("__r")], "session")
    lines = pos.select("session", F.posexplode(F.split(F.regexp_replace("value", r"^\n+|\n+$", ""), "\n"))
                       .alias("turn", "line"))
    parts = F.split("line", "\t")
    return lines.select("session", F.col("turn").cast("bigint").alias("turn"), parts[0].alias("sql"),
                        F.try_element_at(parts, F.lit(2)).alias("db_id"))


# ------------------------------------------------------------------- JSON

def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False) -> DataFrame:
    """JSON with an explicit schema (no inference pass) (S-5, S-6, S-10)."""
    return spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)


def repaired_json_field(cell: Column, field: str, dtype: str = "bigint") -> Column:
    """One field of a possibly broken JSON cell (S-8): the cell as it stands
    is parsed first; only if that fails are trailing commas dropped, then
    single quotes swapped; a regex capture is the last resort."""
    path = f"$.{field}"
    trimmed = F.regexp_replace(cell, r",\s*([}\]])", "$1")
    fallback = F.regexp_extract(cell, rf"""["']{field}["']\s*:\s*["']?([^,"'}}]+)""", 1)
    return F.coalesce(F.get_json_object(cell, path), F.get_json_object(trimmed, path),
                      F.get_json_object(F.regexp_replace(trimmed, "'", '"'), path),
                      F.when(fallback != "", fallback)).try_cast(dtype)


# ------------------------------------------------------------------- logs

#: Fixed values of the log format: the labels of a block's fields, and the
#: characters whose runs (of any length from three) separate blocks.
LOG_LABELS = ("Execution error", "Predicted SQL", "Gold SQL", "Question")
LOG_MARKS = ("@", "-")


def write_log_blocks(df: DataFrame, path: str, level_col: str, pred_col: str, gold_col: str, question_col: str,
                     mark: str = "@", run: int = 10) -> None:
    """Evaluation log: one block per failure (level, predicted, gold, question)."""
    level, *rest = LOG_LABELS
    block = F.concat(F.lit(f"{level} "), F.col(level_col), *[
        x for label, c in zip(rest, (pred_col, gold_col, question_col)) for x in (F.lit(f"\n{label}: "), F.col(c))])
    df.select(block.alias("value")).write.mode("overwrite").option("lineSep", f"\n{mark * run}\n").text(path)


def read_log_blocks(spark: SparkSession, path: str, mark: str = "@") -> DataFrame:
    """(level, pred, gold, question) per log block (S-7).  Blocks are separated
    by lines of three or more ``mark``; a field runs, over any number of lines,
    to the next label.  Files are split at the separators, not read whole."""
    run = mark * 3
    b = spark.read.option("lineSep", f"\n{run}").text(path)
    v = F.regexp_replace("value", rf"^\s*(?:{mark})*\s*", "")
    level, *rest = LOG_LABELS
    ends = rf"(?=\n\s*(?:{'|'.join(LOG_LABELS)})|\s*$)"
    return (b.select(v.alias("v")).filter(F.col("v").contains(level))
            .select(F.regexp_extract("v", rf"{level}:?\s+(\w+)", 1).alias("level"),
                    *[F.trim(F.regexp_extract("v", rf"(?s){label}:[ \t]*\n?(.*?){ends}", 1)).alias(c)
                      for label, c in zip(rest, ("pred", "gold", "question"))]))


# ----------------------------------------------------------------- resume

def record_processed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Append the keys of ``df`` to the ledger ``table`` (files below the shared
    folder ``path``), made on first use, and return the ledger.  It is bucketed
    by the keys, so runs that look keys up do not shuffle what earlier runs did."""
    (df.select(*keys).repartition(buckets, *keys).write.mode("append").format("parquet")
     .bucketBy(buckets, *keys).option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def unprocessed(df: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in the processed ledger (S-12); keys that stand
    in it several times count once, rows with NULL keys are never processed."""
    return df.join(ledger.select(*keys), list(keys), "left_anti")


# ----------------------------------------------------------- file pairing

def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths under ``path`` (content is never read: only the path column is
    selected, so the binary-file source skips the bytes)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(path).select("path"))


def pair_files(files: DataFrame, key_pattern: str, kind_pattern: str, keys: Sequence[str],
               gold_kind: str = "gold", pred_kind: str = "predict") -> DataFrame:
    """Match gold and prediction files by key (S-13); a full outer join
    reports files without a partner."""
    k = files.select(*[F.regexp_extract("path", key_pattern, i + 1).alias(c) for i, c in enumerate(keys)],
                     F.regexp_extract("path", kind_pattern, 1).alias("kind")).distinct()
    g = k.filter(F.col("kind") == gold_kind).select(*keys, F.lit(True).alias("has_gold"))
    p = k.filter(F.col("kind") == pred_kind).select(*keys, F.lit(True).alias("has_pred"))
    return (g.join(p, list(keys), "full")
            .select(*keys, F.coalesce("has_gold", F.lit(False)).alias("has_gold"),
                    F.coalesce("has_pred", F.lit(False)).alias("has_pred")))
