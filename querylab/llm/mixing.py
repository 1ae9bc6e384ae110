"""Mixing sources to target weights (operator 5), with DataFrame functions only.

Every document gets a hash-random key.  Within its source the keys fall into
equal hash ranges (buckets of about ``BUCKET_ROWS`` documents, so a source that
holds most rows is spread too); word counts are summed per bucket, bucket sums
become offsets, and a running sum inside each bucket completes the prefix sum.
A source takes its budget, its target rounded to whole words, as whole epochs
plus the documents in key order up to the exact rest; the document at the cut
is taken in part.

Targets: sources in code-point order, null last, weigh 1, 2, 3 and again; they
share all words by weight, but none gets more than ``max_epochs`` times its own
size, and what it leaves is shared by the others.  That level has a closed
form over the sources sorted by cap per weight.

Only the id, the source, the size and the key of a document are shuffled.

Cases: a null text has size 0; a null source is a source of its own; a null id
is a value like any other; rows equal in id and text have one key and share
what their place in the order gets, in any order; a source without words has
target 0; an empty table gives no rows; other columns are ignored by
``mix_plan`` and carried by ``mixed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylab.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 10_000
MAX_EPOCHS = 3


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                             F.coalesce(F.col("text"), F.lit("")))).alias("key")


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size, ...)``, a row a source, with its ``target``."""
    # One row a source: these windows hold source totals, not documents.
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    place = (F.col("place") - 1) % len(weights) + 1
    weighed = placed.withColumns({
        "weight": F.element_at(F.array(*map(F.lit, weights)), place).cast("long"),
        "cap": F.col("source_size") * max_epochs})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    level = ((F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    levels = weighed.withColumn("level", level)
    # The first source that its share does not fill sets the level of all that follow.
    free = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    return (levels.withColumn("level", F.max(free).over(Window.partitionBy()))
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
            .drop("place", "weight", "cap", "level"))


def mix_plan(docs: DataFrame, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, key,
    before (words of its source before it in key order) and taken."""
    rows = docs.select("doc_id", "source", _size(), _key(seed))
    # A row a source, written so that the planner knows its size: a small table is broadcast, a large one is not.
    known = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))), "targets")
    known = known.withColumns({"named": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()})
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    buckets = F.ceil(F.col("rows") / bucket_rows)
    dealt = (rows.withColumns({"named": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()})
             .drop("source").join(known, ["named", "unnamed"])
             .withColumn("bucket", F.floor(place * buckets / (1 << 32))))
    where = ["named", "unnamed", "bucket"]
    sums = dealt.groupBy(*where).agg(F.sum("size").alias("words"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(
        Window.partitionBy("named", "unnamed").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("words")
    inside = F.coalesce(F.sum("size").over(
        Window.partitionBy(*where).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return (dealt.withColumn("inside", inside).join(offsets, where)
            .withColumn("before", F.col("inside") + F.col("offset"))
            .withColumn("budget", budget).withColumn("epochs", epochs).withColumn("rest", rest)
            .withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
            .select("doc_id", "size", "source", "source_size", "target", "key", "before", "epochs", "rest", "taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as the plan takes them.

    A key before its source's cut is taken once more than the whole epochs, so
    the texts meet only one row a source and are not shuffled for it.  The row
    at the cut gives its first words, single-spaced (``n_chars``, if there,
    follows); rows that repeat that document each give them.  A source's
    wordless documents come with every epoch it has, at least once."""
    plan = mix_plan(docs, seed)
    cut = (plan.groupBy("source").agg(
        F.max("epochs").alias("epochs"),
        # the document that the rest ends in, and the words of its row that are left
        F.min(F.when((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")),
                     F.struct("key", (F.col("rest") - F.col("before")).alias("part"), "size"))).alias("cut"))
        .select(F.coalesce("source", F.lit("")).alias("named"), F.col("source").isNull().alias("unnamed"),
                "epochs", F.col("cut.key").alias("cut"), F.col("cut.part").alias("part")))
    cut = saved(cut, "cuts")  # as above, a row a source of known size
    # The given row travels packed, so its columns may have any names.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("source", F.lit("")).alias("named"),
                        F.col("source").isNull().alias("unnamed"), _key(seed).alias("key"), _size().alias("words")).join(cut, ["named", "unnamed"])
    at_cut = F.coalesce(F.col("key") == F.col("cut"), F.lit(False))
    whole = F.col("epochs") + F.when(at_cut, 0).otherwise(F.coalesce((F.col("key") < F.col("cut")).cast("int"), F.lit(0)))
    whole = F.when(F.col("words") == 0, F.greatest(whole, F.lit(1))).otherwise(whole)
    blank = r"[\x20\x09-\x0D]+"
    words = F.slice(F.split(F.regexp_replace("row.text", "^" + blank, ""), blank), 1, F.col("part").cast("int"))
    takes = F.concat(F.array_repeat(F.lit(False), whole.cast("int")),
                     F.when(at_cut & (F.col("part") > 0), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    text = F.when(F.col("cutting"), F.array_join(words, " ")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("cutting"), F.length(text)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    out = keyed.withColumn("cutting", F.explode(takes))
    return out.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


#: The same plan in DuckDB.
SQL = r"""
WITH rows AS (
    SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5('0:' || COALESCE(doc_id::VARCHAR, '') || ':' || COALESCE(text, '')) AS key
    FROM documents),
sizes AS (
    SELECT source, SUM(size)::BIGINT AS source_size,
           (ROW_NUMBER() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1 AS weight
    FROM rows GROUP BY source),
levels AS (
    SELECT *, (SUM(source_size) OVER ()
               - COALESCE(SUM(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (SUM(weight) OVER (ORDER BY 3 * source_size / weight, source
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM sizes),
known AS (
    SELECT source, source_size, LEAST(3.0::DOUBLE * source_size, weight * (
               SELECT MAX(level) FROM levels WHERE 3 * source_size / weight >= level)) AS target
    FROM levels),
summed AS (
    SELECT r.doc_id, r.size, k.source_size, k.target, FLOOR(k.target + 0.5)::BIGINT AS budget,
           COALESCE(SUM(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM rows r JOIN known k ON r.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + GREATEST(0, LEAST(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before)))::BIGINT AS taken
FROM summed
"""
