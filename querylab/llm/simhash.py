"""Document fingerprints (operator 7), with DataFrame functions only.

A document's terms are its pairs of neighbouring words (lower case; a lone word
is its own term), each as often as it occurs.  Every occurrence's 64-bit hash
votes on 64 signed bits, and a bit is 1 if more than half of the votes set it.
Votes are summed as 32 long counters, each holding two bits' counts, so the
explosion of terms ends in a grouped sum of longs.

``within_radius`` finds all fingerprints within a Hamming radius of given ones
by permuted block tables: 64 bits are cut into ``radius + 3`` blocks; any two
fingerprints within the radius agree in at least three whole blocks, so one
table for each choice of three blocks, keyed by their bits, holds the pair.
Fingerprints under a key that more than ``CROWDED`` of them share, and the
queries there, meet at midpoints instead: every value within half the radius of
the query and within the other half of the fingerprint.  Whatever meets is
within the radius, so no pair is tried in vain, and a pair meets a bounded number of times.

Cases: a null text counts as an empty one; a text without words has
fingerprint zero; repeated rows each get a row and come after one another; a
null ``doc_id`` sorts first; rows equal in ``doc_id`` are ordered by a hash of
their text; a single document's next document is itself; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylab.llm.common import saved

BITS = 64
CROWDED = 256
_LANES = (1 << 32) + 1


# ------------------------------------------------------------ fingerprints

def term_hashes(text: str) -> Column:
    """Hashes of a text's terms, repeats included; empty for no words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) < 2, F.transform(w, lambda x: F.xxhash64(x))).otherwise(
        F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))))[0]


def votes() -> list[Column]:
    """Aggregates over rows of one term hash ``h`` each: how many there are,
    and for each k how many set bit k (low half) and bit k + 32 (high half)."""
    lanes = [F.sum(F.shiftright("h", k).bitwiseAND(F.lit(_LANES))).alias(f"v{k}") for k in range(32)]
    return [F.count("h").alias("n"), *lanes]


def majority() -> Column:
    """The fingerprint, a signed long, from the columns of ``votes``."""
    def bit(count: Column, k: int) -> Column:
        return F.when(2 * count > F.col("n"), F.lit((1 << k) - (1 << 64) * (k == 63))).otherwise(F.lit(0).cast("long"))
    halves = [bit(F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1)), k) for k in range(32)]
    halves += [bit(F.shiftrightunsigned(f"v{k}", 32), k + 32) for k in range(32)]
    return F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(reduce(lambda a, b: a.bitwiseOR(b), halves))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def hex_of(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(key, fp) for rows of ``docs(key, text)`` that share no key."""
    return (docs.select("key", F.explode_outer(term_hashes("text")).alias("h")).groupBy("key").agg(*votes())
            .select("key", majority().alias("fp")))


# ------------------------------------------------------------ edited texts

def _followers(docs: DataFrame) -> DataFrame:
    """A row for each distinct (doc_id, text) and what follows it: k1 and k2
    (its key), doc_id, n_chars, n1 and n2 (the follower's key), rows (how
    often), again (it follows itself as a repeated row).

    Only ids and hashes move.  The global order is a range partitioning that is
    written once, so that partition numbers stand."""
    narrow = (docs.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min(F.length("text")).alias("n_chars"),
                                           F.count("*").alias("rows")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("k2")]
    dealt = saved(narrow.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("part", F.spark_partition_id()), "ordered")
    # A row a partition; the last one is followed by the first.
    first = dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "k2", "k1")).alias("first"))
    turn = Window.orderBy("part")
    first = first.select("part", F.coalesce(F.lead("first").over(turn), F.first("first").over(turn)).alias("after"))
    own = Window.partitionBy("part").orderBy(*order)
    after = dealt.withColumns({"n1": F.lead("k1").over(own), "n2": F.lead("k2").over(own)}).join(first, "part")
    once = after.select("k1", "k2", "doc_id", "n_chars", F.coalesce("n1", "after.k1").alias("n1"),
                        F.coalesce("n2", "after.k2").alias("n2"), F.lit(1).alias("rows"), F.lit(False).alias("again"))
    more = dealt.filter("rows > 1").select("k1", "k2", "doc_id", "n_chars", F.col("k1").alias("n1"), F.col("k2").alias("n2"),
                                           (F.col("rows") - 1).cast("int").alias("rows"), F.lit(True).alias("again"))
    return saved(once.unionByName(more), "followers")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fp, edited_fp (signed
    longs), near_edited, near_next.  The edited text has its last quarter
    replaced by as many first characters of the next document by ``doc_id``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("k2"), "doc_id", "text")
    follows = _followers(keyed)
    texts = keyed.select("k1", "k2", "text")
    if not follows.filter("again").isEmpty():
        texts = texts.dropDuplicates(["k1", "k2"])
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    # Both joins deal the texts by the same key, so they are shuffled once; heads are a quarter of them.
    heads = (texts.withColumnsRenamed({"k1": "n1", "k2": "n2"}).join(follows, ["n1", "n2"])
             .select(*follows.columns, F.substring("text", F.lit(1), quarter).alias("head")))
    both = (texts.join(heads, ["k1", "k2"])
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), "head")))
    keys = ["k1", "k2", "again", "doc_id", "n_chars", "n1", "n2", "rows"]
    kinds = both.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        *keys, "edited_sha256", F.explode(F.array(
            F.struct(F.lit(True).alias("own"), "text"), F.struct(F.lit(False).alias("own"), F.col("edited").alias("text"))
        )).alias("kind"))
    terms = kinds.select(*keys, "edited_sha256", F.col("kind.own").alias("own"),
                         F.explode_outer(term_hashes("kind.text")).alias("h"))
    fps = terms.groupBy(*keys, "edited_sha256", "own").agg(*votes()).select(
        *keys, "edited_sha256", "own", majority().alias("fp"))
    both_fps = saved(fps.groupBy(*keys, "edited_sha256").agg(
        F.max(F.when(F.col("own"), F.col("fp"))).alias("fp"),
        F.max(F.when(~F.col("own"), F.col("fp"))).alias("edited_fp")), "prints")
    following = both_fps.filter("not again").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("fp").alias("next_fp"))
    rows = both_fps.join(following, ["n1", "n2"]).withColumn("row", F.explode(F.sequence(F.lit(1), "rows")))
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fp", "edited_fp",
                       likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


# ------------------------------------------------------------ search

def _tables(fps: DataFrame, radius: int) -> DataFrame:
    """A row for each fingerprint and permuted table: the table's number and
    the bits of its three leading blocks."""
    blocks = radius + 3
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in (
        sum(masks[i] for i in choice) for choice in itertools.combinations(range(blocks), 3))]
    return fps.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in signed]))).withColumn(
        "bits", F.col("fp").bitwiseAND(F.col("mask")))


def _ball(fps: DataFrame, radius: int) -> DataFrame:
    """A row for each value ``mid`` within ``radius`` bits of a fingerprint."""
    flips = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << k for k in range(63)), -(1 << 63)]])
    out = fps.withColumns({"mid": F.col("fp"), "__last": F.lit(0)})
    for _ in range(radius):
        out = (out.select("*", F.posexplode(flips).alias("__at", "__flip")).filter((F.col("__at") > F.col("__last")) | (F.col("__last") == 0))
               .withColumns({"mid": F.col("mid").bitwiseXOR(F.col("__flip")), "__last": F.col("__at")}).drop("__at", "__flip"))
    return out.drop("__last")


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3, crowded: int = CROWDED) -> DataFrame:
    """Distinct (query, fp, distance) with ``fp`` of ``fps(fp)`` within ``radius``
    bits of ``query`` of ``queries(fp)``; a query finds itself if it is there."""
    q = _tables(queries.select("fp").distinct(), radius)
    keys = ["mask", "bits"]
    held = saved(_tables(fps.select("fp").distinct(), radius).join(q.select(*keys).distinct(), keys, "left_semi"), "keyed")
    dense = saved(held.groupBy(*keys).count().filter(F.col("count") > crowded).select(*keys), "crowded")
    asked = q.withColumnRenamed("fp", "query")
    found = held.join(dense, keys, "left_anti").join(asked, keys).select("query", "fp")
    # Both sides of a crowded key, without the key.
    many = _ball(held.join(dense, keys, "left_semi").select("fp").distinct(), radius // 2)
    few = _ball(q.join(dense, keys, "left_semi").select("fp").distinct(), radius - radius // 2).withColumnRenamed("fp", "query")
    found = found.unionByName(many.join(few, "mid").select("query", "fp"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("query"))).alias("distance")
    return found.select("query", "fp", distance).filter(F.col("distance") <= radius).distinct()


def near_fingerprints(docs: DataFrame, every: int = 50, radius: int = 3) -> DataFrame:
    """(query, fp, distance) between distinct fingerprints: the queries are
    those of rows whose ``doc_id`` is divisible by ``every``, fps those of all rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    # Rows that share a key have the same text: their votes are doubled, the majority is not changed.
    prints = saved(fingerprints(docs.select(F.struct(asked.alias("asked"), F.col("doc_id").alias("doc_id"), F.md5(text).alias("of")).alias("key"), text.alias("text")))
                   .select("fp", "key.asked").groupBy("fp").agg(F.max("asked").alias("asked")), "searched")
    return within_radius(prints, prints.filter("asked"), radius).filter("distance > 0")
