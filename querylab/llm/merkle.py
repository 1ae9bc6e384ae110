"""Merkle dataset manifest (operator 12) by bitmap-rank indexing.

Every row is a leaf, the SHA-256 of its fields.  A leaf's place among the
leaves of its source needs no sort of the rows: ids are set as bits, 2^15 ids a
bitmap, the tasks' partial bitmaps of a (source, bucket) are merged with OR,
and a popcount directory (bits before the bucket, and before each 64-byte block
of it) turns a rank query into two look-ups and a popcount of at most 64 bytes.

Places then key slot arrays: a run of ``3 ** LEVELS`` neighbouring slots is one
row, which reduces ``LEVELS`` levels at once, so a tree over n leaves takes
log(n) / (LEVELS log 3) shuffles of ever fewer rows, and no row or task holds
more than a run, however many rows a source has.  Coming down, every run hands
its nodes their siblings on the way to the root, and the rows get whole proofs.

Order: sources with null first, then by UTF-8 bytes; leaves of a source by
``doc_id``, null first.  Rows that share source and ``doc_id`` cannot share a
bit: their buckets (found by comparing rows with bits) are ranked by a
distributed sort of (doc_id, leaf), with prefix sums a partition.

Cases: a null field is ``-`` in the leaf; rows equal in source and ``doc_id``
follow each other by their leaf, wholly equal rows take neighbouring slots in
any order; a null ``doc_id`` counts as the empty text where a checksum decides
on tampering; a lone row is its source's subroot, a lone subroot the root; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylab.llm.common import saved
from querylab.operators.compare import dense_positions, running_sum

LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BUCKET_BITS = 15
_BLOCK = 64
_NO_ID = -(1 << 63)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """key (orders sources, never null), bucket, doc_id, leaf, tampered (the
    leaf without line breaks, where the row is tampered with) and uid."""
    tampering = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    broken = tampering & F.coalesce(F.col("text").contains("\n"), F.lit(False))
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("key"),
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), _BUCKET_BITS), F.lit(_NO_ID)).alias("bucket"),
        F.col("doc_id").cast("long").alias("doc_id"), _leaf(F.col("text")).alias("leaf"),
        F.when(broken, _leaf(F.translate("text", "\n", ""))).alias("tampered"),
        F.monotonically_increasing_id().alias("uid"))


# ------------------------------------------------------------ ranks

def _directory(rows: DataFrame) -> DataFrame:
    """A row a (key, bucket): its bitmap, the bits before each block of it, and
    how many rows and distinct ids it has."""
    low = F.col("doc_id").bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
    merged = rows.groupBy("key", "bucket").agg(F.bitmap_construct_agg(low).alias("bits"), F.count("*").alias("rows"))
    blocks = (1 << _BUCKET_BITS) // 8 // _BLOCK
    return merged.withColumns({
        "ids": F.bitmap_count("bits"),
        "before_block": F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)),
                                    lambda k: F.bitmap_count(F.substring(F.col("bits"), F.lit(1), k * _BLOCK)))})


def _bits_below() -> Column:
    """Set bits of ``bits`` below the id's own."""
    low = F.col("doc_id").bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
    byte = F.shiftright(low, 3).cast("int")
    block = F.floor(byte / _BLOCK).cast("int")
    own = F.conv(F.hex(F.substring(F.col("bits"), byte + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.expr("shiftleft(1, cast(doc_id & 7 as int)) - 1")
    return (F.get("before_block", block) + F.bitmap_count(F.substring(F.col("bits"), block * _BLOCK + 1, byte - block * _BLOCK))
            + F.bit_count(own.bitwiseAND(mask)))


def placed(rows: DataFrame) -> DataFrame:
    """Leaves with their coordinates: s (number of the source), n (its leaves)
    and slot (place among them, from 0)."""
    directory = saved(_directory(rows), "directory")
    order = [F.col("key"), F.col("bucket")]
    counts = running_sum(directory.select("key", "bucket", "rows", "ids"), order, "rows", "before")
    sources = dense_positions(counts.groupBy("key").agg(F.sum("rows").alias("n"), F.min("before").alias("first")), [F.col("key")], "s")
    places = saved(counts.join(sources, "key").select("key", "bucket", "s", "n", (F.col("before") - F.col("first")).alias("base"),
                                                      (F.col("rows") > F.col("ids")).alias("crowded")), "places")
    known = rows.join(places, ["key", "bucket"])
    out = ["s", "n", "slot", "doc_id", "leaf", "tampered"]
    ranked = (known.filter("not crowded").join(directory.select("key", "bucket", "bits", "before_block"), ["key", "bucket"])
              .withColumn("slot", F.col("base") + _bits_below()).select(*out))
    if places.filter("crowded").isEmpty():
        return ranked
    crowded = running_sum(places.join(directory.select("key", "bucket", "rows"), ["key", "bucket"]).filter("crowded"),
                          order, "rows", "sorted_before").select("key", "bucket", "sorted_before")
    ties = dense_positions(known.filter("crowded"), [*order, F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("uid")], "at")
    ties = ties.join(crowded, ["key", "bucket"]).withColumn("slot", F.col("base") + F.col("at") - F.col("sorted_before"))
    return ranked.unionByName(ties.select(*out))


# ------------------------------------------------------------ levels

def _depth(n: Column) -> Column:
    """Levels above n leaves, each a third of the one below."""
    return F.size(F.filter(F.array(*[F.lit(3 ** k).cast("long") for k in range(40)]), lambda x: x < n))


def _with_levels(runs: DataFrame, levels: int) -> DataFrame:
    """Columns a0 .. a<levels>: the run's slot array, level by level; levels
    that its tree does not have repeat the last."""
    def parents(a: str) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 3).cast("int"))
        return F.transform(places, lambda i: F.sha2(F.concat_ws("", *[F.get(a, 3 * i + d) for d in range(3)]), 256))

    out = runs.withColumn("a0", F.transform("slots", lambda x: x["digest"]))
    for k in range(levels):
        out = out.withColumn(f"a{k + 1}", F.when(F.col("depth") > k, parents(f"a{k}")).otherwise(F.col(f"a{k}")))
    return out


def _runs(nodes: DataFrame, done: int, levels: int) -> DataFrame:
    """Nodes (s, n, slot, digest, ...) as rows of neighbouring slots, with the
    number of levels that the run reduces; ``done`` levels lie below."""
    more = [c for c in nodes.columns if c not in ("s", "n", "slot", "digest")]
    return (nodes.groupBy("s", "n", F.floor(F.col("slot") / 3 ** levels).cast("long").alias("run"))
            .agg(F.sort_array(F.collect_list(F.struct("slot", "digest", *more))).alias("slots"))
            .withColumn("depth", F.greatest(F.lit(0), F.least(F.lit(levels), _depth(F.col("n")) - done))))


def _climb(nodes: DataFrame, deepest: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each round, written, and the one node (s, digest) of each tree."""
    rounds = []
    for done in range(0, max(1, deepest), levels):
        rounds.append(saved(_runs(nodes, done, levels), "runs"))
        nodes = _with_levels(rounds[-1], levels).select("s", "n", F.col("run").alias("slot"), F.get(f"a{levels}", F.lit(0)).alias("digest"))
    return rounds, nodes.select("s", "digest")


def _siblings(levels: int, i: Column) -> Column:
    """(left, right) siblings of slot ``i`` of a run at each level it reduces."""
    steps = []
    for k in range(levels):
        at = F.floor(i / 3 ** k).cast("int")
        p = at % 3
        get = lambda d, a=f"a{k}", first=at - p: F.get(a, first + d)
        left = F.concat_ws("", F.when(p > 0, get(0)), F.when(p > 1, get(1)))
        right = F.concat_ws("", F.when(p < 1, get(1)), F.when(p < 2, get(2)))
        steps.append(F.when(F.col("depth") > k, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def _descend(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The nodes of the first round with their ``path`` to the root; ``above``
    has (s, slot = 0, path, ...) for each tree."""
    down = [c for c in above.columns if c not in ("s", "slot", "path")]
    for runs in reversed(rounds):
        known = runs.join(above.withColumnRenamed("slot", "run"), ["s", "run"])
        own = F.transform("slots", lambda x, i: F.struct(x.alias("node"), F.concat(_siblings(levels, i), F.col("path")).alias("path")))
        # The outer form, since Spark would push a filter on size(own) below the levels and compute them twice.
        above = (_with_levels(known, levels).select("s", *down, F.explode_outer(own).alias("x"))
                 .select("s", *down, "x.node.*", "x.path"))
        above = saved(above, "paths") if runs is not rounds[0] else above
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, path (left and right
    siblings, level by level), folded_root and verified."""
    rows = saved(leaves(docs), "leaves")
    nodes = placed(rows).withColumnRenamed("leaf", "digest")
    n_max = rows.groupBy("key").count().agg(F.max("count"), F.count("*")).first()
    largest, n_sources = n_max[0] or 0, n_max[1]

    def deep(n: int) -> int:
        return next(k for k in range(64) if 3 ** k >= n)

    rounds, subroots = _climb(nodes, deep(largest), levels)
    top = subroots.select(F.lit(0).cast("long").alias("s"), F.lit(n_sources).cast("long").alias("n"), F.col("s").alias("slot"), "digest")
    top_rounds, roots = _climb(top, deep(n_sources), levels)
    root = roots.first()
    root_digest = F.lit(root.digest if root else None).cast("string")
    spark = docs.sparkSession
    start = spark.range(1).select(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("slot"),
                                  F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"))
    above = _descend(top_rounds, start, levels).select(F.col("slot").alias("s"), F.lit(0).cast("long").alias("slot"), "path",
                                                       F.col("digest").alias("subroot"))
    found = _descend(rounds, saved(above, "subroots"), levels)
    return (found.withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("path")))
            .select("doc_id", F.col("digest").alias("leaf"), "subroot", root_digest.alias("root"), "path", "folded_root",
                    (F.col("folded_root") == root_digest).alias("verified")))


def proof_sha256() -> Column:
    """Digest of a row's siblings from its leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)


#: The same in DuckDB, with its own crc32 and level-by-level trees.
SQL = r"""
WITH RECURSIVE given AS (
    SELECT *, CASE WHEN list_reduce(list_prepend(4294967295, list_transform(string_split(COALESCE(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
                  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) & 1 = 1
              THEN replace(text, chr(10), '') ELSE text END AS held
    FROM documents),
coded AS (
    SELECT *, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
                     CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                     CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                     CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head
    FROM given),
leaves AS (
    SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
           sha256(head || CASE WHEN held IS NULL THEN '-' ELSE strlen(held) || ':' || held END) AS held_leaf,
           ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos
    FROM coded),
nodes AS (
    SELECT source, 0 AS lvl, pos, leaf AS h, COUNT(*) OVER (PARTITION BY source) AS n FROM leaves
    UNION ALL
    SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), ANY_VALUE((n + 2) // 3)
    FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // 3),
subroots AS (
    SELECT source, lvl AS depth, h AS subroot, ROW_NUMBER() OVER (ORDER BY source COLLATE C NULLS FIRST) - 1 AS place
    FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS lvl, place AS pos, subroot AS h, COUNT(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), ANY_VALUE((n + 2) // 3)
    FROM tops WHERE n > 1 GROUP BY lvl, pos // 3),
steps AS (
    SELECT l.doc_id, n.lvl AS step, n.pos, l.pos // power(3, n.lvl)::BIGINT AS own, n.h
    FROM leaves l JOIN nodes n ON n.source IS NOT DISTINCT FROM l.source AND n.n > 1
         AND n.pos // 3 = l.pos // power(3, n.lvl + 1)::BIGINT
    UNION ALL
    SELECT l.doc_id, s.depth + t.lvl, t.pos, s.place // power(3, t.lvl)::BIGINT, t.h
    FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.n > 1
         AND t.pos // 3 = s.place // power(3, t.lvl + 1)::BIGINT),
parts AS (
    SELECT doc_id, step, COALESCE(string_agg(h, '' ORDER BY pos) FILTER (pos < own), '') || '|'
           || COALESCE(string_agg(h, '' ORDER BY pos) FILTER (pos > own), '') AS part
    FROM steps GROUP BY doc_id, step),
paths AS (SELECT doc_id, list(part ORDER BY step) AS path FROM parts GROUP BY doc_id),
folded AS (
    SELECT l.*, COALESCE(path, []) AS path,
           list_reduce(list_prepend(held_leaf, COALESCE(path, [])),
               lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root
    FROM leaves l LEFT JOIN paths p ON p.doc_id IS NOT DISTINCT FROM l.doc_id)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
       folded_root, folded_root = t.h AS verified
FROM folded f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source JOIN tops t ON t.n = 1
"""
