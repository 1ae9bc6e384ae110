"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 4).

A text's 64-bit fingerprint is the majority vote of the XXH64 hashes of its
word shingles.  Distinct fingerprints within ``max_distance`` bits are found so:

* The 64 bits are cut into three segments (22, 21 and 21 bits), each a word of
  the perfect (23, 12) Golay code after zero padding.  Decoding gives the index
  of the nearest codeword; decoding the segment and all its one-bit neighbours
  gives the few indices that a segment one bit away can decode to.
* Pigeonhole: of two errors, some segment has none and the next one round the
  circle at most one; of three errors, some two segments have at most one each.
  A key is therefore an error-free segment (or, for three errors, a codeword
  index) with a codeword index.  A fingerprint stands in a bucket under its own
  ("home") index and under the indices of its neighbours; a home entry and any
  other entry of the bucket are verified by the Hamming distance.
* Buckets of more than ``BUCKET`` entries are not paired.  Their fingerprints
  go another exact way: everyone emits all points within ``max_distance // 2``
  bits (and, for an odd distance, each with one bit cleared).  Fingerprints are
  near exactly when they share a point, a point has a bounded number of
  fingerprints around it, and each links to the least of them.

Equal fingerprints are one node from the start, so copies never meet in pairs.
Links become groups by star contraction (``graph.components``).

Cases: a null or wordless text has fingerprint zero and is linked like any
other; a text of fewer words than a shingle is one shingle; a null ``doc_id``
takes part but is no component id, and a component of none but null ids has a
null id; repeated rows each get a row; an empty table gives none; columns other
than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylab.llm.common import saved, small_batches
from querylab.llm.graph import components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
BUCKET = 128
_CHUNK = 1 << 16

# Fixed value: a generator polynomial of the (23, 12) Golay code.
_GENERATOR = 0b101011100011


# ------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (repeats count)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k:k + _CHUNK], ends[k:k + _CHUNK])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _text_hash():
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), "text")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of whole texts; fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)],
                                             names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, fp long")


# ------------------------------------------------------------ Golay keys

@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of each syndrome."""
    def syndrome(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= _GENERATOR << (k - 11)
        return v

    low = np.array([syndrome(v) for v in range(1 << 12)], np.int64)
    high = np.array([syndrome(v << 12) for v in range(1 << 11)], np.int64)
    error = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in itertools.combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[low[e & 0xFFF] ^ high[e >> 12]] = e
    return low, high, error


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within three bits of each 23-bit word."""
    low, high, error = _golay()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def near_indices(words: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, index) of every other codeword index that a word one bit (of the
    low ``bits``) away decodes to; each once, without the word's own index."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    idx = np.sort(codeword_index(words[:, None] ^ flips), axis=1)
    keep = np.ones(idx.shape, bool)
    keep[:, 1:] = idx[:, 1:] != idx[:, :-1]
    keep &= idx != codeword_index(words)[:, None]
    row, col = np.nonzero(keep)
    return row, idx[row, col]


def bucket_entries(fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, home) of all buckets that each fingerprint stands in."""
    u = fp.astype(np.uint64)
    seg = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [near_indices(s, n) for s, (_, n) in zip(seg, SEGMENTS)]
    home = [codeword_index(s) for s in seg]
    rows = np.arange(len(fp))
    out = []
    if max_distance <= 2:
        for t, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))):
            base = (t << 34 | seg[i]) << 12
            out.append((base | home[j], rows, True))
            out.append((base[near[j][0]] | near[j][1], near[j][0], False))
        # the exact segment is at most 22 bits wide, so t stands above it
    else:
        for t, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))):
            sets = []
            for s in (i, j):
                order = np.concatenate([rows, near[s][0]])
                sets.append((order, np.concatenate([home[s], near[s][1]]), order.argsort(kind="stable")))
            (ra, ka, oa), (rb, kb, ob) = sets
            ra, ka, rb, kb = ra[oa], ka[oa], rb[ob], kb[ob]
            per_b, first_b = np.bincount(rb, minlength=len(fp)), np.searchsorted(rb, rows)
            n = per_b[ra]
            left = np.repeat(np.arange(len(ra)), n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[ra], n)
            row, a, b = ra[left], ka[left], kb[right]
            out.append(((t << 12 | a) << 12 | b, row, (a == home[i][row]) & (b == home[j][row])))
    key = np.concatenate([k for k, _, _ in out])
    return key, np.concatenate([r for _, r, _ in out]), np.concatenate(
        [np.broadcast_to(h, len(r)) for _, r, h in out])


def points(fp: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, cleared bit or -1, row): two fingerprints share an entry exactly
    when they are within ``max_distance`` bits."""
    u = fp.astype(np.uint64)
    flips = [0] + ([1 << b for b in range(64)] if max_distance >= 2 else [])
    clear = list(range(64)) if max_distance % 2 else [-1]
    near = (u[:, None] ^ np.array(flips, np.uint64)).ravel()
    row = np.repeat(np.arange(len(fp)), len(flips))
    mask = np.array([0 if c < 0 else 1 << c for c in clear], np.uint64)
    point = (near[:, None] & ~mask).ravel().astype(np.int64)
    return point, np.tile(np.array(clear, np.int64), len(near)), np.repeat(row, len(clear))


# ------------------------------------------------------------ operator

def _buckets(nodes: DataFrame, max_distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            key, row, home = bucket_entries(fp, max_distance)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(home)],
                                             names=["key", "fp", "home"])
    return nodes.select("fp").mapInArrow(run, "key long, fp long, home boolean")


def _points(nodes: DataFrame, max_distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k in range(0, len(fp), 1000):
                part = fp[k:k + 1000]
                point, bit, row = points(part, max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(bit), pa.array(part[row])],
                                                 names=["point", "bit", "fp"])
    return nodes.select("fp").mapInArrow(run, "point long, bit long, fp long")


def links(nodes: DataFrame, max_distance: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``nodes(fp)``: a pair is
    within ``max_distance`` bits, and every such pair is joined by the edges."""
    if not 0 <= max_distance <= 3:
        raise ValueError("three segments serve distances 0 to 3")
    entries = _buckets(nodes, max_distance)
    crowded = saved(entries.groupBy("key").count().filter(F.col("count") > bucket).select("key"), "crowded")
    near = lambda a, x: (x != a) & (F.bit_count(x.bitwiseXOR(a)) <= max_distance)
    held = (entries.join(crowded, "key", "left_anti").groupBy("key")
            .agg(F.collect_list("fp").alias("fps"),
                 F.collect_list(F.when(F.col("home"), F.col("fp"))).alias("homes"))
            .filter((F.size("fps") > 1) & (F.size("homes") > 0)))
    pairs = held.select(F.explode(F.flatten(F.transform("homes", lambda a: F.transform(
        F.filter("fps", lambda x: near(a, x)),
        lambda x: F.struct(F.least(a, x).alias("a"), F.greatest(a, x).alias("b")))))).alias("e")).select("e.*")
    members = entries.join(crowded, "key", "left_semi").select("fp").distinct()
    around = (_points(members, max_distance).groupBy("point", "bit").agg(F.collect_set("fp").alias("fps"))
              .filter(F.size("fps") > 1))
    stars = (around.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """One row a document: doc_id, text_hash, fp (signed long), root (the least
    fingerprint of the group) and component_id (its least doc_id)."""
    small_batches(docs.sparkSession)
    fps = saved(fingerprints(docs, shingle), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes, max_distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(named, "root")
    return fps.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the least doc_id (null last), of
    rows that repeat it in the group the one whose text has the least hash."""
    found = near_duplicates(docs, shingle, max_distance)
    first = (found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("kept"))
             .select(F.coalesce("kept.doc_id", F.lit(0)).alias("id"), F.col("kept.text_hash").alias("hash")))
    # The given row travels packed, so its columns may have any names.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                        _text_hash().alias("hash"))
    # The join leaves the rows dealt and sorted by these keys, as the last step needs them.
    kept = keyed.join(first, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
