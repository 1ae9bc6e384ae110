"""Benchmark decontamination with an FM-index per training shard (operator 3).

Every task cuts its documents into shards of about ``SHARD_BYTES`` of text and
builds, over the words of a shard, a suffix array, its Burrows-Wheeler
transform in a wavelet matrix and sampled suffix positions.  All windows of
the benchmark are searched backward at once through wavelet ranks; the rows
found are located by stepping to a sampled position; the words they cover are
merged into removal spans.  Documents are neither shuffled nor joined, and a
shard's index lives only while its documents are searched.

A document's words end in a sentinel of its own, so suffixes of copies differ
and no window runs over a document's end.

The windows travel to the tasks in blocks of benchmark items of about
``BLOCK_BYTES``; a larger benchmark makes more passes over the documents.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing
A-Z.  A window is ``window`` consecutive words of an item; a shorter item, if
it has any word, is one window.

Cases: a null or wordless text has no words and no hits; a null or wordless
item has no windows; an item without an id hits words, and is listed as the
empty string; items that repeat an id count once; an empty benchmark leaves
every document clean; an empty table gives no rows; repeated rows each get a
row; columns that are neither used nor asked for by ``keep`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylab.llm.common import small_batches

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
SAMPLE_EVERY = 16
_LOCATE_ROWS = 1 << 18

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of non-ASCII characters, blanks the rest.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def split_words(raws: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts in order; bytes where each starts and ends in the
    joined texts (one blank after each); words per text; start of each text."""
    joined = np.frombuffer(b" ".join(raws).translate(_TABLE) + b" ", np.uint8)
    inside = joined != 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])
    text_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)])
    return words, starts, ends, np.diff(np.searchsorted(starts, text_at)), text_at[:-1]


# ------------------------------------------------------------ the index

def suffix_array(seq: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes of ``seq`` (whose last symbol is unique), by
    prefix doubling that sorts only what is still tied."""
    n, bits = len(seq), max(1, (symbols - 1).bit_length())
    packed = min(4, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key <<= bits
        key[:max(0, n - k)] |= seq[k:]
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n + 1, bool)
    new[1:n] = key[1:] != key[:-1]
    slot = np.arange(n)
    first = np.maximum.accumulate(np.where(new[:n], slot, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    slots, h = slot[~(new[:n] & new[1:])], packed
    while len(slots):
        pos = sa[slots]
        key = rank[pos] * n + rank[np.minimum(pos + h, n - 1)]
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[slots] = pos
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        rank[pos] = slots[np.maximum.accumulate(np.where(new[:-1], np.arange(len(slots)), 0))]
        slots, h = slots[~(new[:-1] & new[1:])], 2 * h
    return sa


class Bits:
    """Bit vector with rank by word counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        low = self.words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[i >> 6] + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        cur = values.astype(np.uint32)
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (cur >> np.uint32(shift) & np.uint32(1)).astype(bool)
            zero = cur[~ones]
            self.levels.append((shift, Bits(ones), len(zero)))
            cur = np.concatenate([zero, cur[ones]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        start = np.zeros(len(c), np.int64)
        for shift, bits, zeros in self.levels:
            one = (c >> shift & 1).astype(bool)
            ra, ri = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + ra, start - ra), np.where(one, zeros + ri, i - ri)
        return i - start

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its occurrences before i."""
        c, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            c |= one.astype(np.int64) << shift
            ra, ri = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + ra, start - ra), np.where(one, zeros + ri, i - ri)
        return c, i - start


class FMIndex:
    """Index of a symbol sequence of documents, each ended by a sentinel.
    ``doc_starts`` are sampled, so no walk leaves its document."""

    def __init__(self, seq: np.ndarray, symbols: int, doc_starts: np.ndarray):
        sa = suffix_array(seq, symbols)
        self.n = len(seq)
        self.wavelet = WaveletMatrix(seq[sa - 1], symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        starts = np.zeros(self.n, bool)
        starts[::SAMPLE_EVERY] = True
        starts[doc_starts] = True
        sampled = starts[sa]
        self.sampled, self.positions = Bits(sampled), sa[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the patterns, right-aligned rows of
        symbols: -1 where a pattern is shorter, -2 for a symbol not in the text."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        high[(patterns == -2).any(axis=1)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            at = np.flatnonzero((low < high) & (patterns[:, k] >= 0))
            c = patterns[at, k]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low[at], high[at]]))
            low[at], high[at] = self.less[c] + both[:len(at)], self.less[c] + both[len(at):]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out = np.empty(len(rows), np.int64)
        left, row, steps = np.arange(len(rows)), rows, 0
        while len(left):
            hit = self.sampled.get(row).astype(bool)
            out[left[hit]] = self.positions[self.sampled.rank(row[hit])] + steps
            left, row = left[~hit], row[~hit]
            if len(left):
                c, r = self.wavelet.symbol_and_rank(row)
                row = self.less[c] + r
            steps += 1
        return out


# ------------------------------------------------------------ benchmark windows

class Windows:
    """Distinct windows of benchmark items, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
            for k in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[k:k + window]), set()).add(item or "")
        self.vocabulary = sorted({w for t in found for w in t})
        at = {w: k for k, w in enumerate(self.vocabulary)}
        self.patterns = np.full((len(found), window), -1, np.int64)
        for row, t in enumerate(found):
            self.patterns[row, window - len(t):] = [at[w] for w in t]
        self.lengths = np.array([len(t) for t in found], np.int64)
        self.items = sorted(set().union(*found.values())) if found else []
        number = {x: k for k, x in enumerate(self.items)}
        per = [sorted(number[x] for x in v) for v in found.values()]
        self.item_from = np.concatenate([[0], np.cumsum([len(p) for p in per])]).astype(np.int64)
        self.item_of = np.array([x for p in per for x in p], np.int64)


class Shard:
    """The words of some documents, searched for windows."""

    def __init__(self, raws: list[bytes]):
        self.raws = raws
        self.words, self.starts, self.ends, self.n_words, self.text_at = split_words(raws)
        coded = self.words.dictionary_encode()
        docs, n = len(raws), len(self.words)
        self.vocabulary = coded.dictionary
        self.symbols = docs + len(self.vocabulary)
        # Document d's word i stands at i + d; its sentinel, symbol d, after its last word.
        doc = np.repeat(np.arange(docs), self.n_words)
        self.doc_from = np.concatenate([[0], np.cumsum(self.n_words)]) + np.arange(docs + 1)
        self.seq = np.empty(n + docs, np.int64)
        self.seq[np.arange(n) + doc] = coded.indices.to_numpy(zero_copy_only=False) + docs
        self.seq[self.doc_from[1:] - 1] = np.arange(docs)

    def search(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(hit flag of every position, distinct pairs document * items + item)."""
        hit = np.zeros(len(self.seq) + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        if len(w.lengths) and len(self.words):
            known = pc.index_in(pa.array(w.vocabulary, pa.large_binary()), value_set=self.vocabulary)
            known = known.fill_null(-2 - len(self.raws)).to_numpy().astype(np.int64) + len(self.raws)
            patterns = np.where(w.patterns >= 0, known[w.patterns], -1)
            index = FMIndex(self.seq, self.symbols, self.doc_from[:-1])
            low, high = index.search(patterns)
            found = np.flatnonzero(low < high)
            count = (high - low)[found]
            upto = np.cumsum(count)
            for a in range(0, int(upto[-1]) if len(upto) else 0, _LOCATE_ROWS):
                k = np.arange(a, min(a + _LOCATE_ROWS, int(upto[-1])))
                which = np.searchsorted(upto, k, side="right")
                pattern = found[which]
                pos = index.locate(low[pattern] + k - (upto - count)[which])
                np.add.at(hit, pos, 1)
                np.add.at(hit, pos + w.lengths[pattern], -1)
                doc = np.searchsorted(self.doc_from, pos, side="right") - 1
                seen = np.unique(doc * len(w.lengths) + pattern)
                doc, pattern = seen // len(w.lengths), seen % len(w.lengths)
                n = w.item_from[pattern + 1] - w.item_from[pattern]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.item_from[pattern], n)
                pairs.append(np.unique(np.repeat(doc, n) * len(w.items) + w.item_of[at]))
        return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs))


# ------------------------------------------------------------ operator

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the byte spans; what is left on both sides keeps a line apart."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a].decode("utf-8", "replace"))
        at = b
    kept.append(raw[at:].decode("utf-8", "replace"))
    return "\n".join(x for x in kept if x.strip())


def _searched(held: pa.RecordBatch, windows: Windows) -> pa.RecordBatch:
    """One block's result for the rows of a shard: columns text, n_words, hits
    (u8 flag a word, as binary), items, and the rest as they came."""
    raws = [(t or "").encode("utf-8", "replace") for t in held.column(0).to_pylist()]
    shard = Shard(raws)
    flags, pairs = shard.search(windows)
    before_hits, before_items = held.column(1).to_pylist(), held.column(2).to_pylist()
    docs = len(raws)
    items_at = np.searchsorted(pairs, np.arange(docs + 1) * max(1, len(windows.items)))
    hits, items = [], []
    for d in range(docs):
        own = np.packbits(flags[shard.doc_from[d]:shard.doc_from[d + 1] - 1])
        if not own.any():
            own = own[:0]
        if before_hits[d]:
            old = np.frombuffer(before_hits[d], np.uint8)
            own = old if not len(own) else own | old
        hits.append(own.tobytes())
        items.append((before_items[d] or []) + [windows.items[k % len(windows.items)]
                                                for k in pairs[items_at[d]:items_at[d + 1]]])
    return pa.RecordBatch.from_arrays(
        [held.column(0), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), *held.columns[3:]],
        names=held.schema.names)


def _finished(held: pa.RecordBatch, clean: bool) -> pa.RecordBatch:
    """Counts, merged word spans and, if asked for, the text without them."""
    texts, hits = held.column(0).to_pylist(), held.column(1).to_pylist()
    _, starts, ends, n_words, text_at = split_words([(t or "").encode("utf-8", "replace") for t in texts])
    word_at = np.concatenate([[0], np.cumsum(n_words)])
    n_hit, spans, cleaned = [], [], []
    for d, (text, hit) in enumerate(zip(texts, hits)):
        runs = np.zeros(0, np.int64)
        if hit:
            flags = np.unpackbits(np.frombuffer(hit, np.uint8), count=int(n_words[d]))
            runs = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
        a, b = runs[::2], runs[1::2]
        n_hit.append(int((b - a).sum()))
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
        if clean and len(a):
            first = word_at[d]
            text = _cut(text.encode("utf-8", "replace"), list(zip(
                (starts[first + a] - text_at[d]).tolist(), (ends[first + b - 1] - text_at[d]).tolist())))
        cleaned.append(text)
    items = [sorted(set(x or [])) for x in held.column(2).to_pylist()]
    out = [pa.array(n_words.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array(spans, _SPANS),
           pa.array(items, pa.list_(pa.string())), *([pa.array(cleaned, pa.string())] if clean else []), *held.columns[3:]]
    return pa.RecordBatch.from_arrays(out, names=[f"c{k}" for k in range(len(out))])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches dealt anew, each of at least SHARD_BYTES or the task's last."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            held.append(part)
            size += part.column(0).nbytes
            if size >= SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_RESULT = (
    T.StructType().add("n_words", T.LongType()).add("n_hit", T.LongType())
    .add("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))
    .add("items", T.ArrayType(T.StringType())))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, clean: bool, keep: tuple[str, ...],
           block_bytes: int) -> tuple[DataFrame, list[str]]:
    """Columns c0, c1 ... and their names: the result's, then those of ``keep``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    rows = docs.select(F.col("text").alias("text"), F.lit(None).cast("binary").alias("hits"),
                       F.lit(None).cast("array<string>").alias("items"),
                       *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)])
    small_batches(spark)
    last = None
    for b in range(blocks):
        held = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast(Windows([(r.item_id, r.text) for r in held], window))
        if b < blocks - 1:
            rows = rows.mapInArrow(
                lambda batches, sent=sent: (_searched(s, sent.value) for s in _shards(batches)), rows.schema)
        else:
            last = sent
    fields = [*_RESULT, *([T.StructField("text", T.StringType())] if clean else []), *[docs.schema[c] for c in keep]]
    inner = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last block is searched in the same pass that finishes the rows
        if last is not None:
            batches = (_searched(s, last.value) for s in _shards(batches))
        for b in batches:
            yield _finished(b, clean)
    return rows.mapInArrow(finish, inner), [f.name for f in fields]


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, clean: bool = False,
                  keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """n_words, n_hit, spans (merged runs of hit words, as word numbers, end
    exclusive), items (ids with a window in the document, sorted as strings),
    with ``clean`` the text without those runs, and the ``keep`` columns."""
    found, names = _found(docs, benchmark, window, clean, keep, block_bytes)
    return found.toDF(*names)


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without benchmark passages: hit words go from the text (and
    ``n_chars``, if there, follows); a document all of whose words are hit goes;
    documents without a hit stay as they are."""
    others = tuple(c for c in docs.columns if c != "text")
    found, _ = _found(docs, benchmark, window, True, others, BLOCK_BYTES)
    left = found.filter("c1 = 0 or c1 < c0")
    column = {"text": F.col("c4")} | {c: F.col(f"c{5 + k}") for k, c in enumerate(others)}
    if "n_chars" in column:
        column["n_chars"] = F.when(F.col("c1") > 0, F.length("c4").cast(docs.schema["n_chars"].dataType)).otherwise(
            column["n_chars"])
    return left.select(*[column[c].alias(c) for c in docs.columns])
