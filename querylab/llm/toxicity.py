"""Toxicity scores from a factorization machine over hashed terms (operator 8).

Terms are the distinct words of a whole text and the first bytes of its longer
words (stems shared by inflected forms), hashed into buckets.  A second-order
factorization machine gives every chosen bucket a weight and a vector; the
vectors' products weigh pairs of terms, which additive weights cannot.

Fitting uses at most ``SAMPLE`` labelled rows: those with the least hash of
their id.  That bound also bounds the rows sent to the driver, the buckets kept
(``FEATURES``, by their association with the label) and the model broadcast to
the tasks.  Scoring covers every document, without a shuffle.

Only the text enters a score.  Rows whose crc32 of the id's text is divisible
by ``HOLD_OUT`` never enter the fit.

Cases: a null or wordless text has no terms and gets the base score; a null id
counts as the empty string and is held out; rows that repeat a document each
get a row; a label that is null is no label, and of labels that disagree the
higher counts; with no labelled rows, or a single class, every score is the
share of toxic labels (0 without any); an empty table gives no rows; columns
not asked for by ``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylab.llm.common import saved, small_batches

SAMPLE = 20_000
BUCKETS = 1 << 20
FEATURES = 2048
FACTORS = 8
HOLD_OUT = 5
STEMS = (4, 5, 6, 7)
_MEMORY = 200_000

#: Lower-cases A-Z, keeps 0-9, a-z and non-ASCII characters, blanks the rest.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def word_buckets(word: bytes) -> list[int]:
    """Buckets of a word and of its stems."""
    return [zlib.crc32(t) % BUCKETS for t in (word, *(b"^" + word[:k] for k in STEMS if len(word) > k))]


def text_words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").translate(_TABLE).split())


@dataclass
class Model:
    """``buckets`` (sorted) with their weights and vectors, and the base."""

    base: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Log-odds of texts given as indices of their buckets in the model."""
        out = np.full(len(rows), self.base)
        for k, i in enumerate(rows):
            if len(i):
                v = self.vectors[i]
                out[k] += self.weights[i].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return out


def fit(rows: list[np.ndarray], labels: np.ndarray, n: int, factors: int = FACTORS, epochs: int = 30,
        rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, classes weighed alike on average, by Adam over mini-batches."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return (30.0 if share else -30.0), np.zeros(n), np.zeros((n, factors))
    weigh = np.where(labels > 0, 0.5 / np.sqrt(share), 0.5 / np.sqrt(1 - share))
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(n), rng.normal(0, 0.02, (n, factors))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            part = order[at:at + 256]
            x = np.zeros((len(part), n))
            for k, r in enumerate(part):
                x[k, rows[r]] = 1.0
            b, w, v = theta
            s = x @ v
            z = b[0] + x @ w + 0.5 * ((s * s).sum(axis=1) - x @ (v * v).sum(axis=1))
            g = weigh[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            xg = x.T @ g
            grads = [np.array([g.sum()]), xg + decay * w, x.T @ (g[:, None] * s) - xg[:, None] * v + decay * v]
            step += 1
            for t, d, m, q in zip(theta, grads, first, second):
                m += 0.1 * (d - m)
                q += 0.001 * (d * d - q)
                t -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.999 ** step)) + 1e-8)
    return float(theta[0][0]), theta[1], theta[2]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on at most ``sample`` labelled rows of ``docs(doc_id, text)`` by
    ``labels(doc_id, toxic)`` outside the held-out ids."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.array(sorted({b for w in text_words(t.as_py()) for b in word_buckets(w)}), "<u4").tobytes()
                   for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["toxic", "terms"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[y, np.frombuffer(t, "<u4")] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])],
                                         names=["bucket", "clean", "toxic"])

    known = (labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).filter(~held_out()))
    # At most ``sample`` rows of two numbers, so this side may be broadcast.
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    # A document that repeats its id would pass the bound: one row an id, by its text.
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).drop("doc_id")
    small_batches(docs.sparkSession)
    held = saved(rows.mapInArrow(terms, "toxic int, terms binary"), "terms")
    seen = (held.mapInArrow(counts, "bucket long, clean long, toxic long").groupBy("bucket")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    n0, n1 = held.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n0 or not n1:
        return Model(30.0 if n1 else -30.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))

    def part(own: Column, of: int, other: Column, of_other: int) -> Column:
        """Surprise of one class's count against both classes' common share."""
        share = (own + other) / F.lit(float(of + of_other))
        return F.when(own > 0, own * F.log(own / (share * of))).otherwise(0.0)

    a, b = F.col("clean").cast("double"), F.col("toxic").cast("double")
    gain = sum(part(x, n, y, m) for x, n, y, m in (
        (a, n0, b, n1), (b, n1, a, n0), (n0 - a, n0, n1 - b, n1), (n1 - b, n1, n0 - a, n0)))
    best = seen.filter(a + b >= 3).orderBy(F.round(gain, 6).desc(), "bucket").limit(features).select("bucket").collect()
    buckets = np.array(sorted(r.bucket for r in best), np.int64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(buckets, np.frombuffer(t, "<u4"))).astype("<u4").tobytes()
                   for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["toxic", "terms"])

    got = sorted((r.terms, r.toxic) for r in held.mapInArrow(pick, "toxic int, terms binary").collect())
    base, weights, vectors = fit([np.frombuffer(t, "<u4") for t, _ in got], np.array([y for _, y in got], float), len(buckets))
    return Model(base, buckets, weights, vectors)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and score (0 to 1) of every row's whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        number = {int(b): k for k, b in enumerate(m.buckets)}
        known: dict[bytes, tuple[int, ...]] = {}  # words of this task and their buckets in the model
        for batch in batches:
            rows = []
            for t in batch.column(0):
                words = text_words(t.as_py())
                found = set()
                for w in words:
                    own = known.get(w)
                    if own is None:
                        own = tuple(number[b] for b in word_buckets(w) if b in number)
                        if len(known) < _MEMORY:  # the first words met are the frequent ones
                            known[w] = own
                    found.update(own)
                rows.append(np.array(sorted(found), np.int64))
            p = 1 / (1 + np.exp(-np.clip(m.raw(rows), -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(p), *batch.columns[1:]], names=names)

    fields = [T.StructField("score", T.DoubleType()), *[docs.schema[c] for c in keep]]
    names = [f"c{k}" for k in range(len(fields))]
    inner = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    found = docs.select("text", *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)]).mapInArrow(run, inner)
    return found.select(*[F.col(n).alias(f.name) for n, f in zip(names[1:] + names[:1], fields[1:] + fields[:1])])


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    scored = score(docs, model, tuple(docs.columns))
    return scored.toDF(*[f"c{k}" for k in range(len(scored.columns))]).filter(
        F.col(f"c{len(docs.columns)}") < threshold).drop(f"c{len(docs.columns)}").toDF(*docs.columns)
