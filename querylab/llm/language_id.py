"""Language identification by a byte convolutional network (operator 13).

Text is the UTF-8 bytes of its lower-cased words, ASCII signs and digits being
no more than word ends, cut into windows of ``WINDOW`` bytes that overlap by a
filter's width, so no window boundary hides a sequence.
Bytes become small vectors; filters of widths 2 to 5 run over them, each
filter's greatest value in the window is taken, and a softmax over the learned
languages follows.  A text's log-probabilities are the mean of its windows',
each weighed by its bytes.  All windows of a text are read.

The network is trained here, in numpy, on the driver: on at most ``SAMPLE``
documents (an equal number for each language, those with the least hash of
their id; one for each if there are more languages than that) and at most
``WINDOWS`` windows of each, spread over its text; some are cut short, as short
texts are.  These bounds also bound what is sent to the driver; the model is a
few hundred kilobytes at most and is broadcast.  Rows whose crc32 of the id's
text is divisible by ``HOLD_OUT`` never enter the fit.  Scoring reads every
document, without a shuffle, in batches of ``BATCH`` windows.

Cases: null text and text without a letter are ``und`` with score 0; a null id
counts as the empty string and is held out; rows that repeat a document each
get a row, in the fit the least text of an id and language counts; a null
``lang`` is no label; without labels everything is ``und``; with one language
all text with a letter is of it; an empty table gives no rows; columns not
asked for by ``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylab.llm.common import saved, small_batches

SAMPLE = 2_400
WINDOWS = 2
WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 16
DIMENSION = 8
BATCH = 128
HOLD_OUT = 5
UNKNOWN = "und"

_PAD = 256
_WORDS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEP = WINDOW - max(WIDTHS) + 1


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def text_bytes(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_WORDS).split())


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, padded, and the bytes that each adds to them."""
    n = max(1, -(-(len(raw) - (WINDOW - _STEP)) // _STEP))
    codes = np.full((n - 1) * _STEP + WINDOW, _PAD, np.int16)
    codes[:len(raw)] = np.frombuffer(raw, np.uint8)
    cut = np.lib.stride_tricks.sliding_window_view(codes, WINDOW)[::_STEP]
    own = np.minimum(_STEP, len(raw) - np.arange(n) * _STEP)
    return cut, np.maximum(own, 1)


# ------------------------------------------------------------ network

@dataclass
class Network:
    """Byte vectors [257, d], filters [width_max * d, n], their bias, and the
    softmax layer.  Narrow filters have zeros where they do not reach."""

    langs: list[str]
    bytes: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    base: np.ndarray

    def patches(self, codes: np.ndarray) -> np.ndarray:
        """The vectors under every position of the widest filter, side by side."""
        x = self.bytes[codes].reshape(len(codes), -1)
        d, wide = DIMENSION, max(WIDTHS)
        return np.lib.stride_tricks.sliding_window_view(x, wide * d, axis=1)[:, ::d]

    def pooled(self, codes: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        found = np.ascontiguousarray(self.patches(codes)).reshape(-1, len(self.filters)) @ self.filters
        found = found.reshape(len(codes), -1, self.filters.shape[1])
        best = found.max(axis=1) + self.bias
        return np.maximum(best, 0), found.argmax(axis=1) if where else None

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        z = self.pooled(codes)[0] @ self.top + self.base
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def reach() -> np.ndarray:
    """1 where a filter has a weight, 0 beyond its width."""
    rows = np.repeat(np.arange(max(WIDTHS)), DIMENSION)[:, None]
    return (rows < np.repeat(WIDTHS, FILTERS)[None]).astype(np.float32)


def fit(codes: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 10, rate: float = 0.006, seed: int = 5) -> Network:
    """Cross-entropy by Adam over mini-batches; a maximum passes its gradient
    to the one position that it came from."""
    rng = np.random.default_rng(seed)
    n, mask = FILTERS * len(WIDTHS), reach()
    width = mask.sum(axis=0)
    net = Network(langs, rng.normal(0, 0.5, (257, DIMENSION)).astype(np.float32),
                  (rng.normal(0, 1, mask.shape) * mask / np.sqrt(width)).astype(np.float32), np.zeros(n, np.float32),
                  rng.normal(0, 0.1, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    net.bytes[_PAD] = 0
    theta = [net.bytes, net.filters, net.bias, net.top, net.base]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step, size = 0, 64
    steps = epochs * -(-len(codes) // size)
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), size):
            part = order[at:at + size]
            x, y = codes[part].copy(), labels[part]
            # A third of the windows stand for short texts.
            for i in np.flatnonzero(rng.random(len(part)) < 0.33):
                x[i, int(rng.integers(8, WINDOW)):] = _PAD
            h, where = net.pooled(x, True)
            z = h @ net.top + net.base
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y] -= 1
            p /= len(part)
            back = (p @ net.top.T) * (h > 0)
            row = np.arange(len(part))[:, None]
            under = net.patches(x)[row, where]  # batch, filter, patch
            grad_filters = np.einsum("bfk,bf->kf", under, back, optimize=True) * mask
            spread = (back[:, :, None] * net.filters.T[None]).reshape(len(part), n, max(WIDTHS), DIMENSION)
            at_bytes = x[row[:, :, None], where[:, :, None] + np.arange(max(WIDTHS))]
            grad_bytes = np.zeros_like(net.bytes)
            np.add.at(grad_bytes, at_bytes.ravel(), spread.reshape(-1, DIMENSION))
            grad_bytes[_PAD] = 0
            step += 1
            now = rate * (1 - step / (steps + 1))
            for t, d, m, q in zip(theta, [grad_bytes, grad_filters, back.sum(axis=0), h.T @ p, p.sum(axis=0)], first, second):
                m += 0.1 * (d - m)
                q += 0.001 * (d * d - q)
                t -= (now * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


# ------------------------------------------------------------ operator

def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, windows) of at most ``sample`` labelled documents (one a language
    if there are more of these), as many for each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    ids = saved(known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).distinct(), "labelled")
    # A row a language, written so that the planner broadcasts it by its known size.
    sizes = saved(ids.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(1, sample // max(1, sizes.count()))
    # Ids below a hash bound are a few more than asked for (six deviations), so few rows a language are ranked.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = ids.join(sizes, "lang").filter(place * F.col("n") <= each + 6 * each ** 0.5 + 10)
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = some.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= each).select("doc_id", "lang")
    rows = (known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
            .join(F.broadcast(chosen), ["doc_id", "lang"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for text in batch.column(2).to_pylist():
                raw = text_bytes(text)
                some = windows(raw)[0]
                at = np.unique(np.linspace(0, len(some) - 1, WINDOWS).astype(int))
                own.append([raw[i * _STEP:i * _STEP + WINDOW] for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.binary()))],
                                             names=["doc_id", "lang", "windows"])

    small_batches(docs.sparkSession)
    found = rows.mapInArrow(cut, "doc_id long, lang string, windows array<binary>")
    return found.groupBy("doc_id", "lang").agg(F.min("windows").alias("windows")).select("lang", "windows")


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network fitted on ``docs(doc_id, text, lang)`` outside the held-out
    ids; nothing if there is no labelled text."""
    rows = sorted((r.lang, [bytes(w) for w in r.windows]) for r in sampled(docs, sample).collect())
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    number = {lang: k for k, lang in enumerate(langs)}
    cuts = [(windows(w)[0][0], number[lang]) for lang, own in rows for w in own]
    return fit(np.array([c for c, _ in cuts], np.int16), np.array([y for _, y in cuts]), langs)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row's whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            read = [k for k, t in enumerate(texts) if net is not None and t and _has_letter(t)]
            total = np.zeros((len(texts), len(net.langs) if net else 1))
            weight = np.zeros(len(texts))
            # Windows of several texts share a batch; a long text fills several.
            pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            count = 0

            def flush() -> None:
                codes, own, row = (np.concatenate(x) for x in zip(*pending))
                for at in range(0, len(codes), BATCH):
                    to = slice(at, at + BATCH)
                    np.add.at(total, row[to], net.log_probabilities(codes[to]) * own[to, None])
                np.add.at(weight, row, own)

            for k in read:
                codes, own = windows(text_bytes(texts[k]))
                for at in range(0, len(codes), 64 * BATCH):
                    to = slice(at, at + 64 * BATCH)
                    pending.append((codes[to], own[to], np.full(len(own[to]), k)))
                    count += len(own[to])
                    if count >= 8 * BATCH:
                        flush()
                        pending, count = [], 0
            if pending:
                flush()
            z = total / np.maximum(weight, 1)[:, None]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best, some = p.argmax(axis=1), set(read)
            named = [net.langs[best[k]] if k in some else UNKNOWN for k in range(len(texts))]
            score = [float(p[k, best[k]]) if k in some else 0.0 for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.string()), pa.array(score, pa.float64()), *batch.columns[1:]], names=names)

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[docs.schema[c] for c in keep]]
    names = [f"c{k}" for k in range(len(fields))]
    inner = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    found = docs.select("text", *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)]).mapInArrow(run, inner)
    return found.select(*[F.col(n).alias(f.name) for n, f in zip(names[2:] + names[:2], fields[2:] + fields[:2])])
