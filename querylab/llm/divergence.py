"""Source divergence audit (operator 11) by dominance skybands.

Terms are runs of ASCII letters (lower-cased) and non-ASCII characters.  Every
(language, source) group and every language gives each kept term a share p, and
two shares differ by f = floor((p - q)^2 / (p + q)).  The audit lists, for each
group, all other sources of its language by the sum of f over the kept terms,
and the ten terms that the group uses most above its language.

Counting: tasks count terms in numbers of entries held, not in rows of the
input (``ENTRIES``), so one row a (group, term) and task is shuffled.  A kept
term is one row with its counts by source.

Pairs: blocks of terms become count matrices (terms by sources), whose f sums
are added over the tasks, one number a pair of sources.  The sums are symmetric
and a language's pairs are the result itself, so nothing larger than it moves.

Terms: f rises with the group's count and falls with the language's, and ties
go to the earlier term.  So a term dominated by k others (group count no lower,
language count no higher, earlier in UTF-8) is not among the first k, whatever
the totals.  Every partition keeps its k-skyband, skybands are merged by
salted, then by whole groups (a k-skyband of skybands is that of all), and what
is left is ranked by exact f.

All arithmetic is in integers; 10^9 * count is divided in three steps of 10^3,
exact while a group has fewer than 9 * 10^15 occurrences.

Cases: null text, language and source count as empty; a group without terms
still gives every kept term its least share; a language with one source has no
pairs; a language without kept terms has pairs of value 0 and no terms; rows
that repeat a document count again, as documents of their own; ``doc_id`` is
not read; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylab.llm.common import saved, small_batches

LEAST_DOCS = 10
FIRST = 10
SCALE = 10 ** 9
#: Term counts that a task holds before it sends them on, and cells of a count matrix.
ENTRIES = 400_000
CELLS = 1 << 20
_SALTS = 16

#: Lower-cases A-Z, keeps a-z and the bytes of non-ASCII characters, blanks the rest.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def text_terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


# ------------------------------------------------------------ counts

def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) for each group's terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], Counter] = {}
        seen: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in total.items():
                within, words = seen[lang, source], list(own)
                for k in range(0, len(words), 50_000):
                    part = words[k:k + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                         pa.array([own[w] for w in part], pa.int64()), pa.array([within[w] for w in part], pa.int64())],
                        names=["lang", "source", "term", "count", "docs"])
            total.clear()
            seen.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text_terms(text)
                own = total.setdefault((lang, source), Counter())
                held -= len(own)
                own.update(words)
                held += len(own)
                seen.setdefault((lang, source), Counter()).update(set(words))
                if held > ENTRIES:
                    yield from flush()
                    held = 0
        yield from flush()

    small_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = texts.mapInArrow(count, "lang string, source string, term string, count long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, sources, counts): one row a kept term, with the
    sources that have it; a row is no longer than the language has sources."""
    found = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("own"))
    return found.filter(F.col("docs") >= least).select(
        "lang", "term", "total", F.col("own.source").alias("sources"), F.col("own.count").alias("counts"))


# ------------------------------------------------------------ exact shares

def share(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole), exactly."""
    left, out = count + 2, np.zeros_like(count)
    out, left = left // whole, left % whole
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Totals:
    """Of each language: its sources in UTF-8 order, N of each, V and its own N."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.sources: dict[str, list[str]] = {}
        self.wholes: dict[str, np.ndarray] = {}
        self.whole: dict[str, int] = {}
        by: dict[str, list[tuple[bytes, str, int, int]]] = {}
        for lang, source, n, v in rows:
            by.setdefault(lang, []).append((source.encode("utf-8", "surrogatepass"), source, n, v))
        for lang, own in by.items():
            own.sort()
            self.sources[lang] = [s for _, s, _, _ in own]
            self.wholes[lang] = np.array([n + 2 * v for _, _, n, v in own], np.int64)
            self.whole[lang] = sum(n for _, _, n, _ in own) + 2 * own[0][3]


def totals(docs: DataFrame, terms: DataFrame) -> Totals:
    """N and V by (lang, source), one row a group: the groups' pairs are the
    result, so this is at most the square root of what the audit returns."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    found = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy(
        "lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"))
    rows = groups.join(found, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0)))
    return Totals([tuple(r) for r in rows.collect()])


# ------------------------------------------------------------ pairs

def pair_sums(terms: DataFrame, known: Totals) -> DataFrame:
    """(lang, a, b, value): sums of f over the kept terms, for the places a < b
    of a language's sources in UTF-8 order."""
    sent = terms.sparkSession.sparkContext.broadcast(known)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        place = {lang: {s: k for k, s in enumerate(own)} for lang, own in known.sources.items()}
        added: dict[str, np.ndarray] = {}

        def add(lang: str, rows: list[tuple[list[str], list[int]]]) -> None:
            own, n = place[lang], len(place[lang])
            matrix = np.zeros((n, len(rows)), np.int64)
            for k, (sources, counts) in enumerate(rows):
                matrix[[own[s] for s in sources], k] = counts
            for k in range(n):
                matrix[k] = share(matrix[k], int(known.wholes[lang][k]))
            out = added.setdefault(lang, np.zeros((n, n), np.int64))
            for k in range(n - 1):
                out[k, k + 1:] += difference(matrix[k + 1:], matrix[k]).sum(axis=1)

        waiting: dict[str, list[tuple[list[str], list[int]]]] = {}
        for batch in batches:
            for lang, sources, counts in zip(*(c.to_pylist() for c in batch.columns)):
                rows = waiting.setdefault(lang, [])
                rows.append((sources, counts))
                if len(rows) * len(place[lang]) >= CELLS:
                    add(lang, waiting.pop(lang))
        for lang, rows in waiting.items():
            add(lang, rows)
        for lang, out in added.items():
            for k in range(len(out) - 1):
                n = len(out) - k - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n), pa.array([k] * n, pa.int32()), pa.array(np.arange(k + 1, k + 1 + n), pa.int32()),
                     pa.array(out[k, k + 1:])], names=["lang", "a", "b", "value"])

    found = terms.select("lang", "sources", "counts").mapInArrow(sums, "lang string, a int, b int, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pairs(docs: DataFrame, terms: DataFrame, known: Totals) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a language's sources."""
    spark = docs.sparkSession
    named = spark.createDataFrame([(lang, k, s, len(own)) for lang, own in known.sources.items() for k, s in enumerate(own)],
                                  "lang string, place int, source string, n int")
    # A language without kept terms has no sums: its pairs come from the places.
    places = named.select("lang", F.col("place").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b")).filter("a < b")
    both = places.join(pair_sums(terms, known), ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    turned = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    first = named.select("lang", F.col("place").alias("a"), "source")
    second = named.select("lang", F.col("place").alias("b"), F.col("source").alias("item"))
    return turned.join(first, ["lang", "a"]).join(second, ["lang", "b"]).select("lang", "source", "item", "value")


# ------------------------------------------------------------ terms

def skyband(own: np.ndarray, total: np.ndarray, k: int) -> np.ndarray:
    """Places of the points dominated by fewer than ``k`` others; the points
    come in UTF-8 order of their terms, so only earlier ones dominate.

    Counting the kept dominators is enough: of a point's dominators, the first
    k in any order that dominance respects are all in the skyband."""
    # Equal points first: at most k of each place enter the comparison.
    order = np.lexsort((np.arange(len(own)), total, own))
    start = np.ones(len(order), bool)
    start[1:] = (own[order][1:] != own[order][:-1]) | (total[order][1:] != total[order][:-1])
    firsts = np.flatnonzero(start)
    nth = np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order))))
    some = np.sort(order[nth < k])
    kept = np.zeros(0, np.int64)
    for at in range(0, len(some), 512):
        part = some[at:at + 512]
        a, b = own[part], total[part]
        n = ((own[kept] >= a[:, None]) & (total[kept] <= b[:, None])).sum(axis=1)
        n += np.tril((a >= a[:, None]) & (b <= b[:, None]), -1).sum(axis=1)
        kept = np.concatenate([kept, part[n < k]])
    return kept


_CANDIDATE = "lang string, source string, term string, own long, total long"


def _skybands(k: int):
    """The k-skyband of each group's points in a task, holding a bounded run of them."""
    def merge(points: list[tuple[bytes, int, int]]) -> list[tuple[bytes, int, int]]:
        points = sorted(set(points))
        kept = skyband(np.array([c for _, c, _ in points], np.int64), np.array([t for _, _, t in points], np.int64), k)
        return [points[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[tuple[bytes, int, int]]] = {}
        limit: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, source, term, own, total in zip(*(c.to_pylist() for c in batch.columns)):
                points = held.setdefault((lang, source), [])
                points.append((term.encode("utf-8"), own, total))
                if len(points) >= limit.get((lang, source), 20_000):
                    held[lang, source] = points = merge(points)
                    limit[lang, source] = 2 * len(points) + 20_000
        for (lang, source), points in held.items():
            points = merge(points)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(points)), pa.array([source] * len(points)), pa.array([t for t, _, _ in points], pa.binary()).cast(pa.string()),
                 pa.array([c for _, c, _ in points], pa.int64()), pa.array([t for _, _, t in points], pa.int64())],
                names=["lang", "source", "term", "own", "total"])
    return run


def telling_terms(terms: DataFrame, known: Totals, k: int = FIRST) -> DataFrame:
    """(lang, source, item, value): candidates for the first ``k`` terms of each
    group, the first ``k`` among them."""
    points = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"), "term", "total").select(
        "lang", F.col("x.sources").alias("source"), "term", F.col("x.counts").alias("own"), "total")
    band = points.mapInArrow(_skybands(k), _CANDIDATE)
    for salt in (F.crc32(F.col("term").cast("binary")) % _SALTS, F.lit(0)):
        band = band.repartition("lang", "source", salt).mapInArrow(_skybands(k), _CANDIDATE)
    sent = terms.sparkSession.sparkContext.broadcast(known)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        wholes = {(lang, s): int(n) for lang, own in known.sources.items() for s, n in zip(own, known.wholes[lang])}
        for batch in batches:
            lang, source, term, own, total = (c.to_pylist() for c in batch.columns)
            p = [1 + SCALE * (c + 2) // wholes[g] for g, c in zip(zip(lang, source), own)]
            q = [1 + SCALE * (c + 2) // known.whole[g] for g, c in zip(lang, total)]
            f = [(a - b) ** 2 // (a + b) if a > b else None for a, b in zip(p, q)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(f, pa.int64())], names=["lang", "source", "item", "value"])

    return band.mapInArrow(value, "lang string, source string, item string, value long").filter("value is not null")


# ------------------------------------------------------------ audit

def audit(docs: DataFrame, least: int = LEAST_DOCS, first: int = FIRST) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    terms = saved(kept_terms(term_counts(docs), least), "kept-terms")
    known = totals(docs, terms)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = F.row_number().over(order).cast("int").alias("rank")

    def part(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", ranked)

    return part(pairs(docs, terms, known), "pair").unionByName(
        part(telling_terms(terms, known, first), "term").filter(F.col("rank") <= first))


#: The same in DuckDB.
SQL = r"""
WITH given AS (
    SELECT ROW_NUMBER() OVER () AS doc, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
           translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
words AS (
    SELECT doc, lang, source, UNNEST(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM given),
vocabulary AS (SELECT lang, term, COUNT(*) AS total FROM words GROUP BY lang, term HAVING COUNT(DISTINCT doc) >= 10),
found AS (SELECT lang, source, term, COUNT(*) AS n FROM words JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
sizes AS (
    SELECT lang, (SELECT COUNT(*) FROM vocabulary v WHERE v.lang = g.lang) AS v,
           (SELECT COALESCE(SUM(total), 0) FROM vocabulary v WHERE v.lang = g.lang) AS n
    FROM (SELECT DISTINCT lang FROM given) g),
groups AS (
    SELECT g.lang, g.source, COALESCE((SELECT SUM(n) FROM found f WHERE f.lang = g.lang AND f.source = g.source), 0) AS n
    FROM (SELECT DISTINCT lang, source FROM given) g),
shares AS (
    SELECT g.lang, g.source, t.term, COALESCE(f.n, 0) AS own,
           (1 + 1000000000::HUGEINT * (COALESCE(f.n, 0) + 2) // (g.n + 2 * s.v))::BIGINT AS p,
           (1 + 1000000000::HUGEINT * (t.total + 2) // (s.n + 2 * s.v))::BIGINT AS q
    FROM groups g JOIN sizes s USING (lang) JOIN vocabulary t USING (lang)
         LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = t.term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE own > 0 AND p > q),
ranked AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE C)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
