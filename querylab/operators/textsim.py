"""Text similarity between reference and candidate texts (E-24 ROUGE, E-25 BLEU).

* Tokens: lower-cased runs of letters/digits (ROUGE); whitespace-separated
  words (BLEU), over the whole text.
* Candidate pairs: texts sharing at least one word n-gram (join on hashed
  n-grams, behind a Bloom filter of the references' ones; never a cross join).
* ROUGE-N: clipped n-gram overlap from (id, gram, count) tables joined on
  (pair, gram); p = overlap / candidate grams, r = overlap / reference grams,
  f = 2pr / (p + r).
* ROUGE-L: longest common subsequence of the token sequences (bit-parallel,
  one small vectorised helper per batch of pairs).
* BLEU: clipped precisions for n = 1..4, brevity penalty; per pair
  (sentence BLEU, 0 when a precision is 0) and over all pairs (corpus BLEU).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylab.session import saved

WORD = r"[^\p{L}\p{N}]+"


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD), lambda x: x != "")


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array, in order.

    Built from n shifted slices glued pairwise with ``zip_with``: no lambda
    refers to the token array itself, so the tokenizer is never re-run per
    element (which would make the work quadratic in the text length)."""
    cnt = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    grams = F.slice(tokens, 1, cnt)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(tokens, k + 1, cnt), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def _numbered(n: int):
    return lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))


def gram_counts(df: DataFrame, id_col: str, tokens: str, ns: Sequence[int]) -> DataFrame:
    """(id, n, gram, cnt) for all ``ns`` at once: partial aggregation per map
    task before the shuffle."""
    grams = F.concat(*[F.transform(ngrams(F.col(tokens), n), _numbered(n))
                       for n in ns])
    return (df.select(F.col(id_col).alias("id"), F.explode(grams).alias("g"))
            .groupBy("id", "g.n", "g.gram").agg(F.count(F.lit(1)).alias("cnt")))


def pair_overlaps(pairs: DataFrame, refs: DataFrame, ref_id: str, cands: DataFrame, cand_id: str, ns: Sequence[int],
                  text_col: str = "text", tokenizer=word_tokens) -> DataFrame:
    """(ref_id, cand_id, n, overlap, ref_total, cand_total, ref_len, cand_len)
    for every pair and n: one explode, one join on (pair, n, gram) and one
    aggregate whatever the number of ``ns``; totals follow from the lengths."""
    def cut(df: DataFrame, key: str, side: str) -> DataFrame:
        used = df.join(pairs.select(key).distinct(), key, "left_semi")
        return used.select(key, tokenizer(F.col(text_col)).alias("__tok")).withColumn(f"{side}_len", F.size("__tok"))
    r, c = cut(refs, ref_id, "ref"), cut(cands, cand_id, "cand")
    rc = gram_counts(r, ref_id, "__tok", ns).select(F.col("id").alias(ref_id), "n", "gram", F.col("cnt").alias("cr"))
    cc = gram_counts(c, cand_id, "__tok", ns).select(F.col("id").alias(cand_id), "n", "gram", F.col("cnt").alias("cc"))
    found = (pairs.join(rc, ref_id).join(cc, [cand_id, "n", "gram"])
             .groupBy(ref_id, cand_id, "n").agg(F.sum(F.least("cr", "cc")).alias("overlap")))
    every = (pairs.join(r.drop("__tok"), ref_id).join(c.drop("__tok"), cand_id)
             .withColumn("n", F.explode(F.array(*[F.lit(n) for n in ns]))))
    total = lambda side: F.greatest(F.col(f"{side}_len") - F.col("n") + 1, F.lit(0)).cast("bigint")
    return every.join(found, [ref_id, cand_id, "n"], "left").select(
        ref_id, cand_id, "n", F.coalesce("overlap", F.lit(0)).cast("bigint").alias("overlap"),
        total("ref").alias("ref_total"), total("cand").alias("cand_total"), "ref_len", "cand_len")


def with_gram_hashes(df: DataFrame, tokens: str, n: int, out_col: str) -> DataFrame:
    """Append ``out_col``: 64-bit hashes of the n-grams of the token array
    ``tokens``, in order.

    Every token is hashed once; each step glues two shifted slices of the
    hashes so far, at most doubling the grams' length, in a projection of its
    own that Catalyst keeps apart (inlined, the tokenizer would run again for
    every place that reads the array)."""
    df, width = df.withColumn(out_col, F.transform(tokens, lambda x: F.xxhash64(x))), 1
    while width < n:
        step = min(width, n - width)
        cnt = F.greatest(F.size(out_col) - step, F.lit(0))
        df = df.withColumn(out_col, F.zip_with(F.slice(out_col, 1, cnt), F.slice(out_col, step + 1, cnt), lambda a, b: F.xxhash64(a, b)))
        width += step
    return df


#: Bits of the Bloom filter: at most 2^20 words of 64 bits, whatever the references.
BLOOM_BITS = 26
_AT = f"shiftrightunsigned(h, {64 - BLOOM_BITS})"


def _bloom(hashes: DataFrame) -> DataFrame:
    """(word, bits): one bit a hash, 64 bits a row."""
    return (hashes.select(F.expr(f"shiftright({_AT}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({_AT} & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))


def _may_hold(hashes: DataFrame, bloom: DataFrame) -> DataFrame:
    """The rows of ``hashes(h, ...)`` whose bit is set in the filter."""
    held = hashes.withColumn("word", F.expr(f"shiftright({_AT}, 6)")).join(F.broadcast(bloom), "word")
    return held.filter(f"(shiftright(bits, cast({_AT} & 63 as int)) & 1L) = 1L").drop("word", "bits")


def candidate_pairs(refs: DataFrame, ref_id: str, cands: DataFrame, cand_id: str, text_col: str = "text",
                    n: int = 8) -> DataFrame:
    """(ref_id, cand_id) pairs sharing at least one word n-gram.

    Only 64-bit hashes move, and of the candidates' only those that pass the
    references' Bloom filter; pairs of equal hashes are verified by the grams."""
    def tokens(df: DataFrame, key: str, side: str) -> DataFrame:
        return df.select(key, word_tokens(F.col(text_col)).alias(side))

    def hashed(df: DataFrame, key: str) -> DataFrame:
        grams = with_gram_hashes(tokens(df, key, "__tok"), "__tok", n, "__grams")
        return grams.select(key, F.explode(F.array_distinct("__grams")).alias("h"))

    known = saved(hashed(refs, ref_id), "reference-grams")
    # Dealt out before the grams are made: a file is cut by its row groups only, so few tasks may read all texts.
    dealt = cands.select(cand_id, text_col).hint("rebalance")
    met = saved(_may_hold(hashed(dealt, cand_id), saved(_bloom(known), "bloom")).join(known, "h").select(ref_id, cand_id).distinct(), "met")
    # Grams are spelt out only in the texts of pairs that met.
    used = saved(cands.join(met.select(cand_id).distinct(), cand_id, "left_semi").select(cand_id, text_col).hint("rebalance"), "met-texts")
    both = met.join(tokens(refs, ref_id, "__r"), ref_id).join(tokens(used, cand_id, "__c"), cand_id)
    return both.filter(F.arrays_overlap(ngrams(F.col("__r"), n), ngrams(F.col("__c"), n))).select(ref_id, cand_id)


def _prf(overlap: Column, cand_total: Column, ref_total: Column, prefix: str) -> list[Column]:
    p = F.when(cand_total > 0, overlap / cand_total).otherwise(0.0)
    r = F.when(ref_total > 0, overlap / ref_total).otherwise(0.0)
    f = F.when(p + r > 0, (2.0 * p) * r / (p + r)).otherwise(0.0)
    return [p.alias(f"{prefix}_p"), r.alias(f"{prefix}_r"), f.alias(f"{prefix}_f")]


def rouge_n(pairs: DataFrame, refs: DataFrame, ref_id: str, cands: DataFrame, cand_id: str, n: int,
            text_col: str = "text", tokenizer=word_tokens) -> DataFrame:
    """ROUGE-N precision/recall/F per pair (and the overlap counts)."""
    out = pair_overlaps(pairs, refs, ref_id, cands, cand_id, [n], text_col, tokenizer)
    return out.select(ref_id, cand_id, "overlap", "ref_total", "cand_total",
                      *_prf(F.col("overlap"), F.col("cand_total"), F.col("ref_total"), f"rouge{n}"))


def average_rouge(pairs: DataFrame, refs: DataFrame, ref_id: str, cands: DataFrame, cand_id: str,
                  ns: Sequence[int] = (1, 2), text_col: str = "text") -> DataFrame:
    """(metric, p, r, f): ROUGE-N and ROUGE-L averaged over all pairs, 6 decimals."""
    each = pair_overlaps(pairs, refs, ref_id, cands, cand_id, ns, text_col).select(
        F.concat(F.lit("rouge"), F.col("n").cast("string")).alias("metric"),
        *_prf(F.col("overlap"), F.col("cand_total"), F.col("ref_total"), "x"))
    longest = rouge_l(pairs, refs, ref_id, cands, cand_id, text_col).select(
        F.lit("rougeL").alias("metric"), *[F.col(f"rougeL_{k}").alias(f"x_{k}") for k in "prf"])
    return each.unionByName(longest).groupBy("metric").agg(*[F.round(F.avg(f"x_{k}"), 6).alias(k) for k in "prf"])


def _lcs(a, b) -> int:
    """LCS length, bit-parallel over the shorter sequence (Hyyro)."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if m == 0:
        return 0
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << m) - 1
    v = full
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return m - bin(v).count("1")


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, refs: DataFrame, ref_id: str, cands: DataFrame, cand_id: str,
            text_col: str = "text") -> DataFrame:
    """ROUGE-L precision/recall/F per pair from the LCS of the token sequences."""
    r = refs.select(F.col(ref_id), word_tokens(F.col(text_col)).alias("rt"))
    c = cands.select(F.col(cand_id), word_tokens(F.col(text_col)).alias("ct"))
    j = pairs.join(r, ref_id).join(c, cand_id)
    j = j.select(ref_id, cand_id, lcs_length("rt", "ct").alias("lcs"),
                 F.size("rt").alias("ref_len"), F.size("ct").alias("cand_len"))
    return j.select(ref_id, cand_id, "lcs", *_prf(F.col("lcs"), F.col("cand_len"), F.col("ref_len"), "rougeL"))


def bleu_counts(pairs: DataFrame, refs: DataFrame, ref_id: str, cands: DataFrame, cand_id: str,
                text_col: str = "text", max_n: int = 4) -> DataFrame:
    """Per pair and n: clipped matches and candidate n-gram totals, plus the
    candidate and reference lengths."""
    o = pair_overlaps(pairs, refs, ref_id, cands, cand_id, list(range(1, max_n + 1)), text_col, space_tokens)
    return o.select(ref_id, cand_id, "n", F.col("overlap").alias("clipped"), F.col("cand_total").alias("cand_grams"),
                    "cand_len", "ref_len")


def _bp(c: Column, r: Column) -> Column:
    return F.when(c > r, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(1.0 - r / c))


def sentence_bleu(counts: DataFrame, keys: Sequence[str], max_n: int = 4) -> DataFrame:
    g = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("cand_grams") > 0, F.ln(F.col("clipped") / F.col("cand_grams")))).alias("logsum"),
        F.min(F.col("clipped")).alias("min_clipped"),
        F.first("cand_len").alias("c"), F.first("ref_len").alias("r"))
    score = F.when(F.col("min_clipped") == 0, F.lit(0.0)).otherwise(_bp(F.col("c"), F.col("r")) * F.exp(F.col("logsum") / max_n))
    return g.select(*keys, F.round(score, 6).alias("bleu"))


def corpus_bleu(counts: DataFrame, max_n: int = 4) -> DataFrame:
    """Corpus BLEU over all pairs: precisions from summed clipped counts,
    brevity penalty from summed lengths (both single-row aggregates, used
    as scalar subqueries)."""
    per_n = counts.groupBy("n").agg(F.sum("clipped").alias("m"), F.sum("cand_grams").alias("t"))
    lens = counts.filter(F.col("n") == 1).agg(F.sum("cand_len").alias("c"), F.sum("ref_len").alias("r"))
    p = per_n.agg(F.sum(F.when(F.col("m") > 0, F.ln(F.col("m") / F.col("t")))).alias("logsum"),
                  F.min("m").alias("min_m"))
    c, r = lens.select("c").scalar(), lens.select("r").scalar()
    score = F.when(F.col("min_m") == 0, F.lit(0.0)).otherwise(_bp(c, r) * F.exp(F.col("logsum") / max_n))
    return p.select(F.round(score, 6).alias("corpus_bleu"))
