import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querylab.llm.decontaminate import (
    FMIndex, Shard, WaveletMatrix, Windows, find_passages, remove_passages, split_words, suffix_array)
from querylab.llm.queries import op3_benchmark_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w = words(text)
    hit, seen = set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(1, len(v) - window + 1) if v else 0):
            p = v[k:k + window]
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    seen.add(item or "")
    return len(w), len(hit), sorted(seen)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=6))
def test_index_finds_all(docs):
    """Few symbols, so long ties; every pattern of one to four symbols is found where it stands."""
    n = len(docs)
    seq = np.array([x for d, doc in enumerate(docs) for x in [n + y for y in doc] + [d]], np.int64)
    starts = np.array([sum(len(x) + 1 for x in docs[:k]) for k in range(n)], np.int64)
    sa = suffix_array(seq, n + 4)
    assert [seq[i:].tolist() for i in sa] == sorted(seq[i:].tolist() for i in range(len(seq)))
    index = FMIndex(seq, n + 4, starts)
    pats = {tuple(seq[i:i + k].tolist()) for i in range(len(seq)) for k in (1, 2, 4)
            if i + k <= len(seq) and (seq[i:i + k] >= n).all()} | {(n, n + 1, n + 2, n + 3)}
    table = np.array([[-1] * (4 - len(p)) + list(p) for p in pats])
    low, high = index.search(table)
    for p, a, b in zip(pats, low, high):
        want = [i for i in range(len(seq)) if tuple(seq[i:i + len(p)].tolist()) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 300, 1000)
    m = WaveletMatrix(v, 300)
    c, i = rng.integers(0, 300, 500), rng.integers(0, 1001, 500)
    assert m.rank(c, i).tolist() == [int((v[:b] == a).sum()) for a, b in zip(c, i)]
    s, r = m.symbol_and_rank(np.arange(1000))
    assert (s == v).all() and r.tolist() == [int((v[:k] == v[k]).sum()) for k in range(1000)]


def test_words_match_the_pattern():
    texts = ["", "A b-C 12ab\x00x", "éÉ ß_ñ z", "  lead", "日本 x"]
    w, s, e, n, at = split_words([t.encode() for t in texts])
    got, k = [x.decode() for x in w.to_pylist()], 0
    for t, c in zip(texts, n):
        assert got[k:k + c] == words(t)
        k += c


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short Item"), (2, "another short item"),
         (30, None), (4, "..."), (None, "no id here"), (5, "two three four five six seven eight nine ten eleven"), (7, "z z")]
DOCS = [(1, "x One TWO three, four five six seven eight nine ten eleven! y"), (2, None), (3, ""), (4, "short-item"),
        (5, "it is a SHORT item; another short item"), (None, "no id here and more"), (6, "z z z z z " * 3000 + "end"),
        (5, "it is a SHORT item; another short item"), (8, "two three four five six seven eight nine ten eleven"),
        (9, "clean text"), (10, "nine ten"), (11, "eleven one two three four five six seven eight nine")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_matches_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(a, b, 1) for a, b in DOCS], "doc_id long, text string, hits int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_passages(docs, items, clean=True, keep=("doc_id", "hits"), block_bytes=block_bytes).collect()
    named = [(None if a is None else str(a), b) for a, b in ITEMS]
    want = sorted(((d, *brute(t, named, 10)) for d, t in DOCS), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    assert {r.doc_id: r.text for r in got}[1] == "x \n! y"
    assert find_passages(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert find_passages(docs.limit(0), items).count() == 0


def test_remove_passages(spark):
    docs = spark.createDataFrame([(a, b, None if b is None else len(b), "s") for a, b in DOCS],
                                 "doc_id long, text string, n_chars long, c0 string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = remove_passages(docs, items)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in left.collect()), key=str)
    assert got == sorted([(1, "x \n! y", 6), (2, None, None), (3, "", 0), (None, " and more", 9), (6, " end", 4),
                          *[(5, "it is a ", 8)] * 2, (9, "clean text", 10), (10, "nine ten", 8),
                          (11, DOCS[-1][1], len(DOCS[-1][1]))], key=str)
    again = find_passages(left, items)
    assert again.agg({"n_hit": "max"}).first()[0] == 0


def test_query_matches_brute_force(spark):
    import duckdb
    d = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id::varchar, text from '{d}/benchmark.parquet'").fetchall()
    short = [(i, " ".join(words(t))) for i, t in items]
    got = {tuple(r) for r in op3_benchmark_decontamination(spark, d).collect()}
    want = set()
    for i, t in docs:
        joined = " " + " ".join(words(t)) + " "
        near = [x for x in short if any(" " + " ".join(x[1].split()[k:k + 10]) + " " in joined
                                        for k in range(max(1, len(x[1].split()) - 9)))]
        n, h, seen = brute(t, near, 10)
        want.add((i, n, h, len(seen), hashlib.sha256(",".join(seen).encode()).hexdigest(), h > 0))
    assert got == want and any(r[5] for r in want)
