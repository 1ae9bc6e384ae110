import itertools

import numpy as np
import pytest
import xxhash

from querylab.llm.graph import components
from querylab.llm.queries import op4_simhash_near_dedup
from querylab.llm.simhash_dedup import (
    _golay, bucket_entries, codeword_index, fingerprint, keep_one, links, near_duplicates, points)


def brute_fingerprint(text, shingle=3):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, d):
    nodes = sorted(set(fps))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(nodes, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= d:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_golay_code():
    _, _, error = _golay()
    assert len(np.unique(error)) == 2048  # perfect: every syndrome has its own error of weight 0 to 3
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    idx = codeword_index(words)
    code = codeword_index(np.arange(1 << 12) << 11)
    assert len(code) == 4096 and idx.max() < 4096


def test_fingerprint_matches_brute_force():
    for t in [None, "", " \n", "one", "One TWO", "a b c d e f a b c", "É é\x1cx y z w", "w " * 70_000 + "x y z"]:
        assert fingerprint(t) == brute_fingerprint(t), repr(t)[:40]


def near_set(rng, n, centres, flips):
    out = [int(x) for x in rng.integers(0, 1 << 63, centres)]
    while len(out) < n:
        x = out[rng.integers(0, len(out))]
        for b in rng.integers(0, 64, rng.integers(1, flips + 1)):
            x ^= 1 << int(b)
        out.append(x)
    return np.array([x - (1 << 64) if x >> 63 else x for x in out], np.int64)


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_keys_miss_no_pair(d):
    fp = np.unique(near_set(np.random.default_rng(d), 300, 40, 3))
    key, row, home = bucket_entries(fp, d)
    point = points(fp, d)
    by, at = {}, {}
    for k, r, h in zip(key, row, home):
        by.setdefault(k, []).append((r, h))
    for p, b, r in zip(*point):
        at.setdefault((p, b), set()).add(r)
    met = {frozenset((r, q)) for v in by.values() for r, h in v if h for q, _ in v if q != r}
    shared = {frozenset(x) for v in at.values() for x in itertools.combinations(v, 2)}
    u = fp.astype(np.uint64)
    for a, b in itertools.combinations(range(len(fp)), 2):
        near = bin(int(u[a] ^ u[b])).count("1") <= d
        assert not near or frozenset((a, b)) in met
        assert near == (frozenset((a, b)) in shared)


@pytest.mark.parametrize("d,bucket", [(1, 64), (2, 64), (2, 2), (3, 64), (3, 2)])
def test_groups_match_brute_force(spark, d, bucket):
    fp = np.unique(near_set(np.random.default_rng(10 + d), 400, 60, 3)).tolist()
    found = components(links(spark.createDataFrame([(x,) for x in fp], "fp long"), d, bucket))
    got = {r.node: r.root for r in found.collect()}
    want = brute_groups(fp, d)
    assert {n: got.get(n, n) for n in fp} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 200)] + [(7, 7), (300, None), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [(4, "a b c d e f g h"), (2, "A b C d e f g h"), (9, None), (7, ""), (2, "A b C d e f g h"), (None, "other words here"),
        (None, "other words here"), (5, "only"), (5, "only2"), (6, "x y z " * 30_000)]


def test_cases(spark):
    df = spark.createDataFrame([(a, b, 1, "r") for a, b in ROWS], "doc_id long, text string, fp int, root string")
    got = near_duplicates(df).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.root, []).append((r.doc_id, r.component_id))
    key = lambda v: sorted(v, key=str)
    assert sorted(map(key, by.values()), key=str) == sorted(map(key, [
        [(4, 2), (2, 2), (2, 2)], [(9, 7), (7, 7)], [(None, None)] * 2, [(5, 5)], [(5, 5)], [(6, 6)]]), key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, "A b C d e f g h"), (7, ""), (None, "other words here"), (5, "only"), (5, "only2"), ROWS[-1]], key=str)
    empty = spark.createDataFrame([], df.schema)
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


def test_query_matches_brute_force(spark):
    import duckdb
    d = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    fps = {i: brute_fingerprint(t) for i, t in docs}
    root = brute_groups(list(fps.values()), 2)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in op4_simhash_near_dedup(spark, d).collect()}
    assert got == {(i, f"{f:016x}", least[root[f]]) for i, f in fps.items()}
