import hashlib
import itertools
import re

import duckdb
import numpy as np
import xxhash

from querylab.llm.queries import op7_document_fingerprints, op7_near_fingerprints
from querylab.llm.simhash import edited_likeness, fingerprints, near_fingerprints, within_radius

SEED = 42


def xx(s, seed=SEED):
    return xxhash.xxh64_intdigest(s.encode(), seed)


def brute_fp(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    h = [xx(x) for x in w] if len(w) < 2 else [xx(b, xx(a)) for a, b in zip(w, w[1:])]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    rows = [(d, t or "") for d, t in rows]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[:len(t) - q] + nxt[:q]
        f, g, n = brute_fp(t), brute_fp(e), brute_fp(nxt)
        near = lambda x: 1 - bin(f ^ x).count("1") / 64
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), signed(f), signed(g), near(g), near(n)))
    return out


ROWS = [(3, "The quick brown fox jumps over the lazy dog again and again"), (1, "Émile über straße naïve 日本語 テスト x"),
        (7, None), (5, ""), (9, "word"), (9, "word"), (9, "word"), (12, "a b " * 40_000 + "c"), (None, "first of all words here"),
        (20, " lead\tand\x0btrail "), (21, "one two three four")]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(a, b, "k", 1) for a, b in ROWS], "doc_id long, text string, k1 string, n_chars int")
    got = sorted((tuple(r) for r in edited_likeness(df.repartition(4)).collect()), key=str)
    assert got == sorted(brute(ROWS), key=str)
    assert edited_likeness(df.limit(0)).count() == 0
    one = [tuple(r) for r in edited_likeness(df.filter("doc_id = 3")).collect()]
    assert one == brute([ROWS[0]])


def test_fingerprints(spark):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ROWS)], "key long, text string")
    got = {r.key: r.fp & (1 << 64) - 1 for r in fingerprints(df).collect()}
    assert got == {k: brute_fp(t) for k, (_, t) in enumerate(ROWS)}


def test_search_finds_all_within_radius(spark):
    rng = np.random.default_rng(2)
    out = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    while len(out) < 300:
        x = out[rng.integers(0, len(out))]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        out.append(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = [signed(x) for x in out]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    q = spark.createDataFrame([(x,) for x in fps[::7]], "fp long")
    for radius in (0, 1, 3, 4):
        got = {tuple(r) for r in within_radius(df, q, radius).collect()}
        want = {(a, b, d) for a, b in itertools.product(set(fps[::7]), set(fps))
                if (d := bin((a ^ b) & (1 << 64) - 1).count("1")) <= radius}
        assert got == want


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in op7_document_fingerprints(spark, d).collect())
    want = sorted((a, n, s, f"{f & (1 << 64) - 1:016x}", f"{g & (1 << 64) - 1:016x}", x, y) for a, n, s, f, g, x, y in brute(docs))
    assert got == want
    assert np.mean([r[5] for r in got if r[1] > 200]) > np.mean([r[6] for r in got if r[1] > 200]) + 0.15


def test_crowded_keys(spark):
    rng = np.random.default_rng(3)
    out = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(600)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = [signed(x) for x in out]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for radius in (0, 1, 2, 3):
        got = {tuple(r) for r in within_radius(df, df.limit(20), radius, crowded=5).collect()}
        want = {(a, b, d) for a, b in itertools.product(set(fps[:20]), set(fps))
                if (d := bin((a ^ b) & (1 << 64) - 1).count("1")) <= radius}
        assert got == want


def near_brute(rows):
    fps = {(d, brute_fp(t)) for d, t in rows}
    asked = {f for d, f in fps if d is not None and d % 50 == 0}
    return {(a, b, n) for a, b in itertools.product(asked, {f for _, f in fps}) if 0 < (n := bin(a ^ b).count("1")) <= 3}


def test_near_fingerprints(spark):
    words = " ".join(f"w{k}" for k in range(400))
    rows = [(k, f"{words} tail{k}") for k in range(45, 60)] + [(100, "else"), (100, "else"), (None, words), (0, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    unsigned = lambda r: (r.query & (1 << 64) - 1, r.fp & (1 << 64) - 1, r.distance)
    got = [unsigned(r) for r in near_fingerprints(df).collect()]
    assert len(got) == len(set(got)) > 0 and set(got) == near_brute(rows)
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    got = sorted((r.fingerprint, r.near_fingerprint, r.distance) for r in op7_near_fingerprints(spark, d).collect())
    assert got == sorted((f"{a:016x}", f"{b:016x}", n) for a, b, n in near_brute(docs))
