import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from querylab.llm import divergence
from querylab.llm.queries import op11_source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value int, own string"
LETTERS = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    """The audit as stated, group by group and term by term."""
    own, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = LETTERS.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        own[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        count = {s: {t: own[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}

        def shares(c):
            n = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (x + 2) // n for t, x in c.items()}
        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in sources:
            found = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(found))]
            found = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(found)[:10])]
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "q", 3, "z") for r in rows], SCHEMA)


def corpus():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "né", "Zu", "ök", "𝒳") for b in "abcdefgh"]
    rows = []
    for k in range(700):
        lang, source = ("en", "en", "de", "fr")[k % 4], f"s{(k * k) % 7}"
        lean = words[:8] if source in ("s1", "s2") else words
        rows.append((k, " ".join(rng.choice(lean if rng.random() < 0.5 else words) + ("," if k % 3 else "7") for _ in range(30)), lang, source))
    rows += [(1000 + k, None, "en", "quiet") for k in range(3)] + [(2000, "only here", "it", "lone")]
    rows += [(None, "lo ka " * 9, None, None)] * 12 + [(3000, "", "", "s1"), (3001, "rare words", "pt", "a"), (3002, "rare", "pt", "b")]
    return rows + [(4000, "kaa " * 60000, "en", "s3")]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    rows = corpus()
    assert rows_of(divergence.audit(frame(spark, rows).repartition(7))) == brute(rows)


def test_empty_and_wordless(spark):
    assert divergence.audit(frame(spark, []).limit(0)).count() == 0
    rows = [(1, "1 2", "en", "a"), (2, None, "en", "b")]
    assert rows_of(divergence.audit(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband_holds_points_with_fewer_than_k_dominators(k):
    rng = np.random.default_rng(k)
    for high in (4, 60, 10 ** 6):
        own, total = rng.integers(0, high, 1500), rng.integers(0, high, 1500)
        dominators = [int(((own[:i] >= own[i]) & (total[:i] <= total[i])).sum()) for i in range(1500)]
        assert divergence.skyband(own, total, k).tolist() == [i for i, n in enumerate(dominators) if n < k]


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10 ** 12, 10 ** 15 - 3], np.int64)
    for whole in (10 ** 15, 3 * 10 ** 15 + 7):
        assert divergence.share(counts, whole).tolist() == [1 + 10 ** 9 * (int(c) + 2) // whole for c in counts]


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    got = op11_source_divergence(spark, d)
    rel = con.execute(divergence.SQL)
    assert got.columns == [c[0] for c in rel.description]
    assert rows_of(got) == Counter(rel.fetchall())
