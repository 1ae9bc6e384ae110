import collections
import hashlib
import re

import duckdb
import pytest

from querylab.llm import mixing
from querylab.llm.queries import op5_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """The rule as stated: share by weight, stop at three times, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def brute(rows):
    sizes, docs = collections.Counter(), collections.defaultdict(list)
    for d, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        key = hashlib.md5(f"0:{'' if d is None else d}:{text or ''}".encode()).hexdigest()
        docs[source].append((key, d, n))
    out = []
    target = brute_targets(sizes)
    for s, own in docs.items():
        budget, before = int(target[s] + 0.5), 0
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for key, d, n in sorted(own, key=lambda x: x[0]):
            out.append((d, n, sizes[s], pytest.approx(target[s]), epochs * n + max(0, min(n, rest - before))))
            before += n
    return out


def order(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[4]))


ROWS = [(k, "w " * (k % 17), f"s{k % 5}") for k in range(400)] + [(1000 + k, "x\ty\x0bz" * 40, "big") for k in range(300)]
ROWS += [(None, "a b", None), (None, "a b", None), (7000, None, None), (7001, "", "empty"), (7002, "one two three", "é")]
ROWS += [(9, "same row here", "s1")] * 5


@pytest.mark.parametrize("bucket_rows", [10_000, 20])
def test_plan_matches_brute_force(spark, bucket_rows):
    df = spark.createDataFrame([(*r, 1, "q") for r in ROWS], "doc_id long, text string, source string, size int, key string")
    got = [tuple(r) for r in mixing.mix_plan(df, bucket_rows=bucket_rows).select(
        "doc_id", "size", "source_size", "target", "taken").collect()]
    assert order(got) == order(brute(ROWS))
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_mixed_rows_follow_the_plan(spark):
    rows = [r for r in ROWS if r[0] != 9 and r[0] is not None]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 2, "own", r[0], True) for r in rows],
                               "doc_id long, text string, source string, n_chars long, size int, key string, words long, cutting boolean")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert all(r.key == "own" and r.words == r.doc_id and r.size == 2 and r.cutting for r in out.collect())
    took, texts = collections.Counter(), dict((r[0], r[1]) for r in rows)
    for r in out.collect():
        took[r.doc_id] += len(WORD.findall(r.text or ""))
        assert r.text == texts[r.doc_id] or texts[r.doc_id].split()[:len(r.text.split())] == r.text.split()
        assert r.n_chars == len(r.text or "")
    assert dict(took) | {d: t for d, _, _, _, t in brute(rows) if t == 0} == {d: t for d, _, _, _, t in brute(rows)}


def test_query_matches_sql_and_budget(spark):
    d = "/root/testdata/sf0.01"
    got = [tuple(r) for r in op5_mixing(spark, d).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    assert order(got) == order(con.execute(mixing.SQL).fetchall())
    per = con.execute(f"select sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) from documents").fetchone()[0]
    assert abs(sum(r[4] for r in got) - per) <= 20 and all(r[4] <= 3 * r[1] for r in got)
