import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest

from querylab.llm import merkle
from querylab.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, s string, slot long"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(map(field, (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and each leaf's (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 3:i - i % 3 + 3]
            paths[k].append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
        nodes, at = [h(nodes[i:i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(by[s], key=lambda x: x[:3])
        trees.append((own, *tree([x[2] for x in own])))
    root, tops = tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for (_, _, leaf, (d, text, *rest)), path in zip(own, paths):
            path = path + top
            odd = zlib.crc32(("" if d is None else str(d)).encode()) % 2
            now = leaf if odd or text is None else leaf_of(d, text.replace("\n", ""), *rest)
            for left, right in path:
                now = h([left, now, right])
            out.append((d, leaf, subroot, root, h([a + b for a, b in path]), now, now == root))
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.withColumn("proof_sha256", merkle.proof_sha256()).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "own", 9) for r in rows], SCHEMA)


CASES = [(k * 37 + (k % 5) * 1000003 * (k % 2), f"text {k}\n{k}" * (k % 4), "en", f"s{k % 3}", k) for k in range(500)]
CASES += [(-5, "below\nzero", None, "s1", None), (-(1 << 62), "far", "de", "s1", 3), ((1 << 62) + 3, "", "de", "é", 0)]
CASES += [(9, None, "fr", None, 1), (10, "ü\n" * 20000, "", "", 4)]
TIES = [(None, "no id", "en", "s0", 1), (None, "no id", "en", "s0", 1), (None, None, None, None, None)]
TIES += [(37, f"again {k}", "en", "s1", 1) for k in range(20)] + [(74, "same\n", "en", "s2", 1)] * 9


@pytest.mark.parametrize("rows, levels", [(CASES, 6), (CASES + TIES, 1), (CASES + TIES, 6), (CASES[:1], 6), (TIES, 6)],
                         ids=["unique", "short runs", "ties", "one", "only ties"])
def test_matches_brute_force(spark, rows, levels):
    rows = random.Random(3).sample(rows, len(rows))
    assert rows_of(merkle.manifest(frame(spark, rows).repartition(5), levels)) == brute(rows)


def test_empty_table(spark):
    assert merkle.manifest(frame(spark, []).limit(0)).count() == 0


def test_ranks_are_places(spark):
    """Dense, sparse and negative ids over several bitmaps of one source."""
    ids = random.Random(5).sample(range(-70000, 70000), 9000) + [10 ** 15 + k for k in range(40)]
    rows = [(d, "t", "en", "s", 1) for d in ids]
    got = {r.doc_id: r.slot for r in merkle.placed(merkle.leaves(frame(spark, rows))).collect()}
    assert got == {d: k for k, d in enumerate(sorted(ids))}


def test_rows_enter_no_sort(spark):
    """Unique ids are ranked by bitmaps: no window and no range exchange over the leaves."""
    df = merkle.placed(merkle.leaves(frame(spark, CASES)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "bitmapCount" in plan
    assert "rangepartitioning" not in plan and "+- Window" not in plan


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    got = op12_merkle_manifest(spark, d)
    rel = con.execute(merkle.SQL)
    assert got.columns == [c[0] for c in rel.description]
    assert Counter(tuple(r) for r in got.collect()) == Counter(rel.fetchall())
