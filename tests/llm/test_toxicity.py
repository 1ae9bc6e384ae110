import zlib

import duckdb
import numpy as np
import pytest

from querylab.llm import toxicity
from querylab.llm.queries import op8_toxicity


def test_pairs_are_learned():
    """Neither term alone is toxic, both together are: additive weights fail, the machine does not."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        r = [k for k, x in enumerate((a, b)) if x] + (2 + np.flatnonzero(rng.random(18) < 0.3)).tolist()
        rows.append(np.array(r, np.int64))
        y.append(float(a == b))
    y = np.array(y)
    base, w, v = toxicity.fit(rows[:1000], y[:1000], 20)
    z = toxicity.Model(base, np.arange(20), w, v).raw(rows[1000:])
    assert ((z > 0) == y[1000:]).mean() > 0.95
    linear = toxicity.Model(base, np.arange(20), w, np.zeros_like(v)).raw(rows[1000:])
    assert ((linear > 0) == y[1000:]).mean() < 0.7


def test_held_out_accuracy_on_whole_table(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op8_toxicity(spark, d).collect()}
    labels = duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall()
    assert len(got) == duckdb.sql(f"select count(*) from '{d}/documents.parquet'").fetchall()[0][0]
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(t, got[i]) for i, t in labels if got[i].held_out]
    wrong = sum(r.predicted != t for t, r in held)
    pos = [r.score for t, r in held if t]
    neg = np.sort([r.score for t, r in held if not t])
    auc = np.mean([np.searchsorted(neg, s) / len(neg) for s in pos])
    print(len(held), len(pos), wrong, auc)
    assert wrong <= 0.03 * len(held) and auc > 0.97


def test_scores_ignore_other_columns_and_repeat(spark):
    docs = spark.createDataFrame(
        [(i, ("you idiot " if i % 3 == 0 else "") + f"plain words number{i % 7} here", i, "x") for i in range(300)],
        "doc_id long, text string, score long, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(300)] + [(5, None, 0), (None, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    a, b = (toxicity.train(docs, labels) for _ in range(2))
    assert a.base == b.base and (a.weights == b.weights).all()
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "idiot"), (2, "idiot"), (3, "plain"), (4, "idiot " * 50_000)],
                                "doc_id long, text string")
    got = [tuple(r) for r in toxicity.score(odd, a).collect()]
    assert len(got) == 6 and got[0][1] == got[1][1] and got[2] == got[3] and got[2][1] > 0.5 > got[4][1]
    left = toxicity.drop_toxic(docs, a)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(300) if i % 3]
    assert toxicity.score(odd.limit(0), a).count() == 0


@pytest.mark.parametrize("toxic,score", [(None, 0.0), (0, 0.0), (1, 1.0)])
def test_one_class_or_none(spark, toxic, score):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([] if toxic is None else [(1, toxic), (2, toxic)], "doc_id long, toxic int")
    got = [r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
    assert got == pytest.approx([score] * 2, abs=1e-6)
