import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylab.llm import language_id
from querylab.llm.queries import op13_language_id

SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string, windows int"


def text_of(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


PARTS = {"aa": ["sha", "the", "ing", "wor"], "bb": ["ßen", "ich", "kei", "aus"], "cc": ["łów", "prz", "się", "nie"]}


def corpus(n=300):
    rng = random.Random(2)
    rows = [(k, text_of(rng, PARTS[lang], rng.randint(2, 200)), lang) for k in range(n) for lang in [("aa", "bb", "cc")[k % 3]]]
    odd = [(9001, None, "aa"), (9002, "", "bb"), (9003, "12 ... !!", "cc"), (None, "shathe ingwor", None), (9004, "ichkei ausich", None)]
    odd += [(9005, text_of(rng, PARTS["cc"], 60_000), "cc"), (3, rows[3][1], rows[3][2]), (9006, "Ł", None)]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SCHEMA)


def test_learns_and_reads_every_row(spark):
    rows = corpus()
    docs = frame(spark, rows).repartition(4)
    net = language_id.train(docs)
    assert net.langs == ["aa", "bb", "cc"]
    got = language_id.predict(docs, net, ("doc_id", "text", "lang")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(t)) for d, t, _ in rows)
    for r in got:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in net.langs and 0 <= r.score <= 1
            if r.lang and len(r.text) > 20:
                assert r.lang_pred == r.lang
    # Neither the id nor the given language enters a prediction.
    other = docs.withColumns({"lang": F.lit("zz"), "doc_id": F.lit(77)})
    assert sorted((str(r.text), r.lang_pred, r.score) for r in language_id.predict(other, net, ("text",)).collect()) == \
        sorted((str(r.text), r.lang_pred, r.score) for r in got)


def test_one_language_none_and_empty(spark):
    rows = [(1, "shathe", "aa"), (2, "thesha", "aa"), (6, "ing", "aa"), (7, None, None)]
    docs = frame(spark, rows)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert got == {1: "aa", 2: "aa", 6: "aa", 7: "und"}
    nothing = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), language_id.train(docs)).count() == 0
    assert language_id.train(docs.limit(0)) is None


def test_fit_is_bounded_and_leaves_held_out_ids(spark):
    docs = frame(spark, [(k, f"{'ab' * k} sha", f"l{k % 2}") for k in range(1, 200)] * 2)
    got = language_id.sampled(docs, 40).collect()
    assert len(got) == 40 and max(len(r.windows) for r in got) <= language_id.WINDOWS
    # The shortest texts stand for their ids.
    fitted = {len(bytes(r.windows[0])) for r in language_id.sampled(docs, 10_000).collect() if len(r.windows) == 1}
    for k in (k for k in range(1, 100) if zlib.crc32(str(k).encode()) % 5 == 0):
        assert 2 * k + 4 not in fitted


@pytest.mark.parametrize("n", [1, 255, 256, 257, 508, 5000])
def test_windows_hold_every_sequence(n):
    raw = bytes(random.Random(n).choices(range(97, 123), k=n))
    codes, own = language_id.windows(raw)
    joined = b"".join(bytes(c[:language_id._STEP].tolist()) if k < len(codes) - 1 else bytes(x for x in c.tolist() if x < 256)
                      for k, c in enumerate(codes))
    assert joined == raw and codes.shape[1] == language_id.WINDOW
    wide = max(language_id.WIDTHS)
    held = {bytes(c[i:i + wide].tolist()) for c in codes for i in range(len(c) - wide + 1) if c[i:i + wide].max() < 256}
    assert all(raw[i:i + wide] in held for i in range(n - wide + 1)) and own.min() > 0


def test_gradients_agree_with_differences():
    """One small step lowers the loss; a fitted network separates its windows."""
    rng = np.random.default_rng(0)
    raw = [bytes(rng.choice([97, 98, 99] if k % 2 else [100, 101, 102], 300).astype(np.uint8)) for k in range(64)]
    codes = np.array([language_id.windows(r)[0][0] for r in raw])
    net = language_id.fit(codes, np.arange(64) % 2, ["d", "a"], epochs=20)
    assert (net.log_probabilities(codes).argmax(axis=1) == np.arange(64) % 2).all()


def test_query_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = op13_language_id(spark, d)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.n_chars > 50]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
