import collections
import zlib

import duckdb
import numpy as np

import corpus_pipeline
from querylab.llm import toxicity
from querylab.llm.common import table
from querylab.llm.queries import tokenizer_path
from tests.llm.test_decontaminate import WORD, brute, words
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash_dedup import brute_fingerprint, brute_groups

D = "/root/testdata/sf0.001"


def cut(text, items):
    """The text without hit words, as the stage joins what is left; None if nothing is."""
    low = words(text)
    flags = [False] * len(low)
    for _, t in items:
        v = words(t)
        for k in range(max(1, len(v) - 9) if v else 0):
            p = v[k:k + 10]
            for i in range(len(low) - len(p) + 1):
                if low[i:i + len(p)] == p:
                    flags[i:i + len(p)] = [True] * len(p)
    if not any(flags):
        return text
    if all(flags):
        return None
    at = [m.span() for m in WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    kept, pos, i = [], 0, 0
    while i < len(flags):
        if flags[i]:
            j = i
            while j + 1 < len(flags) and flags[j + 1]:
                j += 1
            kept.append(text[pos:at[i][0]])
            pos, i = at[j][1], j
        i += 1
    return "\n".join(x for x in [*kept, text[pos:]] if x.strip())


def test_run_matches_brute_force(spark):
    from tokenizers import Tokenizer
    docs = duckdb.sql(f"select doc_id, text, source from '{D}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id::varchar, text from '{D}/benchmark.parquet'").fetchall()
    # the model is trained, so its decisions are taken as they come
    frame = table(spark, D, "documents")
    scores = toxicity.score(frame, toxicity.train(frame, table(spark, D, "labels"))).collect()
    toxic = {r.doc_id for r in scores if r.score >= 0.5}
    docs = [r for r in docs if r[0] not in toxic]
    fps = {i: brute_fingerprint(t) for i, t, _ in docs}
    root = brute_groups(list(fps.values()), 2)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    docs = [r for r in docs if least[root[fps[r[0]]]] == r[0]]
    joined = {i: " " + " ".join(words(t)) + " " for i, t, _ in docs}
    short = [(i, t) for i, t in items]
    cleaned = []
    for i, t, s in docs:
        near = [(k, x) for k, x in short if any(" " + " ".join(words(x)[a:a + 10]) + " " in joined[i]
                                               for a in range(max(1, len(words(x)) - 9)))]
        left = cut(t, near)
        if left is not None:
            cleaned.append((i, left, s))
    taken = {d: (n, t) for d, n, _, _, t in brute_mix(cleaned)}
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t, _ in cleaned:
        n, take = taken[i]
        texts = [t] * (take // n if n else 1)
        if n and take % n:
            texts.append(" ".join(t.split()[:take % n]))
        for x in texts:
            ids = np.array(tok.encode(x, add_special_tokens=False).ids + [1], "<u4")
            want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    got = corpus_pipeline.run(spark, D).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    by_start = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert [s for s, _, _ in by_start] == np.cumsum([0] + [n for _, n, _ in by_start])[:-1].tolist()
    assert [d for _, _, d in by_start] == sorted(d for _, _, d in by_start)


def test_stages_keep_the_columns(spark):
    """All but the last stage give documents; what they keep is untouched where nothing was found."""
    docs = table(spark, D, "documents")
    clean = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert collections.Counter(r.doc_id for r in rows).most_common(1)[0][1] == 1
        changed = sum(r.text != clean[r.doc_id].text for r in rows)
        assert changed == 0 if name != "benchmark_decontamination" else 0 < changed < 30


def test_stages_take_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names, an empty table."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, score double, key string, row int, id long, "
              "hash string, __key string, tags array<string>")
    texts = [f"A quiet page number {k} about rivers {k * k} and hills {k + 7}" for k in range(40)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(3, texts[3], "en", "s0", len(texts[3]))] * 4
    rows += [(None, "no id at all here", None, None, None), (100, None, "en", "s1", None), (101, "", "de", None, 0), (102, " \n\t", None, "s2", 3)]
    rows += [(103, "long words run on " * 30_000, "en", "s2", 540_000)]
    docs = spark.createDataFrame([(*r, 0.9, "k", 1, 5, "h", "own", ["a"]) for r in rows], schema)
    empty, given = docs.limit(0), {r[0] for r in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, empty = stage(spark, docs, D), stage(spark, empty, D)
        assert empty.count() == 0
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert docs.dtypes == empty.dtypes and docs.schema.fieldNames() == [c.split()[0] for c in schema.split(", ")]
        kept = docs.collect()
        assert all((r.score, r.key, r.row, r.id, r.hash, r["__key"], r.tags) == (0.9, "k", 1, 5, "h", "own", ["a"]) for r in kept)
        assert {r.doc_id for r in kept} <= given
        if k == 1:  # exact copies and the texts without words are one document each
            assert sum(r.doc_id == 3 for r in kept) <= 1 and sum(not (r.text or "").split() for r in kept) == 1
    assert {r.doc_id for r in docs.collect()} <= given and docs.count() > 0


def test_brute_helpers_agree():
    assert cut("a b One two, c", [("1", "one two")]) == "a b \n, c"
    assert brute("a b One two, c", [("1", "one two")], 10) == (5, 2, ["1"])
