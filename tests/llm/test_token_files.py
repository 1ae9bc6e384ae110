import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querylab.llm import token_files
from querylab.llm.common import new_dir
from querylab.llm.queries import tokenizer_path
from querylab.llm.token_files import (
    BLOCK_IDS, TokenFile, WordCachedEncoder, bits_for, pack, read_token_files, unpack, write_token_files)


def plain(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    assert (unpack(pack(ids, bits), bits, len(ids)) == ids).all()
    assert len(pack(ids, bits)) == -(-1001 * bits // 8)


def test_bits_for():
    assert [bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


ODD = ["", " ", "Hello, World!! it's 1234", "É é İ İ ẞ", "x<|endoftext|>Y <|ENDOFTEXT|>", "a b\x1cc\x85d",
       "don't.. won't?! €. 5%. abc.%", "日本語。 テスト, नमस्ते.", "tab\tnew\nline\r\n", "🙂🙂. a🙂.", "ﬁ ½. Ⅷ, ٣."]


def test_encoder_matches_tokenizer_on_odd_texts():
    enc = WordCachedEncoder(tokenizer_path())
    assert [x.tolist() for x in enc.encode(ODD)] == plain(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_encoder_matches_tokenizer(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    enc = WordCachedEncoder(tokenizer_path())
    assert [x.tolist() for x in enc.encode(texts)] == plain(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdefghijklmnopqrstuvwxyzßàéñøüÿāłſƿȷɏʼ'İÅ.,e\u0301", min_size=1, max_size=12), min_size=1, max_size=8))
def test_words_of_latin_letters(words):
    enc = WordCachedEncoder(tokenizer_path())
    assert enc.direct and enc.kind == "<u2"
    assert [x.tolist() for x in enc.encode(words + [" ".join(words)])] == plain(words + [" ".join(words)])


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 3)
    enc = WordCachedEncoder(tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(ODD)] == plain(ODD)
    assert len(enc.words) <= 3


def test_files_and_random_access(spark):
    rows = [(5, "b word"), (None, "null id"), (3, None), (3, "again"), (9, "long word, " * 9000), (5, "b word")]
    rows += [(100 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, start int, shard int")
    out = new_dir(spark, "test-tokens")
    files = sorted(write_token_files(df.repartition(3), out, tokenizer_path()).collect())
    got = sorted(map(tuple, read_token_files(spark, out).collect()), key=lambda r: r[1])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [np.array(x + [1]) for x in plain([t or "" for _, t in want])]
    starts = np.cumsum([0] + [len(x) for x in ids])
    assert [r[:4] for r in got] == [
        (d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for (d, _), s, x in zip(want, starts, ids)]
    whole = np.concatenate(ids)
    at = 0
    for f in files:
        t = TokenFile(f.path)
        assert t.n_ids == f.n_ids and t.bits == 16
        for a, b in [(0, 7), (BLOCK_IDS - 3, BLOCK_IDS + 5), (f.n_ids - 2, f.n_ids), (0, f.n_ids)]:
            a = min(a, f.n_ids)
            assert (t.ids(a, b) == whole[at + a:at + min(b, f.n_ids)]).all()
        at += f.n_ids


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = new_dir(spark, "test-tokens")
    assert write_token_files(df, out, tokenizer_path()).count() == 0
    assert read_token_files(spark, out).count() == 0
