"""Prefix counts and pieces against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerleaf.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", " \n", "The cat's they're we'll I'D !!'re o'clock 1234 ...", "naïve Été ÉTÉ été İstanbul ΑΣΣ ß ﬁ",
    "a<|endoftext|>b <|startoftext|> <|endo x!<|endoftext|>", "x\x1cy\x1fz w　v​u t\u0085s", "日本語のテキスト 👩‍👩‍👧 🎉🎉",
    "z" * 700 + " " + "ab!?" * 60, "Zuungeß queçanant " * 900,
]


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_every_prefix():
    upto = tokens.tokens_upto(PATH)
    rng = random.Random(5)
    letters = "abcdefghinorst'!., ́éÉ1\n"
    texts = [t for t in TEXTS if t and len(t) < 400] + ["".join(rng.choice(letters) for _ in range(60)) for _ in range(40)]
    for text in texts:
        for end in range(len(text) + 1):
            assert upto(text, end) == count(text[:end]), (text, end)


def test_count_tokens(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tokens.count_tokens(docs, PATH, limit=30).collect()
    assert len(got) == len(rows)
    for r in got:
        text = ("no id" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), count(text), count(text) > 30)
        assert [count(text[:e]) for e in r.ends[:40]] == r.counts[:40]
        assert count(text[:r.fits_chars]) <= 30
        if r.over_limit and len(text) < 400:
            assert r.fits_chars == max(e for e in range(len(text)) if count(text[:e]) <= 30)
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "x")], "doc_id long, text string, offset string")
    cut = packing.cut_documents(docs, PATH, length=128, end_id=2)
    out = packing.pack(cut, {"length": 128, "segments": 7, "loss_tokens": 120}, size="length").toPandas()
    for key, rows in out.groupby(out.doc_id.fillna(-1)):
        text = "no id" if key == -1 else (TEXTS * 3)[int(key)] or ""
        ids = np.array([*LIBRARY.encode(text, add_special_tokens=False).ids, 2], "<u4")
        rows = rows.sort_values("start")
        assert rows.start.tolist() == list(range(0, len(ids), 128)) and (rows.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(rows.start, rows.length)] == rows.ids_crc32.tolist()
        assert rows.length.sum() == len(ids)
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
        assert rows.length.sum() <= 128 and len(rows) <= 7
        assert rows.loss_tokens.sum() <= 120 or len(rows) == 1
    assert packing.pack(packing.cut_documents(docs.limit(0), PATH, 128, 2), {"length": 128}, size="length").count() == 0


def test_dot_product_packing():
    rng = np.random.default_rng(1)
    needs = np.stack([rng.integers(1, 900, 600), np.ones(600, int), rng.integers(0, 500, 600)], 1)
    limits = np.array([1000, 5, 600])
    sequence, place = packing.pack_group(needs, limits)
    assert sorted(place) == list(range(600))
    for s in range(sequence.max() + 1):
        assert (needs[sequence == s].sum(axis=0) <= limits).all()
    assert sequence.max() + 1 <= 1.25 * (needs / limits).sum(axis=0).max()


def test_chunk_ids_are_the_library_s():
    rng = random.Random(2)
    parts = [*"abcDE'&%$_-.,!?()[]`~é ÀßÿŸİµª12 øØñN", "<|endoftext|>", "’", "́", "don't", "'s"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(5000)]
    encoder = tokens.ChunkIds(tokens.vocabulary(PATH))
    assert encoder.apart
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text
