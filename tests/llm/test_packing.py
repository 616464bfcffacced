"""Pieces against the library's own ids, and the layout of sequences."""

import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from ledgerleaf.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_cuts():
    for n, length, masked, loss in [(1, 9, 0, None), (50, 9, 0, None), (50, 9, 20, 3), (50, 9, 4, 8), (7, 9, 90, 1), (64, 16, 8, 1)]:
        pieces, at = packing.cuts(n, length, masked, loss), 0
        for start, size, bears in pieces:
            assert start == at and 0 < size <= length and bears <= (loss or length)
            assert bears == sum(i >= masked and i > start for i in range(start, start + size))
            at += size
        assert at == n


def test_three_limits_bind(spark):
    """Each limit stops some sequence that the two others would let grow."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["tokens", "word", "x"]) for _ in range(rng.choice((1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 1, 1, 30, 60, 200)))) for _ in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    limits = {"length": 64, "segments": 4, "loss_tokens": 56}
    got = packing.pack(packing.cut_documents(docs, PATH, 64, 2, masked=6, loss=56), limits, size="length").toPandas()
    sums = got.groupby("sequence_id")[list(limits)].sum()
    assert all((sums[name] <= most).all() for name, most in limits.items())
    for name, most in limits.items():
        others = [n for n in limits if n != name]
        assert ((sums[name] == most) & (sums[others] < [limits[n] for n in others]).all(axis=1)).any(), name


def test_every_id_once_and_sequences_without_gaps(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Über", "tokens", "a,b", "42nd", "don't", "x"]) for _ in range(rng.choice((1, 9, 40, 300)))) for _ in range(120)] + [None, "", " \n"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int")
    limits = {"length": 64, "segments": 5, "loss_tokens": 60}
    got = packing.pack(packing.cut_documents(docs, PATH, length=64, end_id=2), limits, size="length").collect()
    tokenizer, pieces, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            part = ids[at:at + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and len(some) <= 5
        assert len(some) == 1 or sum(r.loss_tokens for r in some) <= 60  # one piece alone may be above
    assert packing.pack(packing.cut_documents(docs.limit(0), PATH, 64, 2), limits, "length").count() == 0
