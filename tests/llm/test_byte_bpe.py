import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from ledgerleaf.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(byte_bpe.vocabulary(PATH))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = byte_bpe.Encoder(RANKS, P.PATTERN)
TOKENS = {rank: token for token, rank in RANKS.items()}


def ids_of(text):
    return list(memoryview(ENCODER.texts([text])[0]).cast("I"))


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aab \n\t'stdé漢　!?12\x1c\x85AB", max_size=60)))
def test_ids_are_the_library_s(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_001, "".join(random.Random(4).choices("abcé", k=60_000)), " " * 3000, "=" * 999])
def test_very_long_matches(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_queue_gives_the_lowest_rank_from_left_to_right():
    queue, rnd, held = byte_bpe.RankQueue(70_000), random.Random(1), {}
    for _ in range(5000):
        if held and rnd.random() < 0.3:
            rank = queue.lowest()
            assert rank == min(held) and queue.take(rank) == sorted(held.pop(rank))
        else:
            rank, position = rnd.choice([rnd.randrange(70_001), 255, 256]), rnd.randrange(1000)
            held.setdefault(rank, []).append(position)
            queue.push(rank, position)
    while (rank := queue.lowest()) >= 0:
        assert queue.take(rank) == sorted(held.pop(rank))
    assert not held and not any(word for level in queue.levels for word in level)


def test_matches_that_go_through_one_queue():
    rnd = random.Random(3)
    pieces = ["".join(rnd.choices("abcdehinorst é漢", k=rnd.randint(1, 30))).encode() for _ in range(3000)]
    for piece, ids in zip(pieces, ENCODER.merged(pieces)):
        assert b"".join(TOKENS[i] for i in memoryview(ids).cast("I")) == piece
        assert ids == ENCODER.merged([piece])[0]


def test_a_lower_rank_goes_first():
    """With ranks as no training gives them: joining b and c brings a pair of a lower rank."""
    ranks = {bytes([i]): i for i in range(97, 108)} | {b"bc": 210, b"abc": 205, b"ab": 230, b"bcd": 220}
    library = tiktoken.Encoding("odd", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    encoder, rnd = byte_bpe.Encoder(ranks, r"\w+"), random.Random(8)
    for _ in range(500):
        text = "".join(rnd.choices("abcd", k=rnd.randint(1, 14)))
        assert list(memoryview(encoder.texts([text])[0]).cast("I")) == library.encode_ordinary(text)


def test_rows(spark):
    texts = ["the quick brown fox", None, "", "the quick brown fox", "naïve 漢字 " * 3000, "x" * 100_000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 7, [1], b"x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids array<int>, decoded binary")
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH)
    found = {r.doc_id: r for r in byte_bpe.digests(rows).collect()}
    for i, text in enumerate(texts):
        ids = LIBRARY.encode_ordinary(text or "")
        row = found[i if i != 3 else None]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH, P.PATTERN), PATH)).count() == 0


def test_decode_keeps_rows_and_refuses_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 255])], "decoded int, ids array<int>").withColumn("more", spark_null())
    out = byte_bpe.decode(rows, PATH)
    assert out.columns == ["ids", "more", "decoded"]
    by_id = {0: next(t for t, r in RANKS.items() if r == 0), 255: next(t for t, r in RANKS.items() if r == 255)}
    assert sorted(bytes(r.decoded) for r in out.collect()) == sorted([b"", b"", by_id[0] + by_id[255]])
    with pytest.raises(ValueError):
        byte_bpe.decoded(byte_bpe.np.array([60_000]), byte_bpe._tokens(byte_bpe.vocabulary(PATH)))


def spark_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")
