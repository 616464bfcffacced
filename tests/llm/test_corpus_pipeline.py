"""The whole pipeline against a plain one over 200 documents."""

import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from test_jaccard_join import brute as components
from test_mixing import targets
from test_quality import brute as measures
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerleaf.llm import pii
from ledgerleaf.llm.registry import LIMITS, MASKED, PII_KEY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _words int, mix_words string, kept boolean, component long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    rng = random.Random(21)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts = []
    while len(texts) < 180:
        base = [rng.choice(words) for _ in range(rng.choice((3, 12, 40, 90, 300)))]
        for _ in range(rng.choice((1, 1, 2, 6))):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy.insert(len(copy) // 2, rng.choice(["+1 (543) 555-7713", "a.b@example.com", "2024-08-05", "password=p4ssw0rd1"]))
            texts.append(" ".join(copy))
    texts += ["again and again we say " * 30, None, "", " \n\t", "naïve Été " + " ".join(rng.sample(words, 30)), "z" * 3000 + " " + " ".join(rng.sample(words, 40))]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["hot"] * 3 + ["s1", "s2", None, ""]), None if t is None else len(t), 7, "x", None, 3) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[1], (None, "a row without an id " + " ".join(rng.sample(words, 30)), "en", "s1", 1, 7, "x", True, 4)]


def plain(rows):
    """What goes into the mix."""
    good = []
    for r in rows:
        n, *_, repeated = measures(r[1])
        if n >= 10 and 100 * repeated <= 20 * n:
            good.append(r)
    one_each, seen = [], set()
    labels = components([(r[0], r[1]) for r in good], 5, 80)
    component = {doc_id: least for doc_id, _, least in labels}
    for r in good:
        key = component[r[0]]
        if (r[0] is None or key == r[0]) and key not in seen:
            seen.add(key)
            one_each.append(r)
    hide = pii.Permuter(PII_KEY)
    return [(r[0], hide.text(r[1])[0], r[3]) for r in one_each]


def test_against_plain_python(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, tokenizer = plain(rows), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2] for r in want}

    pieces = {}
    for r in got:
        assert r.doc_id in ids
        pieces.setdefault(r.doc_id, Counter())[r.start, r.length, r.ids_crc32, r.loss_tokens] += 1
    sizes, taken = Counter(), Counter()
    for doc_id, text, source in want:
        sizes[source] += len(WORD.findall(text))
        if doc_id in pieces:
            epochs = set(pieces[doc_id].values())
            assert len(epochs) == 1 and epochs <= {1, 2}
            taken[source] += epochs.pop() * len(WORD.findall(text))
            cut = sorted(pieces[doc_id])
            assert [c[0] for c in cut] == [0, *[c[0] + c[1] for c in cut]][:-1] and sum(c[1] for c in cut) == len(ids[doc_id])
            for start, length, crc, loss in cut:
                part = ids[doc_id][start:start + length]
                assert crc == zlib.crc32(struct.pack(f"<{length}I", *part)) and loss == sum(i >= MASKED and i > start for i in range(start, start + length))
    aims, most = targets(dict(sizes)), max(len(WORD.findall(t)) for _, t, _ in want)
    assert all(abs(taken[s] - aims[s]) <= 2 * most for s in sizes)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= LIMITS["length"] and len(some) <= LIMITS["segments"] and sum(r.loss_tokens for r in some) <= LIMITS["loss_tokens"]


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{k}"))


@pytest.mark.parametrize("columns", [["doc_id", "text", "lang", "source", "n_chars"], ["doc_id", "text", "source"]])
def test_empty_table(spark, tmp_path, columns):
    spark.createDataFrame([], SCHEMA).select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
