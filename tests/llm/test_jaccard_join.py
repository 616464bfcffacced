"""Components of the similarity join against all pairs."""

import random
import re

import pyarrow as pa
import pytest

from ledgerleaf.llm import jaccard_join

SCHEMA = "doc_id long, text string, set string, token int, component long"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = [shingles(r[1], width) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return sorted(((r[0], len(s), least.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((8, 40, 120, 400)))]
        for _ in range(rng.choice((1, 2, 12))):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(10)]
    texts += [None, "", " \n", "one", "One", "one two", "one two", "Été a b c", "été a b c", "z " * 5000, "z " * 4000]
    rng.shuffle(texts)
    rows = [(i, t, "x", 1, None) for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "x", 1, None), (3, texts[8], "y", 2, 7), (None, texts[9], "x", 1, None), (None, "lonely row without id", "x", 1, None)]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_components_match_all_pairs(spark, width, percent):
    rows = corpus()
    got = jaccard_join.linked(spark.createDataFrame(rows, SCHEMA), width, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, width, percent)


def test_one_of_each_and_empty(spark):
    rows = [r for r in corpus() if r[2] != "y"]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard_join.one_each(docs)
    assert kept.columns == docs.columns
    groups = brute(rows, 5, 80)
    want = len({g[2] for g in groups if g[1] and g[2] is not None}) + sum(g[1] == 0 or g[2] is None for g in groups)
    assert kept.count() == want
    assert jaccard_join.linked(docs.limit(0)).count() == 0 and jaccard_join.one_each(docs.limit(0)).count() == 0


def test_sketches_never_differ_more_than_sets():
    rng = random.Random(9)
    for _ in range(200):
        x, y = (jaccard_join.np.unique(jaccard_join.np.array([rng.randrange(2 ** 64) if rng.random() < 0.3 else k * 0x9E3779B97F4A7C15 % 2 ** 64 for k in range(rng.randrange(1, 600))], "uint64")) for _ in "ab")
        bits = jaccard_join.np.unpackbits((jaccard_join.sketch(x) ^ jaccard_join.sketch(y)).view("uint8")).sum()
        assert bits <= len(jaccard_join.np.setxor1d(x, y)) and len(jaccard_join.sketch(x)) == jaccard_join.SKETCH


def test_many_near_copies_of_one_text(spark):
    """A family whose members differ by more and more: links between components, found past the hubs."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):
        copy = list(base)
        for k in rng.sample(range(150), rng.randrange(0, 14)):
            copy[k] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy), "x", 1, None))
    for width, percent in ((3, 90), (5, 80)):
        got = jaccard_join.linked(spark.createDataFrame(rows, SCHEMA), width, percent)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, width, percent)


def test_blocks_hold_the_upper_bytes_of_tokens():
    tokens = jaccard_join.Sets(3).of(b"some words that make a few shingles of three")
    block = jaccard_join.Block(90, jaccard_join.EVERY)
    block.add(1, tokens)
    content = block.batch(pa.int64()).column("tokens")[0].as_py()
    assert len(content) == 7 * len(tokens)
    assert (jaccard_join.unpacked(content) == tokens >> 8 << 8).all() and len(jaccard_join.unpacked(b"")) == 0
