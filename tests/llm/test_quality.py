"""Counts against plain Python; learned rules against held-out labels."""

import random
import re

from pyspark.sql import functions as F

from ledgerleaf.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in set(windows) if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(2)
    vocabulary = "the of and thing ende été größe x y z".split()
    out = [None, "", " \n\t", "one", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n x\ny", "日本 語 #$ | <b> \x0bq\x0cr"]
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))).replace("of", "of\n") for _ in range(60)]
    out.append("w " * 3000 + " ".join(f"u{i}" for i in range(20000)))
    return out


def test_counts(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "a b", "x", 1), (3, "one", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int")
    got = quality.measures_of(docs).collect()
    assert len(got) == len(rows)
    for r in got[:0] + [r for r in got if r.doc_id is not None and r.doc_id < 68]:
        assert tuple(r[c] for c in quality.COUNTS) == brute(rows[r.doc_id][1]), rows[r.doc_id][1]
    long = next(r for r in got if r.doc_id == 68)
    assert (long.n_words, long.n_repeat_words) == (23000, 3000)


def test_learned_list(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 9999)) for _ in range(rng.randint(20, 80))]
        if bad and i % 2:
            words = [w + rng.choice("#$%") * 3 for w in words]
        text = " ".join(words) if not bad or i % 2 else "\n".join(" ".join(words[:6] + [str(k)]) if k % 4 == 0 else "menu here" for k in range(40)) + " " + " ".join(words)
        rows.append((i, text, "s", True))
        labels.append((i, None if i % 50 == 7 else int(not bad), "z"))
    labels += [(3, 1, "z"), (None, 0, "z")]
    docs = spark.createDataFrame(rows + [(None, "x " * 3, "s", None), (601, None, "s", None)], "doc_id long, text string, n_words string, kept boolean")
    tags = spark.createDataFrame(labels, "doc_id long, quality int, bad string")
    rules = quality.learn(quality.measures_of(docs.where("doc_id < 400")), tags)
    assert 1 <= len(rules) <= 8 and all(1 <= len(r) <= 4 for r in rules)
    got = {r.doc_id: r.kept for r in quality.judged(quality.measures_of(docs), rules).collect()}
    assert sum(got[i] == (i % 5 != 0) for i in range(400, 600)) >= 190 and not got[601]
    out = quality.kept(docs, tags)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, k in got.items() if k}
    assert quality.learn(quality.measures_of(docs), tags.where(F.lit(False))) == []
    assert quality.kept(docs.limit(0), tags).count() == 0


def test_names_that_clash(spark):
    names = "_words _n _lines _hashes _windows _sorted _covered _doc _text _quality kept rule n_words bad grow size_step base_failed".split()
    docs = spark.createDataFrame([(1, "a few words that are quite enough for the rule here", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.kept(docs, labels).collect() == docs.collect()
