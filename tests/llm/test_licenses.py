"""Licence labels and places against a plain scan of every position."""

import random
import re

from ledgerleaf.llm import licenses

WORD = re.compile(licenses.WORD)


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    def starts(phrase):
        p = phrase.split()
        return [i for i in range(len(words)) if words[i:i + len(p)] == p]

    base = [s for t in licenses.BASE for p in t.phrases for s in starts(p)]
    names = lambda ts: ",".join(sorted({t.label for t in ts if all(starts(p) for p in t.phrases)}))
    return (len(words), len(base), min(base, default=None), max(base, default=None), names(licenses.BASE), names(licenses.TEMPLATES))


def test_scan(spark):
    rng = random.Random(3)
    phrases = [p for t in licenses.TEMPLATES for p in t.phrases]
    filler = "the of license public general mit apache use permission über été version 2 0 is".split()
    texts = [None, "", "MIT-License. MIT license mit\nLICENSE", "mit mit license general general public license", "Apache\x7fLicense, Version 2.0", "ÀMIT license"]
    for _ in range(150):
        parts = [rng.choice(filler) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(phrases).split()
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "x"
            parts[(k := rng.randint(0, len(parts))):k] = p
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts).title())
    texts.append("word " * 60_000 + "Released under the MIT License.")
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, texts[2], "x", 1.0), (2, texts[2], "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[2 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(text), text
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.labels)
    assert licenses.scan(docs.limit(0)).count() == 0
