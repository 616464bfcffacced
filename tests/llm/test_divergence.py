import random
import re
from collections import Counter, defaultdict

import numpy as np

from ledgerleaf.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, term int, block string, value binary"


def brute(docs, least=3, top=200):
    docs = [((text or ""), lang or "", source or "") for text, lang, source in docs]
    times, within = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall(text.translate(UPPER))
        times[lang, source].update(terms)
        within[lang].update(set(terms))
    out = []
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in within[lang].items() if n >= least]
        sources = {d[2] for d in docs if d[1] == lang}
        total = Counter()
        for s in sources:
            total.update(times[lang, s])

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        of, q = {s: shares(times[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = [(sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((of[s][t] - q[t]) ** 2 // q[t], t) for t in kept if times[lang, s][t] and of[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def documents(seed, n=300):
    rnd = random.Random(seed)
    words = ["Über", "naïve", "don't", "x1y", "ÉCOLE", "école", "漢字", "a", "B", "\x80z", "end.", "mid-dle"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(n):
        source = "s0" if rnd.random() < 0.4 else rnd.choice(["s1", "s2", None, "", "Ş"])
        lean = words if source != "s2" else words[:20]
        rows.append((rnd.choice([None, "", " ".join(rnd.choices(lean, k=rnd.randint(0, 60)))] + [" ".join(rnd.choices(lean, k=30))] * 4), rnd.choice(["en", "de", None]), source))
    return rows + [("only twice", "xx", "a"), ("only twice", "xx", "b"), (None, "yy", "a"), ("x " * 50_000, "en", "s1")] + rows[:40]


def run(spark, rows, **how):
    table = spark.createDataFrame([(i, t, lang, s, 1, "b", b"v") for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in divergence.audit(table, **how).collect())


def test_against_brute_force(spark, monkeypatch):
    rows = documents(3)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least_docs=10, top=5) == brute(rows, 10, 5)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 8)
    rows = documents(4, 150)
    assert run(spark, rows) == brute(rows)


def test_flushed_counts(spark):
    rows = documents(5, 60)
    table = spark.createDataFrame([(i, t, lang, s, 1, "b", b"v") for i, (t, lang, s) in enumerate(rows)], SCHEMA).coalesce(1)
    total = Counter()
    for r in divergence.counted(table).collect():
        total[r.lang, r.source, r.term] += r.docs if r.term is None else r.n
    want = Counter()
    for text, lang, source in rows:
        want[lang or "", source or "", None] += 1
        want.update((lang or "", source or "", t) for t in TERM.findall((text or "").translate(UPPER)))
    assert total == want


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)]) == []
    assert run(spark, [(None, None, "a"), ("x", None, "b")]) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_equal_stretches_share_nodes():
    leaves = np.array([[1, 1, 1, 2, 1, 1, 1, 1], [1, 1, 1, 3, 1, 1, 1, 1]])
    levels = divergence._consed(leaves)
    assert [len(np.unique(level)) for level in levels] == [3, 3, 3, 2]
    x, y, times = divergence._meeting(*levels[-1][:, 0], divergence._children(levels))
    assert sorted(zip(x.tolist(), y.tolist(), times.tolist())) == [(1, 1, 7), (2, 3, 1)]
