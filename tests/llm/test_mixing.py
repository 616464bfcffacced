"""Fair queueing against a plain queue over all entries."""

import re

import pytest

from ledgerleaf.llm import mixing

SCHEMA = "doc_id long, source string, text string, size long, taken string"


def targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, rest = budget * sum(sizes.values()), {}, set(names)
    while rest:
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = {s for s in rest if share[s] > most * sizes[s]}
        if not above:
            return full | share
        full |= {s: most * sizes[s] for s in above}
        rest -= above
    return full


def rows():
    out = []
    for i in range(400):
        source = None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 5}"
        text = None if i % 50 == 1 else "" if i % 50 == 2 else "wort " * (i * 7 % 40 + (900 if i == 77 else 0)) + "\tz"
        out.append((i, source, text, 5, "x"))
    out += [(5, "hot", "same text", 1, None)] * 3 + [(None, "hot", "no id here", 1, None)]
    return out


def test_queue_matches_brute_force(spark):
    data = rows()
    got = mixing.fair_queue(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, source, text, *_ in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for source, words in taken.items():
        assert abs(words - want[source]) <= 950
    first = [(r.finish, r.source or "", r.size) for r in got if r.size]
    entries = sorted(first + [(f + r.source_size / r.target, s, z) for r, (f, s, z) in zip([r for r in got if r.size], first)], key=lambda e: e[:1])
    total, upto = 1.5 * sum(sizes.values()), 0
    for finish, _, size in entries:
        upto += size
        if upto > total:
            break
    latest = max(r.finish for r in got if r.taken)
    assert latest <= finish
    again = mixing.fair_queue(spark.createDataFrame(data[::-1], SCHEMA)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.size, r.finish)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and sorted(got, key=key)


def test_mixed_rows_and_empty(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {(r.doc_id, r.source, r.size): r.epochs for r in mixing.fair_queue(docs).collect()}
    counts = out.groupBy("doc_id", "source", "text").count().collect()
    for r in counts:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        if (r.doc_id, r.source) not in ((5, "hot"),):
            assert r["count"] == taken[r.doc_id, r.source, size]
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.fair_queue(docs.limit(0)).count() == 0


def test_names_that_clash(spark):
    names = "mix_words mix_doc mix_source mix_size mix_epochs own_row own_doc own_size key cell turn size total taken target".split()
    docs = spark.createDataFrame([(1, "s", "a few words", *range(len(names)))], "doc_id long, source string, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.mixed(docs, budget=2, max_epochs=2)
    assert got.columns == docs.columns and got.collect() == docs.collect() * 2
