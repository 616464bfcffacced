"""Snapshot collapse and rendering against plain Python."""

import random

from ledgerleaf.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, k string, n int"


def brute(rows):
    convs = {}
    low = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    for c, turn, role, text, *_ in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((low(turn), (role is not None, role or ""), (text is not None, text or ""), role, text))
    bodies = {}
    for c, turns in convs.items():
        bodies.setdefault(tuple(t[3:] for t in sorted(turns)), []).append(c)
    longer = {b[:k] for b in bodies for k in range(1, len(b))}
    return {min(cs): (len(b), len(cs), "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in b)) for b, cs in bodies.items() if b not in longer}


def test_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    monkeypatch.setattr(chat, "PART", 5)
    rng = random.Random(9)
    rows, base = [], [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(30)]
    for c in range(60):
        n, start = rng.randint(1, 12), rng.choice([0, 1, 7])
        own = base[:n] if c % 3 else [(r, rng.choice([t, t + "!", None, ""])) for r, t in base[:n]]
        rows += [(c, start + k, r, t, "x", c) for k, (r, t) in enumerate(own)]
    rows += [(100, k, *base[k], "x", 1) for k in range(30)] + [(101, k, *base[k], "x", 1) for k in range(30)] * 2
    rows += [(102, None, "user", "a", "x", 1), (102, None, None, "b", "x", 1), (103, 5, "user", "same", "", 1), (103, 5, "user", "more", "", 1), (None, 0, "user", "lost", "", 1)]
    got = chat.rendered(spark.createDataFrame(rows, SCHEMA)).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.part):
        n, copies, text = whole.get(r.conv_id, (r.n_turns, r.copies, ""))
        assert r.last_turn - r.first_turn < 5
        whole[r.conv_id] = (n, copies, text + r.text)
    assert whole == brute(rows)
    assert chat.rendered(spark.createDataFrame([], SCHEMA)).count() == 0
