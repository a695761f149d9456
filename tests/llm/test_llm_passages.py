import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumisift.llm import repeats, suffix


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=70))
def test_suffix_array(symbols):
    t = np.array([*symbols, 0], np.uint16)
    assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=25), st.integers(1, 2)), min_size=1, max_size=8), st.integers(1, 7))
def test_repeated_windows(pieces, window):
    raw, weights = [p.encode() for p, _ in pieces], np.array([w for _, w in pieces])
    count = Counter()
    for p, m in zip(raw, weights):
        for i in range(len(p) - window + 1):
            count[p[i:i + window]] += int(m)
    want = {(k, i) for k, p in enumerate(raw) for i in range(len(p) - window + 1) if count[p[i:i + window]] > 1}
    got = {(int(p), i) for p, a, b in zip(*repeats.repeated_windows(raw, weights, window)) for i in range(a, b + 1)}
    assert got == want


def brute(rows, window):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(x[i:i + window] for x in raw for i in range(len(x) - window + 1))
    out = []
    for (doc, _), x in zip(rows, raw):
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - window + 1):
            if count[x[i:i + window]] > 1:
                gone[i + 1:i + 1 + window] = True
        rest = bytes(b for b, g in zip(x, gone[1:-1]) if not g)
        out.append((doc, len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def passages(seed, n):
    r = random.Random(seed)

    def text(k):
        return "".join(r.choice("abcdefgé \n") for _ in range(k))

    shared = [text(k) for k in (70, 120, 260)]
    rows = [(i, text(r.randrange(200)) + r.choice([*shared, "", "x" * 150]) + text(r.randrange(200)) + r.choice([*shared, ""])) for i in range(n)]
    return rows + [(n, rows[0][1]), (n + 1, rows[1][1][3:-3]), (n + 2, rows[2][1] * 3)]


def test_against_brute_force(make):
    for window in (50, 64, 100):
        rows = passages(window, 60)
        assert found(repeats.passage_report(make(rows), window=window)) == brute(rows, window)


def test_hot_anchors_are_cut_up_without_loss(make, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 1)
    rows = passages(9, 60)
    assert found(repeats.passage_report(make(rows), window=64)) == brute(rows, 64)


def rows_sent(monkeypatch, run):
    """Rows that tasks which suffix-sort are sent, by key, and windows of hot anchors, by hash."""
    cut, seen = repeats.Scratch.cut, {}

    def spy(self, df, label):
        out = cut(self, df, label)
        if label == "pieces":
            seen["sorted"] = Counter(r.anchor for r in out.filter("bytes IS NOT NULL").collect())
            seen["names"] = out.filter("bytes IS NULL").select("anchor", "content", "part").collect()
        return out
    monkeypatch.setattr(repeats.Scratch, "cut", spy)
    return run(), seen


def test_copies_are_sent_once(make, monkeypatch):
    rows = [(i, "copy " + LONG_TEXT) for i in range(50)]
    got, seen = rows_sent(monkeypatch, lambda: found(repeats.passage_report(make(rows), window=64)))
    assert got == brute(rows, 64) and max(seen["sorted"].values()) < 5


def test_a_passage_amid_different_texts_fills_no_list(make, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 10)
    r = random.Random(3)

    def other():
        return "".join(r.choice("abcdefg \n") for _ in range(150))
    rows = [(i, other() + LONG_TEXT + other()) for i in range(60)]
    got, seen = rows_sent(monkeypatch, lambda: found(repeats.passage_report(make(rows), window=64)))
    assert got == brute(rows, 64) and max(seen["sorted"].values(), default=0) <= 10
    assert len(seen["names"]) == len(set(seen["names"])) > 0


LONG_TEXT = "".join(random.Random(8).choice("abcdefghij ") for _ in range(400))


def test_messy_and_empty(make, messy):
    rows = [(d, t if t is None or len(t) < 1000 else t[:4000]) for d, t in messy]
    assert found(repeats.passage_report(make(rows), window=60)) == brute(rows, 60)
    assert found(repeats.passage_report(make([]), window=60)) == []


def test_long_text_and_its_copy_lose_all_but_the_end(make, messy):
    got = {r[0]: r for r in found(repeats.passage_report(make(messy), window=200))}
    assert got[5][2] == got[5][1] and got[6][1] - got[6][2] <= 4 and got[1][2] == 0


def test_cutting_keeps_rows_columns_and_characters(make, messy):
    text = "é" * 300
    docs = make([*messy, (20, "x" + text + "y"), (21, "zz" + text)])
    out = repeats.without_passages(docs, "text", 201)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    # An odd window leaves half a character at one end: it stays whole.
    assert texts[2] is None and texts[3] == "" and set(texts[20]) <= set("xyé") and len(texts[20]) <= 4 and texts[7] == "a b"


def test_variants_of_a_hot_anchor_go_by_slices(make, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 10)
    r = random.Random(4)

    def near_copy():  # one character in forty is another
        return "".join(r.choice("abcdefg") if r.random() < 0.025 else c for c in LONG_TEXT)
    rows = [(i, near_copy()) for i in range(60)]
    want = {i: t.encode() for i, t in rows}
    count = Counter(x[i:i + 64] for x in want.values() for i in range(len(x) - 63))
    got, seen = rows_sent(monkeypatch, lambda: found(repeats.passage_report(make(rows), window=64)))
    repeated = sum(count[x[i:i + 64]] > 1 for x in want.values() for i in range(len(x) - 63))
    assert got == brute(rows, 64) and 0 < len(seen["names"]) < repeated / 4
