import hashlib
import random
import re

from lumisift.llm import decontaminate
from lumisift.llm.automaton import SuffixAutomaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, named = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i:i + n])]
        named = sorted(str(x) for x in named if x is not None)
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, id int")


def case(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items = [(i, t) for i, t in items if len(words(t)) != 1] + [(50, None), (51, "rare"), (51, "rare"), (None, "w0 W1 w2")]
    rows = []
    for doc in range(60):
        parts = [" ".join(r.choices(vocabulary + ["zz", "Q"], k=r.randrange(20)))]
        for _ in range(r.randrange(3)):
            w = words(r.choice(items)[1])
            a = r.randrange(len(w) + 1)
            parts.append("-".join(w[a:a + r.randrange(15)]))
        rows.append((doc, ", ".join(parts)))
    return rows, items


def test_against_brute_force(spark, make, messy):
    for seed in (1, 2):
        rows, items = case(seed)
        rows += [(d if d is None else d + 1000, t) for d, t in messy]
        assert found(decontaminate.contamination_report(make(rows), items_frame(spark, items))) == brute(rows, items)


def test_many_blocks_of_items(spark, make, monkeypatch):
    rows, items = case(3)
    whole = decontaminate.automata
    monkeypatch.setattr(decontaminate, "automata", lambda df, window: whole(df, window, block_bytes=60))
    assert found(decontaminate.contamination_report(make(rows), items_frame(spark, items))) == brute(rows, items)


def test_empty_tables(spark, make):
    assert found(decontaminate.contamination_report(make([]), items_frame(spark, [(1, "a b")]))) == []
    assert found(decontaminate.contamination_report(make([(1, "a b")]), items_frame(spark, []))) == brute([(1, "a b")], [])


def test_spans_are_cut_and_covered_documents_go(spark, make, messy):
    item = " ".join(f"q{i}" for i in range(12))
    docs = make([*messy, (20, "before it, " + item.upper() + "; " + "after " * 20), (21, item + " x"), (22, "clean text")])
    out = decontaminate.without_items(docs, items_frame(spark, [(1, item)]), "text", 10, 0.5)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[20] == "before it, ; " + "after " * 20 and 21 not in texts and texts[22] == "clean text" and texts[2] is None
    assert out.count() == docs.count() - 1


def test_automaton_tracks_longest_runs():
    r = random.Random(4)
    for _ in range(60):
        items = [(k, r.choices(range(3), k=r.randrange(1, 12))) for k in range(4)]
        automaton = SuffixAutomaton(items, 4)
        stream = r.choices(range(4), k=40)
        state = matched = 0
        for at, word in enumerate(stream):
            state, matched = automaton.step(state, matched, word)
            best = max(n for n in range(at + 2) if n == 0 or any(stream[at - n + 1:at + 1] == i[a:a + n] for _, i in items for a in range(len(i))))
            assert matched == best
