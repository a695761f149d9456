"""Passages of benchmark items in documents, by suffix automata of the items."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm import text as tx
from lumisift.llm.automaton import SuffixAutomaton
from lumisift.llm.common import PIECE, Scratch, by_row

BLOCK_BYTES = 1 << 20  # item text in one automaton, which then takes some 150 MB


def _block(window: int):
    """Pickled (sorted word hashes, automaton, shortest window) of a block of items."""
    def fn(items: pa.Table) -> pa.Table:
        items = items.combine_chunks()
        words = tx.Words([b for c in items.column("text").chunks for b in tx.blobs(c)], tx.ALNUM)
        vocabulary = np.unique(words.hash)
        ids = np.searchsorted(vocabulary, words.hash).tolist()
        rows = [(item, ids[a:b]) for item, a, b in zip(items.column("item").to_pylist(), words.first[:-1], words.first[1:], strict=True)]
        shortest = min([min(len(w), window) for _, w in rows if w], default=window)
        packed = pickle.dumps((vocabulary, SuffixAutomaton(rows, window), shortest), protocol=5)
        return pa.table({"block": pa.array(items.column("block").to_pylist()[:1], pa.int64()), "packed": pa.array([packed], pa.binary())})
    return fn


def automata(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text",
             block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The items in blocks of about `block_bytes`, each an automaton built in a task and sent to all.

    The number of blocks follows the counted size of the items, so a worker holds one
    bounded automaton at a time however many items there are.
    """
    spark = items.sparkSession
    items = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    scratch = Scratch(spark)
    built = scratch.cut(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
                        .groupBy("block").applyInArrow(_block(window), "block bigint, packed binary"), "automata")
    numbers = [r.block for r in built.select("block").collect()]
    out = [spark.sparkContext.broadcast(built.filter(F.col("block") == b).first().packed) for b in numbers]
    scratch.drop(built)
    return out


_loaded: dict[bytes, tuple] = {}


def _load(block: Broadcast) -> tuple:
    """The unpickled block; a worker keeps one, which serves all its tasks if there is but one."""
    key = hashlib.md5(block.value).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(block.value)
    return _loaded[key]


class Hits:
    """Hit words and found items of a few texts."""

    def __init__(self, texts: list[bytes], blocks: list[tuple]):
        self.words = words = tx.Words(texts, tx.ALNUM)
        self.hit = np.zeros(len(words.hash), bool)
        self.items: list[set] = [set() for _ in texts]
        owner = words.text_of()
        for vocabulary, automaton, shortest in blocks:
            if not len(vocabulary):
                continue
            ids = np.searchsorted(vocabulary, words.hash)
            ids[ids == len(vocabulary)] = 0
            known = vocabulary[ids] == words.hash
            # Only runs of known words of one text can hold a window.
            joined = known.copy()
            joined[1:] &= known[:-1] & (owner[1:] == owner[:-1])
            joined[:1] = False
            start = np.flatnonzero(known & ~joined)
            stop = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
            long = stop - start >= shortest
            for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True):
                for at, size, found in automaton.matches(ids[a:b].tolist()):
                    self.hit[a + at - size + 1:a + at + 1] = True
                    self.items[owner[a]] |= found

    def spans(self, i: int) -> list[tuple[int, int, int]]:
        """(begin byte, end byte, words) of the maximal runs of hit words of text i."""
        w, first = self.words, self.words.first
        flags = self.hit[first[i]:first[i + 1]].view(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
        a, b = edge[::2] + first[i], edge[1::2] + first[i] - 1
        base = w.begins[i]
        return list(zip((w.start[a] - base).tolist(), (w.end[b] - base).tolist(), (b - a + 1).tolist(), strict=True))


def _scanned(batch: pa.RecordBatch, blocks: list[Broadcast]) -> Iterator[tuple[slice, list[bytes], Hits]]:
    blobs = tx.blobs(batch.column("text"))
    for piece in tx.chunks([len(b) for b in blobs], PIECE):
        yield piece, blobs[piece], Hits(blobs[piece], (_load(b) for b in blocks))


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         window: int = 10) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case. A
    word is hit if it is in an occurrence of `window` consecutive words of an item, or
    of a whole item of fewer words. items_sha256 is that of the ids of the items with
    occurring windows, sorted as strings and joined by commas.

    Null and empty texts have no words. Items without words match nothing; items that
    repeat an id count once; an item without an id hits words but is not counted.
    """
    blocks = automata(items, window)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit, n_items, digest = [], [], [], []
        for _, texts, found in _scanned(batch, blocks):
            first = found.words.first
            hits = np.concatenate([[0], np.cumsum(found.hit)])
            n_words.append(found.words.counts)
            n_hit.append(hits[first[1:]] - hits[first[:-1]])
            named = [sorted(i for i in s if i is not None) for s in found.items]
            n_items += map(len, named)
            digest += [hashlib.sha256(",".join(s).encode()).hexdigest() for s in named]
        n_hit = np.concatenate(n_hit)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.concatenate(n_words), pa.int64()), pa.array(n_hit, pa.int64()),
             pa.array(n_items, pa.int64()), pa.array(digest), pa.array(n_hit > 0)],
            ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    schema = "id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return by_row(docs, fn, schema).withColumnRenamed("id", id_col)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """`docs` with benchmark passages cut out of the text; documents covered beyond `max_coverage` go.

    A passage is a maximal run of hit words, from its first to its last byte. Rows
    without hits, null texts among them, stay as they are.
    """
    blocks = automata(items, window)
    names = docs.columns
    raw = f"c{names.index(text_col)}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        stay, texts = [], []
        for piece, blobs, found in _scanned(batch.rename_columns(["text" if c == raw else c for c in batch.schema.names]), blocks):
            for i, blob in enumerate(blobs):
                spans = found.spans(i)
                if not spans:
                    stay.append(True)
                    texts.append(blob)
                    continue
                stay.append(sum(s[2] for s in spans) <= max_coverage * found.words.counts[i])
                parts, at = [], 0
                for begin, end, _ in spans:
                    parts.append(blob[at:begin])
                    at = end
                texts.append(b"".join([*parts, blob[at:]]))
        where = batch.schema.get_field_index(raw)
        had = batch.column(where).is_valid().to_pylist()
        text = pa.array([t.decode() if h else None for t, h in zip(texts, had, strict=True)], pa.string())
        return batch.set_column(where, raw, text).filter(pa.array(stay))

    out = by_row(plain, fn, ", ".join(f"{c} {t}" for c, t in plain.dtypes))
    return out.toDF(*names)
