"""Token counts of a unigram vocabulary, without building the tokens."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # stands for a blank inside pieces
# Kinds of pieces in the model file.
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000  # counts a worker keeps; beyond that it starts afresh


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at:at + size]
        at += size


class UnigramCounter:
    """Number of pieces on the best path through a text, by the vocabulary's scores.

    The text is written with a leading blank and blanks as marks. Of all ways to cut it
    into pieces the one with the highest sum of scores counts. A character without a
    piece of its own may stand alone at the lowest score less ten; it counts one token
    per UTF-8 byte. Of equal sums at a place the tokenizer keeps the one found first,
    which is the one whose last piece begins first, and so does this count.

    No piece goes on after a blank that follows another character, so every run of
    blanks with the word after it is cut on its own, and each different one is cut once.
    """

    def __init__(self, model: bytes):
        pieces, kinds = {}, set()
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                kinds.add(kind := piece.get(3, NORMAL))
                if kind in (NORMAL, USER_DEFINED, UNUSED):
                    pieces[piece[1].decode()] = (score, kind)
            elif field == 3 and dict(_fields(value)).get(2):
                raise ValueError("models that normalise characters are not supported")
        if BYTE not in kinds:
            raise ValueError("a model with byte pieces is needed")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces that go on after a blank are not supported")
        scores = [s for s, k in pieces.values() if k == NORMAL]
        self.unknown = min(scores) - UNKNOWN_PENALTY
        top = max(scores)
        self.characters = {c for p in pieces for c in p}
        self.automaton = ahocorasick.Automaton()
        for piece, (score, kind) in pieces.items():
            if kind != UNUSED:
                bonus = len(piece.encode()) * top - 0.1 if kind == USER_DEFINED else score
                self.automaton.add_word(piece, (len(piece), bonus, 1))
        for c in self.characters:
            if c not in pieces:
                self.automaton.add_word(c, (1, self.unknown, len(c.encode())))
        # Characters in no piece at all are replaced by stand-ins, one for each length in bytes.
        free = (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in self.characters)
        self.stand_ins = {n: next(free) for n in (1, 2, 3, 4)}
        for n, c in self.stand_ins.items():
            self.automaton.add_word(c, (1, self.unknown, n))
        # A line end is in no longer piece, so it parts words as well.
        if any("\n" in p and len(p) > 1 for p in pieces):
            raise ValueError("pieces that hold a line end and more are not supported")
        if "\n" not in pieces:
            self.automaton.add_word("\n", (1, self.unknown, 1))
        self.automaton.make_automaton()
        self.parts = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self._forget()

    def _forget(self) -> None:
        self.cache = {"\n": 1}

    def _cut(self, words: list[str]) -> None:
        """Keep the count of each word: best sums and their counts by place, from the matches that end there."""
        joined = "\n".join(words)
        strange = set(joined) - self.characters - {"\n"}
        table = str.maketrans({c: self.stand_ins[len(c.encode())] for c in strange})
        joined = joined.translate(table)
        size = len(joined)
        best, count = [0.0] * (size + 1), [0] * (size + 1)
        here, score, tokens = -1, 0.0, 0
        for end, (length, gain, n) in self.automaton.iter(joined):
            start = end + 1 - length
            if end != here:
                best[here + 1], count[here + 1] = score, tokens
                here, score, tokens = end, best[start] + gain, count[start] + n
                if joined[end] == "\n":  # words start afresh
                    score, tokens = 0.0, 0
            elif best[start] + gain > score:
                score, tokens = best[start] + gain, count[start] + n
        best[here + 1], count[here + 1] = score, tokens
        at = 0
        for word in words:
            self.cache[word] = count[at + len(word)]
            at += len(word) + 1

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts = self.parts.findall((SPACE + text.replace(" ", SPACE)) if text else "")
            missing = list({p for p in parts if p not in self.cache})
            if len(self.cache) + len(missing) > CACHED_WORDS:
                self._forget()
                missing = list(set(parts) - set(self.cache))
            for begin in range(0, len(missing), 20_000):
                self._cut(missing[begin:begin + 20_000])
            out.append(sum(map(self.cache.__getitem__, parts)))
        return out


@lru_cache(1)
def counter(model: bytes) -> UnigramCounter:
    """One per worker, so its cache of words serves all tasks of the worker."""
    return UnigramCounter(model)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens) for every document.

    `model_path` is a vocabulary file that Spark can read. Null and empty texts have no
    tokens. A text is cut as a whole; nothing is truncated. Rows that repeat others and
    null ids are counted like any.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(model_path).select("content").first()[0]))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(counter(model.value).count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), counts], ["id", "n_tokens"])

    sized = docs.mapInArrow(run, "id bigint, n_tokens bigint")
    return sized.withColumnRenamed("id", id_col)
