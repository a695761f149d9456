"""Passages that occur more than once in a corpus: suffix arrays over shards of candidate text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm import suffix
from lumisift.llm import text as tx
from lumisift.llm.common import PIECE, Scratch, by_row

GRAM = 40  # bytes of an anchor
SHARD = 1 << 19  # bytes of text in one suffix array
HOT = 1_000  # different neighbourhoods of one anchor that are still kept together; those of others go by slices
SLICE = 16  # windows of a slice: the anchor's offset in them differs by less than this
_PLACE_BITS, _BLOCK = 24, 1 << 22  # places of one array that are numbered at a time
_BASE = 0xA24BAED4963EE407 | 1
_TABLE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)


class Grams:
    """Hashes of byte ranges of one piece of text."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_TABLE[data] * tx.powers(_BASE, self.n)[:self.n], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        inverse = tx.powers(pow(_BASE, -1, 1 << 64), self.n)
        return tx.mix((self.sums[stop] - self.sums[start]) * inverse[start])


def _least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash among each `width` neighbours, the first of equals.

    The hash's upper 40 bits decide, whatever the length of the text: the order must not
    depend on what a window is joined with.
    """
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least, have = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & low).astype(np.int64)


def anchors(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Cut the window starts of each text into runs that share an anchor.

    The anchor of a window is its first byte range of GRAM bytes with the least hash: it
    depends on the window's content alone, so equal windows anywhere have equal anchors
    at equal offsets. A run is (text, first start, number of further starts, offset of
    the anchor from the first start) with the hashes of the anchor and of all bytes
    from the first start to the end of the last window.
    """
    n = len(data)
    gram = min(GRAM, window)
    empty = np.zeros(0, np.int64)
    if n < window:
        return {"text": empty, "x": empty, "more": empty, "offset": empty, "anchor": empty, "content": empty}
    grams = Grams(data)
    h = grams.of(slice(0, n - gram + 1), slice(gram, n + 1))
    width = window - gram + 1
    where = np.concatenate([_least_places(h[a:a + _BLOCK + width - 1], width) + a for a in range(0, len(h) - width + 1, _BLOCK)])
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - window + 1, 0))
    counts = np.maximum(lengths - window + 1, 0)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[text]
    where = where[starts]
    new = np.append(True, (text[1:] != text[:-1]) | (where[1:] != where[:-1])) if len(text) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    if not len(head):
        return {"text": empty, "x": empty, "more": empty, "offset": empty, "anchor": empty, "content": empty}
    more = np.diff(np.append(head, len(text))) - 1
    at = starts[head]
    return {"text": text[head], "x": at - begins[text[head]], "more": more, "offset": where[head] - at,
            "anchor": h[where[head]].view(np.int64), "content": grams.of(at, at + more + window).view(np.int64)}


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with 255, which no UTF-8 text holds, after each; their begins and lengths."""
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
    return np.frombuffer(b"\xff".join(blobs) + b"\xff", np.uint8), np.cumsum(lengths + 1) - lengths - 1, lengths


def _runs(window: int):
    """(anchor, content, ka, kb, at): `at` packs first start, further starts and offset of the anchor."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        blobs = tx.blobs(batch.column("text"))
        ka, kb = (batch.column(c).to_numpy() for c in ("ka", "kb"))
        out = []
        for piece in tx.chunks([len(b) for b in blobs], PIECE):
            r = anchors(*_joined(blobs[piece]), window)
            if len(r["x"]):
                t = r["text"] + piece.start
                out.append((r["anchor"], r["content"], ka[t], kb[t], r["x"] << 24 | r["more"] << 12 | r["offset"]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                          ["anchor", "content", "ka", "kb", "at"])
    return fn


_WINDOWS = "anchor bigint, content bigint, first bigint, last bigint"
_PIECES = "anchor bigint, content bigint, weight bigint, bytes binary, part int, core bigint, own bigint, cut binary"
_NAMES = "anchor bigint, content bigint, weight bigint, part int, w1 bigint, w2 bigint"


def _key(raw: bytes, salt: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=salt.to_bytes(4, "little")).digest(), "little", signed=True)


def slices(raw: bytes, at: int, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(first window, key of the core, key of all bytes, bytes) of the slices that a run of windows is cut into.

    Windows whose offset of the anchor lies in the same SLICE are one slice. The core are
    the bytes that all windows of such a slice hold, whichever of them the run has: equal
    windows lie in slices of one number with equal cores.
    """
    x, more, offset = at >> 24, at >> 12 & 0xFFF, at & 0xFFF
    place, most, i = x + offset, window - min(GRAM, window), 0
    while i <= more:
        number = (offset - i) // SLICE
        least = number * SLICE
        last = min(more, offset - least)
        core = raw[place - least:place - min(least + SLICE - 1, most) + window]
        own = raw[x + i:x + last + window]
        yield i, _key(core, number), _key(own), own
        i = last + 1


def _neighbourhoods(window: int):
    """Bytes around each wanted anchor: (anchor, content, weight, bytes, part, core, own, cut).

    The neighbourhoods of a hot anchor are not sent as a whole but in slices, which begin at
    window `part`: `cut` are the bytes of a slice, `core` and `own` name those that its windows
    share and all of them.
    """
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("weight", pa.int64()), ("bytes", pa.binary()),
                        ("part", pa.int32()), ("core", pa.int64()), ("own", pa.int64()), ("cut", pa.binary())])

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                raw, rows = text.as_py().encode(), []
                for w in wanted.as_py():
                    name = (w["anchor"], w["content"], w["weight"])
                    if w["hot"]:
                        rows += [(*name, None, *part) for part in slices(raw, w["at"], window)]
                    else:
                        x, more = w["at"] >> 24, w["at"] >> 12 & 0xFFF
                        rows.append((*name, raw[x:x + more + window], None, None, None, None))
                    if len(rows) > 1 << 14:
                        yield sent(rows)
                        rows = []
                if rows:
                    yield sent(rows)
    return run


def _windows_of(window: int):
    """Windows of slices(core, own, weight, cut) by two hashes: (anchor, content, weight, part, w1, w2)."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = batch.column("cut").to_pylist()
        counts = np.array([len(raw) - window + 1 for raw in raws])
        codes = b"".join(hashlib.blake2b(raw[i:i + window], digest_size=16).digest() for raw, n in zip(raws, counts, strict=True) for i in range(n))
        codes = np.frombuffer(codes, np.int64).reshape(-1, 2)
        part = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        cols = [*(np.repeat(batch.column(c).to_numpy(), counts) for c in ("core", "own", "weight")), part.astype(np.int32),
                np.ascontiguousarray(codes[:, 0]), np.ascontiguousarray(codes[:, 1])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "content", "weight", "part", "w1", "w2"])
    return fn


def _joined_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(anchor, content, first, last) of the runs [first, last] in `runs` that overlap or follow each other, as one."""
    rows = []
    for anchor, content, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        first, last = np.array(sorted((r["first"], r["last"]) for r in runs)).T
        edge = np.flatnonzero(first[1:] > np.maximum.accumulate(last)[:-1] + 1)
        ends = np.maximum.accumulate(last)[np.append(edge, len(last) - 1)]
        rows += [(anchor, content, int(i), int(j)) for i, j in zip(first[np.append(0, edge + 1)], ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["anchor", "content", "first", "last"])


def _by_slices(parts: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(anchor, content, first, last) of the repeated windows of hot anchors, whose slices `parts` are; the tables it reads.

    Slices meet by core, and equal ones as one piece with a weight. Only where more than
    HOT different ones share a core are their windows counted one by one.
    """
    own = scratch.cut(parts.groupBy("core", "own").agg(F.sum("weight").alias("weight"), F.first("cut").alias("cut")), "slices")
    met = (own.groupBy("core").agg(F.sum("weight").alias("places"), F.count(F.lit(1)).alias("variants"))
           .filter("places > 1").select("core", (F.col("variants") > HOT).alias("hot")))
    shared = scratch.cut(own.join(met, "core"), "shared")
    scratch.drop(own)
    apart = _shards(shared.filter("NOT hot").select(F.col("core").alias("anchor"), F.col("own").alias("content"), "weight", F.col("cut").alias("bytes")), window)
    # Equal windows are summed in the tasks before they are sent.
    single = scratch.cut(by_row(shared.filter("hot"), _windows_of(window), _NAMES), "names")
    often = single.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).filter("n > 1").select("w1", "w2")
    one = single.join(often, ["w1", "w2"]).select("anchor", "content", F.col("part").cast("long").alias("first"), F.col("part").cast("long").alias("last"))
    found = _with_joined_runs(apart.unionByName(one)).withColumnsRenamed({"anchor": "core", "content": "own"})
    out = _with_joined_runs(parts.join(found, ["core", "own"]).select("anchor", "content", (F.col("part") + F.col("first")).alias("first"), (F.col("part") + F.col("last")).alias("last")))
    return out, [shared, single]


def _with_joined_runs(runs: DataFrame) -> DataFrame:
    return by_row(runs.groupBy("anchor", "content").agg(F.collect_list(F.struct("first", "last")).alias("runs")), _joined_runs, _WINDOWS)


def repeated_windows(pieces: list[bytes], weights: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first start, last start) of the maximal runs of windows that occur more than once.

    The pieces are joined, their suffixes sorted, and a window is repeated if it is a
    common prefix with a neighbour in that order, or if its piece stands for several
    places.
    """
    data, begins, lengths = _joined(pieces)
    sa = suffix.suffix_array(np.append(data.astype(np.uint16) + 1, 0).astype(np.uint16))[1:]
    limit = np.repeat(begins + lengths, lengths + 1)
    shared = suffix.common_prefixes(data, sa, limit) >= window
    # The suffix before one that shares a window with it has that window too.
    linked = np.flatnonzero(shared[sa])
    shared[sa[linked - 1]] = True
    owner = np.repeat(np.arange(len(pieces)), lengths + 1)
    at = np.arange(len(data))
    inside = at + window <= limit
    hit = inside & (shared | (weights > 1)[owner])
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return owner[first], first - begins[owner[first]], last - begins[owner[first]]


def _sorted_shards(window: int):
    """Suffix-sort rows (anchor, content, weight, bytes) that arrive ordered by anchor, whole anchors at a time.

    An anchor has at most HOT rows here, each with bytes of its own.
    """
    def settle(rows: list[tuple]) -> pa.RecordBatch:
        piece, first, last = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows]), window)
        out = [(*rows[p][:2], int(a), int(b)) for p, a, b in zip(piece, first, last, strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "content", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD and row[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield settle(rows)
    return run


def _shards(pieces: DataFrame, window: int) -> DataFrame:
    """Repeated windows of pieces(anchor, content, weight, bytes)."""
    return pieces.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(_sorted_shards(window), _WINDOWS)


def text_key() -> list:
    """Two hashes that name a text: equal texts share all they are found to hold."""
    return [F.xxhash64("text").alias("ka"), F.xxhash64(F.lit(1), "text").alias("kb")]


def repeated_passages(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(ka, kb, spans array<struct<first, last>>) for texts with windows that occur elsewhere.

    docs(text) is keyed by two hashes of the text. A span is a run of starts of
    `window`-byte strings that also start at another place of the corpus, the same
    document included; spans of a text may touch and repeat.

    Every window is dealt to its anchor, a byte range chosen by the window's content,
    so equal windows meet without any window being sent alone. Anchors found in one
    place only leave here. Neighbourhoods with equal bytes are one piece with a weight.
    The pieces are joined into shards of bounded size by anchor, a suffix array of each
    is built by induced sorting, and common prefixes tell the repeated windows. The
    neighbourhoods of anchors with more than HOT of them are cut into slices of some
    windows, which meet by the bytes that all windows of a slice hold.
    """
    found = by_row(docs.select(*text_key(), "text").filter(F.octet_length("text") >= window), _runs(window),
                   "anchor bigint, content bigint, ka bigint, kb bigint, at bigint")
    runs = scratch.cut(found, "runs")
    variants = runs.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("weight"))
    met = (variants.groupBy("anchor").agg(F.sum("weight").alias("places"), F.count(F.lit(1)).alias("variants"))
           .filter("places > 1").select("anchor", (F.col("variants") > HOT).alias("hot")))
    places = scratch.cut(runs.join(met, "anchor"), "places")
    scratch.drop(runs)
    first = F.min(F.struct("ka", "kb", "at")).alias("at")
    wanted = (places.groupBy("anchor", "content", "hot").agg(F.count(F.lit(1)).alias("weight"), first)
              .groupBy("at.ka", "at.kb").agg(F.collect_list(F.struct("anchor", "content", "hot", "weight", F.col("at.at").alias("at"))).alias("wanted")))
    # Copies of a text hold nothing new: one of them is read.
    texts = (docs.filter(F.octet_length("text") >= window).select(*text_key(), "text").groupBy("ka", "kb").agg(F.first("text").alias("text"))
             .join(wanted, ["ka", "kb"]).select("text", "wanted"))
    pieces = scratch.cut(texts.mapInArrow(_neighbourhoods(window), _PIECES), "pieces")
    whole = _shards(pieces.filter("bytes IS NOT NULL").select("anchor", "content", "weight", "bytes"), window)
    hot, read = _by_slices(pieces.filter("bytes IS NULL").select("anchor", "content", "weight", "part", "core", "own", "cut"), window, scratch)
    windows = scratch.cut(whole.unionByName(hot), "windows")
    scratch.drop(pieces, *read)
    x = F.shiftright("at", 24)
    spans = (places.join(windows, ["anchor", "content"])
             .select("ka", "kb", F.struct((x + F.col("first")).alias("first"), (x + F.col("last")).alias("last")).alias("span")).distinct()
             .groupBy("ka", "kb").agg(F.collect_list("span").alias("spans")))
    out = scratch.cut(spans, "spans")
    scratch.drop(places, windows)
    return out


def covered(spans: list[dict], window: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the windows."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + window))
        else:
            out.append((first, last + window))
    return out


def kept_parts(raw: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    parts, at = [], 0
    for begin, end in ranges:
        parts.append(raw[at:begin])
        at = end
    return [*parts, raw[at:]]


def _digest(window: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, raw, spans in zip(batch.column(0).to_pylist(), tx.blobs(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            ranges = covered(spans or [], window)
            rest = hashlib.sha256()
            for part in kept_parts(raw, ranges):
                rest.update(part)
            rows.append((doc, len(raw), sum(e - b for b, e in ranges), len(ranges), rest.hexdigest()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return fn


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) once repeated passages are cut out of the UTF-8 bytes.

    A byte goes if a `window`-byte string that also starts elsewhere covers it. Null
    and empty texts, and texts shorter than the window, lose nothing. A row that repeats
    another counts as another place, and so does one with a null id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    spans = repeated_passages(docs, window, Scratch(docs.sparkSession))
    both = docs.select("id", "text", *text_key()).join(spans, ["ka", "kb"], "left").select("id", "text", "spans")
    out = by_row(both, _digest(window), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _cut_out(window: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for raw, spans in zip(batch.column("_raw").cast(pa.binary()).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
            if spans:
                ranges = []
                for begin, end in covered(spans, window):
                    # A character goes only as a whole.
                    while begin < end and raw[begin] & 0xC0 == 0x80:
                        begin += 1
                    while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    ranges.append((begin, end))
                raw = b"".join(kept_parts(raw, ranges))
            texts.append(None if raw is None else raw.decode("utf-8", "replace"))
        names = [c for c in batch.schema.names if c not in ("_raw", "_spans")]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "_text"])
    return fn


def without_passages(docs: DataFrame, text_col: str = "text", window: int = 200) -> DataFrame:
    """`docs` with repeated passages cut out of the text column; characters cut in two stay whole.

    All rows and columns stay; a null text stays null.
    """
    spans = repeated_passages(docs.select(F.coalesce(text_col, F.lit("")).alias("text")), window, Scratch(docs.sparkSession))
    # Own names for all columns, so none can clash with those added here.
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    raw = f"c{names.index(text_col)}"
    keyed = plain.withColumnRenamed(raw, "_raw").withColumn("text", F.coalesce("_raw", F.lit("")))
    keyed = keyed.select("*", *text_key()).drop("text").join(spans.withColumnRenamed("spans", "_spans"), ["ka", "kb"], "left").drop("ka", "kb")
    fields = ", ".join([f"{c} {t}" for c, t in plain.dtypes if c != raw] + ["_text string"])
    out = by_row(keyed, _cut_out(window), fields).withColumnRenamed("_text", raw)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
