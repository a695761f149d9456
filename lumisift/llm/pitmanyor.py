"""Word model of hierarchical Pitman-Yor restaurants, trained and scored block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.llm import text as tx
from lumisift.llm.common import Scratch
from lumisift.session import fresh_dir

BLOCK_BYTES = 4 << 20  # text in one block
PART_ENTRIES = 1_500_000  # entries of all blocks that meet in one group
HEAVY = 20_000_000  # training tokens after one word; its restaurant is sampled in parts of about this many
SMALL = 48  # customers of a dish up to which the number of tables is drawn from its exact distribution
END = np.uint64(0xE4D0F7E47AB1E5)  # the end of a text; also the context of its first word


@dataclass(frozen=True)
class Restaurant:
    """Discount and strength of one level."""
    discount: float
    strength: float


WORDS, PAIRS = Restaurant(0.65, 10.0), Restaurant(0.75, 5.0)
_SCHEMA = "block bigint, part bigint, kind int, a binary, b binary, c binary, n bigint, v bigint"
_NAMES = ["block", "part", "kind", "a", "b", "c", "n", "v"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
CODED, WORD_BACK, PAIR_OUT, PAIR_BACK, PARENT_OUT, PARENT_BACK, HASHES = range(7)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def _least(a: np.ndarray) -> bytes:
    """Non-negative whole numbers, packed: their width, and their lowest bytes, next bytes and so on, compressed."""
    top = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 3, 4, 5, 8) if top < 1 << (8 * w))
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _wide(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<i8")[:, 0]


# ---- blocks ------------------------------------------------------------------

def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows per block. Its texts: a = tokens as places in the list of words, c = ids, flags, lengths, part = place of the
    end, v = number of words. The list: a = hashes in order, b = learnt tokens of each, read until the words are numbered.
    """
    serial = 0

    def block(rows: list[tuple]) -> pa.RecordBatch:
        nonlocal serial
        words = tx.Words([r[2] for r in rows], tx.SPACE)
        lengths = words.counts + 1
        tokens = np.full(lengths.sum(), END)
        ends = np.cumsum(lengths) - 1
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = words.hash
        hashes, codes = np.unique(np.append(tokens, END), return_inverse=True)
        table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "held": pa.array([r[1] for r in rows], pa.bool_()),
                          "length": pa.array(lengths, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        number = TaskContext.get().partitionId() << 32 | serial
        serial += 1
        place = int(np.searchsorted(hashes, END))
        codes = codes[:-1]
        learnt = np.repeat(~np.array([r[1] for r in rows], bool), lengths)
        counts = np.bincount(codes[learnt], minlength=len(hashes))
        return _rows([(number, place, CODED, _least(codes), None, sink.getvalue().to_pybytes(), len(tokens), len(hashes)),
                      (number, None, HASHES, hashes.tobytes(), _least(counts), None, None, None)])

    rows, size = [], 0
    for batch in batches:
        for row in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), tx.blobs(batch.column("text")), strict=True):
            if rows and size + len(row[2]) > BLOCK_BYTES:
                yield block(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[2]) + 8
    if rows:
        yield block(rows)


class Block:
    """A coded block: its tokens, which of them are learnt from, and the word before each."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.words = row["v"]
        self.codes = _wide(row["a"])
        with pa.ipc.open_stream(row["c"]) as reader:
            table = reader.read_all()
        self.ids, self.held = table.column("id"), table.column("held").to_numpy()
        self.lengths = table.column("length").to_numpy()
        self.first = np.cumsum(self.lengths) - self.lengths
        self.learnt = np.repeat(~self.held, self.lengths)
        self.before = np.append(row["part"], self.codes[:-1])
        self.before[self.first] = row["part"]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, word, learnt tokens) of the distinct pairs, by context, and the place of each token's pair."""
        n = self.words
        keys, where = np.unique(self.before * n + self.codes, return_inverse=True)
        counts = np.bincount(where, weights=self.learnt, minlength=len(keys)).astype(np.int64)
        return keys // n, keys % n, counts, where


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts by the high bits, so that sorted hashes fall into runs."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _runs(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    edge = np.flatnonzero(np.diff(parts, prepend=-1))
    for a, b in zip(edge, np.append(edge[1:], len(parts)), strict=True):
        yield int(parts[a]), slice(int(a), int(b))


# ---- words -------------------------------------------------------------------

def _words_out(parts: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = np.frombuffer(row["a"], np.uint64), _wide(row["b"])
                yield _rows([(row["block"], p, HASHES, hashes[s].tobytes(), _least(counts[s]), None, None, None)
                             for p, s in _runs(_part_of(hashes, parts))])
    return fn


def _words_met(parts: int):
    """Number the words of a part and count them; a = numbers, b = counts, in the order of each block's words."""
    def fn(group: pa.Table) -> pa.Table:
        rows = group.select(["block", "part", "a", "b"]).to_pylist()
        hashes = [np.frombuffer(r["a"], np.uint64) for r in rows]
        words, where = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([_wide(r["b"]) for r in rows]), minlength=len(words)).astype(np.int64)
        out, at, part = [], 0, rows[0]["part"]
        for r, h in zip(rows, hashes, strict=True):
            mine = where[at:at + len(h)]
            at += len(h)
            out.append((r["block"], part, WORD_BACK, _least(mine * parts + part), _least(counts[mine]), None, None, None))
        # The part's own row: its tokens and its words that are learnt.
        out.append((None, part, WORD_BACK, None, None, None, int(counts.sum()), int((counts > 0).sum())))
        return pa.Table.from_batches([_rows(out)])
    return fn


def _gather(rows: list[dict], kind: int) -> list[dict]:
    return sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])


# ---- pairs -------------------------------------------------------------------

def _heavy_slices(counts: np.ndarray, heavy: int) -> np.ndarray:
    return 1 + counts // heavy


def _deal(block: Block, numbers: np.ndarray, counts: np.ndarray, parts: int, heavy: int):
    """Pairs of a block in the order in which they are dealt out, with the part of each.

    A context goes to one part, whatever block it is in; a context of very many tokens
    to several, by its words.
    """
    context, word, learnt, where = block.pairs()
    slices = _heavy_slices(counts, heavy)[context]
    code = tx.mix(numbers[context].astype(np.uint64)) + tx.mix(numbers[word].astype(np.uint64)) % slices.astype(np.uint64)
    part = _part_of(tx.mix(code), parts)
    order = np.lexsort((word, context, part))
    return context, word, learnt, where, part, order


def _known(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(number, count) of the block's words, from the parts' answers in order."""
    back = _gather(rows, WORD_BACK)
    return np.concatenate([_wide(r["a"]) for r in back]), np.concatenate([_wide(r["b"]) for r in back])


def _pairs_out(parts: int, heavy: int, total: int):
    """a = numbers and lengths of the contexts, b = numbers of the words, c = learnt tokens and shares of the words."""
    def fn(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        block = Block(next(r for r in rows if r["kind"] == CODED))
        numbers, counts = _known(rows)
        context, word, learnt, _, part, order = _deal(block, numbers, counts, parts, heavy)
        # The share of a word in all tokens to an eighth of an octave is close enough for seating.
        share = np.rint(-8 * np.log2((counts + 0.5) / (total + 1))).astype(np.int64)
        out = []
        for p, s in _runs(part[order]):
            at = order[s]
            u, w = context[at], word[at]
            head = np.flatnonzero(np.diff(u, prepend=-1))
            a = _pack(numbers[u[head]], np.diff(np.append(head, len(u))), _heavy_slices(counts, heavy)[u[head]])
            out.append((block.number, p, PAIR_OUT, a, _least(numbers[w]), _pack(learnt[at], share[w]), None, None))
        return pa.Table.from_batches([_rows(out)])
    return fn


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [_least(a) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        out.append(_wide(data[at + 8:at + 8 + size]))
        at += 8 + size
    return out


# ---- seating -----------------------------------------------------------------

def stirling(discount: float, most: int) -> np.ndarray:
    """log of generalised Stirling numbers [c, t]: ways to seat c customers at t tables, weighed by table sizes."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        out[c + 1, 1:c + 2] = np.logaddexp(out[c, :c + 1], np.log(np.maximum(c - discount * np.arange(1, c + 2), 1e-300)) + out[c, 1:c + 2])
    return out


def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, level: Restaurant, rng: np.random.Generator,
         table: np.ndarray) -> np.ndarray:
    """Draw the number of tables of each dish in its restaurant, given all other tables there.

    For a dish of c customers t tables have probability proportional to S(c, t) base^t
    prod_{i<t} (strength + discount (others + i)): all seatings of its customers are
    summed in S. Beyond SMALL customers they are seated one run after the other, each
    run a small share of those who already sit, by the same chances.
    """
    tables = np.minimum(customers, 1)
    small = np.flatnonzero((customers > 1) & (customers <= SMALL))
    small = small[np.argsort(customers[small], kind="stable")]
    for c in np.unique(customers[small]):
        every = small[np.searchsorted(customers[small], c):np.searchsorted(customers[small], c, side="right")]
        for at in np.array_split(every, max(1, len(every) * int(c) // 2_000_000)):
            t = np.arange(c)
            open_ = np.log(level.strength + level.discount * (others[at][:, None] + t)) + np.log(base[at])[:, None]
            score = table[c, 1:c + 1] + np.cumsum(open_, axis=1)
            score -= score.max(axis=1, keepdims=True)
            sums = np.cumsum(np.exp(score), axis=1)
            tables[at] = 1 + (rng.random(len(at))[:, None] * sums[:, -1:] > sums).sum(axis=1)
    large = np.flatnonzero(customers > SMALL)
    seated, t = np.ones(len(large), np.int64), np.ones(len(large), np.int64)
    while len(large):
        run = np.minimum(np.maximum(seated // 8, 1), customers[large] - seated)
        new = (level.strength + level.discount * (others[large] + t)) * base[large]
        t += rng.binomial(run, new / (new + seated - level.discount * t))
        seated += run
        done = seated == customers[large]
        tables[large[done]] = t[done]
        large, seated, t = large[~done], seated[~done], t[~done]
    return tables


def sample_tables(customers: np.ndarray, group: np.ndarray, scale: np.ndarray, base: np.ndarray, level: Restaurant,
                  sweeps: int, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gibbs over the tables of all dishes: (tables per dish, tables per restaurant) of each kept sample.

    group: restaurant of each dish; scale: parts a restaurant is split into, whose other
    parts are taken to have as many tables. Every sweep draws half of the dishes given
    the other half, then the other way round.
    """
    rng = np.random.default_rng(seed)
    logs = stirling(level.discount, SMALL)
    n = len(scale)
    tables = np.minimum(customers, 1)
    half = rng.random(len(customers)) < 0.5
    moving = [np.flatnonzero(m & (customers > 1)) for m in (half, ~half)]
    kept, totals = [], []
    for sweep in range(sweeps + samples):
        for at in moving:
            sums = np.bincount(group, weights=tables, minlength=n) * scale
            tables[at] = seat(customers[at], np.maximum(sums[group[at]] - tables[at], 0), base[at], level, rng, logs)
        if sweep >= sweeps:
            kept.append(tables.copy())
            totals.append(np.bincount(group, weights=tables, minlength=n).astype(np.int64))
    return np.array(kept), np.array(totals)


def _pairs_met(level: Restaurant, sweeps: int, samples: int, seed: int, word_parts: int):
    """Seat the customers of a part's restaurants.

    To each block: a = customers of its pairs, b = their tables per sample, c = tables
    of its contexts per sample. To the words' parts: a = words, b = tables per sample.
    """
    def fn(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["block", "part", "a", "b", "c"]).to_pylist(), key=lambda r: r["block"])
        part = rows[0]["part"]
        contexts = [_unpack(r["a"]) for r in rows]
        words = [_wide(r["b"]) for r in rows]
        counts, shares = zip(*(_unpack(r["c"]) for r in rows), strict=True)
        u_all, u_where = np.unique(np.concatenate([c[0] for c in contexts]), return_inverse=True)
        slices = np.ones(len(u_all), np.int64)
        slices[u_where] = np.concatenate([c[2] for c in contexts])
        w_all, w_where = np.unique(np.concatenate(words), return_inverse=True)
        owner = np.repeat(u_where, np.concatenate([c[1] for c in contexts]))
        keys, where = np.unique(owner * len(w_all) + w_where, return_inverse=True)
        customers = np.bincount(where, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
        share = np.zeros(len(keys))
        share[where] = np.concatenate(shares)
        tables, totals = sample_tables(customers, keys // len(w_all), slices, np.exp2(-share / 8), level, sweeps, samples, seed + part)
        out, at, cat = [], 0, 0
        for r, c, w in zip(rows, contexts, words, strict=True):
            mine, own = where[at:at + len(w)], u_where[cat:cat + len(c[0])]
            at, cat = at + len(w), cat + len(c[0])
            out.append((r["block"], part, PAIR_BACK, _least(customers[mine]), _pack(*tables[:, mine]), _pack(*totals[:, own]), None, None))
        # Each table is a customer of the word's own restaurant.
        sent = np.array([np.bincount(keys % len(w_all), weights=t, minlength=len(w_all)) for t in tables]).astype(np.int64)
        home = w_all % word_parts
        order = np.argsort(home, kind="stable")
        out += [(None, p, PARENT_OUT, _least(w_all[order[s]]), _pack(*sent[:, order[s]]), None, None, None) for p, s in _runs(home[order])]
        # Contexts in several parts: their tables are added up over parts later.
        split = np.flatnonzero(slices > 1)
        if len(split):
            out.append((None, -1, PARENT_OUT, _least(u_all[split]), _pack(*totals[:, split]), None, None, None))
        return pa.Table.from_batches([_rows(out)])
    return fn


# ---- the parent --------------------------------------------------------------

def _parents_met(level: Restaurant, parts: int, sweeps: int, samples: int, seed: int, types: int):
    """Seat the words of a part in their common restaurant.

    To each block: a = customers of its words per sample, b = their tables. The part's
    own row: a = customers per sample, b = tables per sample.
    """
    def fn(group: pa.Table) -> pa.Table:
        rows = group.select(["block", "part", "kind", "a", "b"]).to_pylist()
        part = rows[0]["part"]
        sent = [r for r in rows if r["kind"] == PARENT_OUT]
        asked = sorted((r for r in rows if r["kind"] == WORD_BACK), key=lambda r: r["block"])
        wanted = [_wide(r["a"]) for r in asked]
        words = np.unique(np.concatenate([*[_wide(r["a"]) for r in sent], *wanted]))
        customers = np.zeros((samples, len(words)), np.int64)
        for r in sent:
            at = np.searchsorted(words, _wide(r["a"]))
            for m, t in enumerate(_unpack(r["b"])):
                customers[m, at] += t
        # One restaurant for all words; other parts, equally large by the hash, are taken to be alike.
        tables = np.array([sample_tables(customers[m], np.zeros(len(words), np.int64), np.array([parts]), np.full(len(words), 1 / (types + 1)),
                                         level, sweeps, 1, seed + part * samples + m)[0][0] for m in range(samples)])
        out = []
        for r, w in zip(asked, wanted, strict=True):
            at = np.searchsorted(words, w)
            out.append((r["block"], part, PARENT_BACK, _pack(*customers[:, at]), _pack(*tables[:, at]), None, None, None))
        out += [(None, part, PARENT_BACK, None, None, None, int(customers[m].sum()) << 8 | m, int(tables[m].sum())) for m in range(samples)]
        return pa.Table.from_batches([_rows(out)])
    return fn


def _scored(pair_parts: int, heavy: int, pairs: Restaurant, words: Restaurant, samples: int, n_train: int, types: int,
            totals: list[tuple[int, int]], split: dict[int, list[int]]):
    """Base and model log10 probabilities of a block's texts."""
    def fn(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        block = Block(next(r for r in rows if r["kind"] == CODED))
        numbers, counts = _known(rows)
        back = _gather(rows, PARENT_BACK)
        customers = [np.concatenate(x) for x in zip(*(_unpack(r["a"]) for r in back), strict=True)]
        tables = [np.concatenate(x) for x in zip(*(_unpack(r["b"]) for r in back), strict=True)]
        context, word, _, where, part, order = _deal(block, numbers, counts, pair_parts, heavy)
        met = _gather(rows, PAIR_BACK)
        seated = np.concatenate([_wide(r["a"]) for r in met])
        at_tables = [np.concatenate(x) for x in zip(*(_unpack(r["b"]) for r in met), strict=True)]
        of_context = [np.concatenate(x) for x in zip(*(_unpack(r["c"]) for r in met), strict=True)]
        u, p = context[order], part[order]
        run = np.cumsum(np.append(True, (u[1:] != u[:-1]) | (p[1:] != p[:-1]))) - 1
        chance = np.zeros(len(order))
        many = counts[u] // heavy > 0
        for m in range(samples):
            all_tables = of_context[m][run]
            if many.any():
                all_tables = all_tables.copy()
                all_tables[many] = [split[x][m] for x in numbers[u[many]].tolist()]
            root_customers, root_tables = totals[m]
            below = (np.maximum(customers[m] - words.discount * tables[m], 0)
                     + (words.strength + words.discount * root_tables) / (types + 1)) / (words.strength + root_customers)
            chance += (np.maximum(seated - pairs.discount * at_tables[m], 0)
                       + (pairs.strength + pairs.discount * all_tables) * below[word[order]]) / (pairs.strength + counts[u])
        by_pair = np.zeros(len(order))
        by_pair[order] = np.log10(chance / samples)
        base = np.log10((counts + 0.1) / (n_train + 0.1 * (types + 1)))[block.codes]
        n = len(block.lengths)
        owner = np.repeat(np.arange(n), block.lengths)
        known = np.bincount(owner, weights=counts[block.codes] > 0, minlength=n).astype(np.int64)
        return pa.table([block.ids, pa.array(block.held), pa.array(block.lengths), pa.array(known), pa.array(np.full(n, n_train, np.int64)),
                         pa.array(np.bincount(owner, weights=base, minlength=n)), pa.array(np.bincount(owner, weights=by_pair[where], minlength=n))],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return fn


def held_out(id_col: str) -> Column:
    """Texts not learnt from: crc32 of the id as text leaves no remainder by 10. A null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def _by_kind(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[int], None]]:
    """`df` as a table with a folder for each kind of rows, and a way to delete a kind that is done with."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, label)
    df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()

    def drop(kind: int) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return spark.read.schema(df.schema).parquet(path).select(*_NAMES), drop


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs: Restaurant = PAIRS, words: Restaurant = WORDS,
                sweeps: int = 2, samples: int = 3, seed: int = 11, part_entries: int = PART_ENTRIES, heavy: int = HEAVY) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every text.

    A text is its lower-cased words and one end. Every word is a restaurant whose
    customers are the words learnt to follow it; all of these restaurants share one
    parent, that of single words, whose base is even over the words learnt and one for
    all others. A table in a restaurant is a customer of the parent. Seatings are sampled
    by Gibbs: first of the context restaurants given the words' shares of all tokens,
    then, for each kept sample, of the parent given its customers. `score` sums the log10
    of predictive probabilities averaged over the samples, perplexity is 10^(-score /
    n_tokens), and base_score is that of single words with 0.1 added to each count.

    Texts are coded once into blocks that list each of their words and pairs once.
    Blocks send these lists to parts (words by hash, pairs by context), which count, seat
    and answer in the order of the lists; so common words and pairs move once per block.
    What one group holds is bounded by `part_entries`, as the number of parts follows
    the lists; the restaurant of a word with more than `heavy` tokens is sampled in
    slices that each take the others to be alike.

    A null or empty text is an end alone. Rows that repeat others are learnt and scored
    like any. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"), F.col(text_col).alias("text"))
    written, drop_written = _by_kind(source.mapInArrow(_code, _SCHEMA), "coded")
    coded = written.filter(F.col("kind") == CODED)
    tokens, listed = coded.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    word_parts, pair_parts = 1 + listed // part_entries, 1 + tokens // part_entries

    sent = written.filter(F.col("kind") == HASHES).select(*_NAMES).mapInArrow(_words_out(word_parts), _SCHEMA)
    answered = scratch.cut(sent.groupBy("part").applyInArrow(_words_met(word_parts), _SCHEMA), "words")
    n_train, types = answered.filter("block IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    asked = answered.filter("block IS NOT NULL")

    drop_written(HASHES)
    sent = coded.unionByName(asked).groupBy("block").applyInArrow(_pairs_out(pair_parts, heavy, n_train), _SCHEMA)
    met = sent.groupBy("part").applyInArrow(_pairs_met(pairs, sweeps, samples, seed, word_parts), _SCHEMA)
    seated, drop_seated = _by_kind(met, "pairs")
    # Words of more than `heavy` tokens: at most tokens / heavy of them.
    split: dict[int, list[int]] = {}
    if tokens > heavy:
        for r in seated.filter(F.col("kind") == PARENT_OUT).filter("part = -1").toLocalIterator():
            for word, *tables in zip(_wide(r.a).tolist(), *(x.tolist() for x in _unpack(r.b)), strict=True):
                split[word] = [s + t for s, t in zip(split.get(word, [0] * samples), tables, strict=True)]

    sent = seated.filter(F.col("kind") == PARENT_OUT).filter("part >= 0").unionByName(asked)
    parents = scratch.cut(sent.groupBy("part").applyInArrow(_parents_met(words, word_parts, sweeps, samples, seed, types), _SCHEMA), "parents")
    drop_seated(PARENT_OUT)
    sums = {r.m: (r.c, r.t) for r in parents.filter("block IS NULL").groupBy(F.expr("n & 255").alias("m"))
            .agg(F.sum(F.shiftright("n", 8)).alias("c"), F.sum("v").alias("t")).collect()}
    totals = [sums.get(m, (0, 0)) for m in range(samples)]

    everything = (coded.unionByName(asked).unionByName(seated.filter(F.col("kind") == PAIR_BACK))
                  .unionByName(parents.filter("block IS NOT NULL")))
    out = everything.groupBy("block").applyInArrow(
        _scored(pair_parts, heavy, pairs, words, samples, n_train, types, totals, split),
        "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("id", id_col)
