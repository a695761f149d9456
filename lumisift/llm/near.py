"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm import text as tx
from lumisift.llm.common import PIECE, Scratch, by_row, few
from lumisift.operators.groups import duplicate_groups

BANDS, ROWS = 80, 8  # a pair at similarity 0.8 shares no band once in 2.4 million pairs
BINS = BANDS * ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
# Of 200 coordinates a pair at 0.8 agrees in 160 +- 5.7; below 116 is eight deviations away.
SIGNED, MIN_AGREE = 200, 116
TURNS = 1  # further pivots that the odd members of crowded buckets meet before they meet all members
# Pairs of a bucket beyond which its members are compared inside tasks, in blocks of about so many shingles and rows.
CROWDED, BLOCK_SHINGLES, BLOCK_ROWS = 500, 1 << 19, 1_000


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word shingles of each text, sorted."""
    text, h = tx.windows(tx.Words(texts, tx.SPACE), size)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if len(h):
        keep = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))
        text, h = text[keep], h[keep]
    return text, h


def sketch(text: np.ndarray, h: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch (Dahlgaard, Knudsen, Thorup 2017) of `n` sets; empty sets stay unfilled.

    In round i < bins every element is thrown into a hashed bin with the value
    i + fraction, and a bin keeps its least value. Round bins + j throws all elements
    into bin j, so every coordinate of a set that is not empty is filled in the end. A
    set leaves after the first round that fills its last bin, which for a set of bins x
    log(bins) elements is one of the first few.
    """
    out = np.full(n * bins, _EMPTY)
    for i in range(2 * bins):
        if not len(h):
            break
        hashed = tx.mix(h + np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF))
        if i < bins:
            slot = ((hashed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            slot = i - bins
        value = (np.uint64(i) << np.uint64(52)) | (tx.mix(hashed) >> np.uint64(12))
        np.minimum.at(out, text * bins + slot, value)
        full = (out.reshape(n, bins) != _EMPTY).all(axis=1)
        rest = ~full[text]
        text, h = text[rest], h[rest]
    return out.reshape(n, bins)


def _fold(parts: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hash the last axis."""
    out = np.broadcast_to(seed, parts.shape[:-1]).astype(np.uint64)
    for k in range(parts.shape[-1]):
        out = tx.mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[..., k])
    return out


def _sketched(size: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = tx.blobs(batch.column(1))
        parts = []
        for piece in tx.chunks([len(b) for b in blobs], PIECE):
            n = piece.stop - piece.start
            text, h = shingle_sets(blobs[piece], size)
            count = np.bincount(text, minlength=n)
            # Two sums over independent hashes tell sets apart, whatever the order.
            sums = []
            for seed in (1, 2):
                total = np.zeros(n, np.uint64)
                np.add.at(total, text, tx.mix(h ^ np.uint64(seed * 0x5851F42D4C957F2D)))
                sums.append(total.view(np.int64))
            coords = sketch(text, h, n)
            keys = _fold(coords.reshape(n, BANDS, ROWS), np.arange(BANDS, dtype=np.uint64))
            parts.append((count, *sums, keys.view(np.int64), tx.mix(coords[:, :SIGNED]).astype(np.uint8)))
        count, a, b, keys, sig = (np.concatenate(p) for p in zip(*parts, strict=True))
        n = len(count)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
        raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * SIGNED).astype(np.int32).tobytes()),
                                                     pa.py_buffer(sig.tobytes())])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(a), pa.array(b), bands, raw],
                                          ["id", "n", "class_a", "class_b", "bands", "sig"])
    return fn


def _sets(size: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = tx.blobs(batch.column(1))
        counts, hashes = [], []
        for piece in tx.chunks([len(b) for b in blobs], PIECE):
            text, h = shingle_sets(blobs[piece], size)
            counts.append(np.bincount(text, minlength=piece.stop - piece.start))
            hashes.append(h.view(np.int64))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hashes)))], ["id", "s"])
    return fn


def _agreeing(batch: pa.RecordBatch) -> pa.RecordBatch:
    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNED) for c in ("sig_a", "sig_b"))
    near = pa.array((a == b).sum(axis=1) >= MIN_AGREE)
    return pa.RecordBatch.from_arrays([batch.column("ia").filter(near), batch.column("ib").filter(near)], ["ia", "ib"])


def _met_in_blocks(percent: int):
    """Links between a block of odd members and a block of members, exact, as many as join what was apart.

    Every shingle lists the members that have it; an odd member's shingles add up what it
    shares with each. Links within a component, and further links between two that have
    been joined here, are left out, so at most one row per member leaves the task.
    """
    def fn(t: pa.Table) -> pa.Table:
        odd = t["odd"].to_numpy(zero_copy_only=False)
        ids, comps = t["id"].to_numpy(), t["comp"].to_numpy()
        sets = t["s"].combine_chunks()
        sizes, flat = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), sets.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(ids)), sizes)
        here = ~odd[of]
        order = np.argsort(flat[here], kind="stable")
        shingles, members = flat[here][order], of[here][order]
        root = {int(c): int(c) for c in comps}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(odd):
            own = flat[ends[i] - sizes[i]:ends[i]]
            low, high = np.searchsorted(shingles, own), np.searchsorted(shingles, own, "right")
            width = high - low
            at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
            common = np.bincount(members[at], minlength=len(ids))
            for j in np.flatnonzero(common * (100 + percent) >= (sizes + sizes[i]) * percent):
                if not odd[j]:
                    a, b = find(int(comps[i])), find(int(comps[j]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        cols = list(zip(*out, strict=True)) or [(), ()]
        return pa.table({"id_a": pa.array(cols[0], pa.int64()), "id_b": pa.array(cols[1], pa.int64())})
    return fn


def _crowd_links(scratch: Scratch, crowded: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that members of crowded buckets still lack: crowded(key, id, comp, main, n).

    Buckets that share members are one crowd, so a member's set moves once per block and
    not once per bucket. Each block of odd members meets each block of all members in a
    task of its own; both are bounded in rows and shingles.
    """
    edges = crowded.groupBy("key").agg(F.min("id").alias("id_a")).join(crowded.select("key", F.col("id").alias("id_b")), "key").select("id_a", "id_b").distinct()
    crowds = scratch.cut(_components(edges), "crowds")
    members = crowded.groupBy("id", "comp", "n").agg(F.max(F.col("comp") != F.col("main")).alias("odd"))
    members = scratch.cut(members.join(crowds, "id").withColumnRenamed("group_id", "crowd"), "members")
    blocks = members.groupBy("crowd").agg(
        *[F.ceil(F.greatest(F.count_if(kind) / F.lit(BLOCK_ROWS), F.sum(F.when(kind, F.col("n")).otherwise(0)) / F.lit(BLOCK_SHINGLES))).cast("int").alias(name)
          for kind, name in ((F.col("odd"), "odd_blocks"), (F.lit(True), "all_blocks"))])
    needed = few(scratch.cut(members.select("id").distinct(), "needed"))
    sets = by_row(docs.join(needed, "id", "left_semi"), _sets(size), "id bigint, s array<bigint>").dropDuplicates(["id", "s"])
    rows = scratch.cut(members.join(blocks, "crowd").join(sets, "id"), "crowd-sets")
    spread = F.xxhash64("id")
    odd = rows.filter("odd").select("crowd", F.pmod(spread, "odd_blocks").alias("x"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("y"), "id", "comp", "s", "odd")
    all_rows = rows.filter("odd_blocks > 0").select("crowd", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("x"), F.pmod(spread, "all_blocks").alias("y"), "id", "comp", "s",
                                                    F.lit(False).alias("odd"))
    pairs = odd.select(*all_rows.columns).withColumns({"x": F.col("x").cast("long"), "y": F.col("y").cast("long")})
    pairs = pairs.unionByName(all_rows.withColumns({"x": F.col("x").cast("long"), "y": F.col("y").cast("long")}))
    return scratch.cut(pairs.groupBy("crowd", "x", "y").applyInArrow(_met_in_blocks(percent), "id_a bigint, id_b bigint").distinct(), "crowd-links")


def _verified(scratch: Scratch, pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (ia, ib), a written table, whose full shingle sets have 100 * |a & b| >= percent * |a | b|."""
    if pairs.isEmpty():
        return pairs.select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"))
    sig = reps.select("id", "sig")
    both = (pairs.join(sig.withColumnsRenamed({"id": "ia", "sig": "sig_a"}), "ia")
            .join(sig.withColumnsRenamed({"id": "ib", "sig": "sig_b"}), "ib"))
    near = scratch.cut(by_row(both, _agreeing, "ia bigint, ib bigint").distinct(), "near")
    needed = near.select(F.col("ia").alias("id")).unionByName(near.select(F.col("ib").alias("id"))).distinct()
    needed = few(scratch.cut(needed, "needed"))
    sets = scratch.cut(by_row(docs.join(needed, "id", "left_semi"), _sets(size), "id bigint, s array<bigint>"), "sets")
    a = sets.withColumnsRenamed({"id": "ia", "s": "sa"})
    b = sets.withColumnsRenamed({"id": "ib", "s": "sb"})
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    found = (near.join(a, "ia").join(b, "ib")
             .withColumns({"_i": common, "_n": F.size("sa") + F.size("sb")})
             .filter(F.col("_i") * (100 + percent) >= F.col("_n") * percent)
             .select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b")).distinct())
    links = scratch.cut(found, "links")
    scratch.drop(near, sets)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): groups of documents with similar word shingles.

    Two documents are linked if 100 * |a & b| >= percent * |a | b| over their sets of
    distinct shingles of lower-cased words; component_id is the lowest id reachable
    over links and `kept` marks the document with that id.

    Documents with equal sets are one class, represented by its lowest id; only
    representatives are sketched into bands and compared. Each bucket of a band first
    compares its members with one of them (its pivot), unless other buckets have joined
    them already, which makes components of most of them; in crowded buckets members outside the largest component then meet one
    more of its members, and at last all members of other components: as pairs, or, in
    buckets that are still crowded, inside tasks that each hold a block of either side
    and give back the links alone. So a bucket of k copies costs k comparisons, yet every
    pair in a bucket is either compared or already connected. Candidate pairs whose
    sketches disagree far beyond chance are dropped, all others are verified on their
    full sets.

    A document without words has n_shingles 0 and is linked with nothing, as is one
    whose id is null (component_id null, kept true). Rows that repeat an id are one
    document. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = scratch.cut(by_row(docs, _sketched(shingle),
                                  "id bigint, n bigint, class_a bigint, class_b bigint, bands array<bigint>, sig binary"), "sketches")
    with_id = sketches.filter("n > 0 AND id IS NOT NULL")
    first = with_id.groupBy("class_a", "class_b").agg(F.min("id").alias("rep"))
    classed = scratch.cut(sketches.select("id", "n", "class_a", "class_b").join(first, ["class_a", "class_b"], "left")
                          .select("id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), "classed")
    lone = classed.filter("id <> rep").select("id").distinct().join(classed.filter("id = rep").select("id"), "id", "left_anti")
    copies = few(scratch.cut(lone, "copies"))
    reps = scratch.cut(with_id.select("id", "sig").join(copies, "id", "left_anti"), "reps")

    rows = with_id.join(copies, "id", "left_anti").select("id", F.explode("bands").alias("key"))
    pivots = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last")
    shared = scratch.cut(rows.join(pivots.select("key", "pivot"), "key"), "shared")
    # A quarter of the buckets joins most of what belongs together; the others compare only what is still apart.
    to_pivot = shared.filter("id <> pivot").select(F.col("pivot").alias("ia"), F.col("id").alias("ib"), "key")
    tested = scratch.cut(to_pivot.filter("key & 3 = 0").select("ia", "ib").distinct(), "star")
    links = _verified(scratch, tested, reps, docs, shingle, percent)
    groups = _components(links)
    apart = (to_pivot.select("ia", "ib").distinct().join(groups.withColumnsRenamed({"id": "ia", "group_id": "ga"}), "ia", "left")
             .join(groups.withColumnsRenamed({"id": "ib", "group_id": "gb"}), "ib", "left")
             .filter(F.coalesce("ga", "ia") != F.coalesce("gb", "ib")).select("ia", "ib").join(tested, ["ia", "ib"], "left_anti"))
    apart = scratch.cut(apart, "apart")
    links = links.unionByName(_verified(scratch, apart, reps, docs, shingle, percent))
    tested = tested.unionByName(apart)
    groups = _components(links)

    sizes = classed.filter("id = rep").groupBy("id").agg(F.max("n").alias("n"))
    near_size = F.least("n", "nx") * 100 >= F.greatest("n", "nx") * percent
    for turn in range(TURNS + 1):
        # Buckets that are not yet one component, and their odd members: those outside the largest.
        placed = shared.join(groups, "id", "left").withColumn("comp", F.coalesce("group_id", "id")).select("key", "id", "comp")
        per_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
        split = (per_comp.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
                 .filter("comps > 1").select("key", "main"))
        open_rows = scratch.cut(placed.join(split, "key").join(sizes, "id"), "open")
        odd = open_rows.filter("comp <> main").select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"))
        load = open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("comp") != F.col("main")).alias("odd"))
        load = scratch.cut(load.select("key", (F.col("all") * F.col("odd")).alias("pairs"), "all"), "load")
        rows, pairs = load.agg(F.sum("all"), F.sum("pairs")).first()
        if turn == TURNS or (pairs or 0) <= 4 * (rows or 0):
            break
        # Many pairs are left: the odd members first meet one more member of the largest component, another in each bucket.
        more = open_rows.filter("comp = main").groupBy("key").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id", "key", F.lit(turn))).alias("p"))
        met = (odd.join(more.select("key", "p.id", "p.n"), "key").filter(near_size)
               .select(F.least("x", "id").alias("ia"), F.greatest("x", "id").alias("ib")).distinct().join(tested, ["ia", "ib"], "left_anti"))
        met = scratch.cut(met, "met")
        links = links.unionByName(_verified(scratch, met, reps, docs, shingle, percent))
        tested = tested.unionByName(met)
        groups = _components(links)
        scratch.drop(open_rows)
    crowded, sparse = scratch.cut(load.filter(F.col("pairs") > CROWDED).select("key"), "crowded"), open_rows
    if not crowded.isEmpty():
        crowded = few(crowded)
        links = links.unionByName(_crowd_links(scratch, open_rows.join(crowded, "key", "left_semi"), docs, shingle, percent))
        sparse = open_rows.join(crowded, "key", "left_anti")
    met = (odd.join(sparse, "key").filter((F.col("cx") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("x") < F.col("id"))) & near_size)
           .select(F.least("x", "id").alias("ia"), F.greatest("x", "id").alias("ib")).distinct().join(tested, ["ia", "ib"], "left_anti"))
    more = _verified(scratch, scratch.cut(met, "met"), reps, docs, shingle, percent)
    scratch.drop(shared, open_rows, sketches)
    groups = _components(links.unionByName(more))
    component = F.when(F.col("id").isNotNull(), F.coalesce("group_id", "rep", "id"))
    return (classed.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                    F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


def _components(links: DataFrame) -> DataFrame:
    return duplicate_groups(links).select("id", "group_id").distinct()
