"""A stored index of hashes and their copy groups, to which new files are compared load by load."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.operators import multi_index as mi
from lumisift.operators.exact import copy_links, first_of_value
from lumisift.operators.groups import contracted_links, duplicate_groups
from lumisift.plans.skew import broadcast_if_small
from lumisift.schemas import require
from lumisift.session import cut

# Layout of the tables: the stored side of every join is bucketed by the column it is joined on.
ENTRIES = "h bigint, id bigint, part int, key bigint, load string"
MEMBERS = "id bigint, group_id bigint, load string"
MERGES = "group_id bigint, into bigint"
COMMITS = "version bigint, load string, generation int, merges string"
SETTINGS = "distance int, bits int, parts int, buckets int"


@dataclass(frozen=True)
class Commit:
    """What is in force: loads that are committed, the tables that hold them, and the merged groups."""
    version: int
    loads: tuple[str, ...]
    generation: int
    merges: str | None


class CopyIndex:
    """Groups of near copies of 64-bit hashes that grow by loads.

    `add` compares a load with itself and with all that is stored, and stores only what
    is new. The stored hashes lie in a table bucketed by substring (see `multi_index`),
    so a load is dealt to the buckets and the table stays where it is; the same holds for
    the groups, bucketed by id. Groups that a load joins are not rewritten: a small table
    says which group has become part of which, and is applied when groups are read.

    Groups after any number of loads are those of all rows at once. Distance 0 finds
    exact copies, of a content hash for instance. A load becomes visible by one appended
    row; what a load that failed has left behind is never read. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        row = spark.read.schema(SETTINGS).parquet(f"{self.folder}/settings").first()
        self.distance, self.bits, self.parts, self.buckets = row

    @classmethod
    def create(cls, spark: SparkSession, folder: str, distance: int, bits: int = 64, expected_rows: int = 10**6, buckets: int = 64) -> CopyIndex:
        """A new, empty index. `expected_rows` decides into how many substrings hashes are cut."""
        if not 0 <= distance < bits <= 64:
            raise ValueError("distance must lie between 0 and the number of bits, 64 at most")
        parts = mi.choose_parts(expected_rows, bits, distance)
        spark.createDataFrame([(distance, bits, parts, buckets)], SETTINGS).coalesce(1).write.parquet(f"{folder.rstrip('/')}/settings")
        return cls(spark, folder)

    # ---- what is stored

    def commit(self) -> Commit:
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits").orderBy("version").collect()
        except Exception as e:  # no folder yet: nothing is committed
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        if not rows:
            return Commit(0, (), 0, None)
        last = rows[-1]
        return Commit(last["version"], tuple(r["load"] for r in rows if r["generation"] == last["generation"]), last["generation"], last["merges"])

    def _table(self, kind: str, generation: int) -> str:
        """Name of a bucketed table, known to this session from now on."""
        schema, key = (ENTRIES, "key") if kind == "entries" else (MEMBERS, "id")
        path = f"{self.folder}/{kind}-{generation:04d}"
        name = f"copy_index_{kind}_{hashlib.md5(path.encode()).hexdigest()[:20]}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{path.replace(chr(39), chr(92) + chr(39))}'")
        return name

    def _read(self, kind: str, at: Commit) -> DataFrame:
        name = self._table(kind, at.generation)
        self.spark.catalog.refreshTable(name)
        # Loads that never were committed stay unread; committed ones are few names.
        return self.spark.table(name).filter(F.col("load").isin(*at.loads)).drop("load") if at.loads else self.spark.table(name).limit(0).drop("load")

    def _append(self, kind: str, generation: int, rows: DataFrame, load: str) -> None:
        key = "key" if kind == "entries" else "id"
        name = self._table(kind, generation)
        # Dealt as the buckets are, so that each bucket gets one file.
        rows.withColumn("load", F.lit(load)).select(*self.spark.table(name).columns).repartition(self.buckets, key).write.insertInto(name)

    def entries(self) -> DataFrame:
        """entries(h, id, part, key): each different hash under each of its substrings."""
        return self._read("entries", self.commit())

    def _merges(self, at: Commit) -> DataFrame:
        if at.merges is None:
            return self.spark.createDataFrame([], MERGES)
        return self.spark.read.schema(MERGES).parquet(at.merges)

    def groups(self) -> DataFrame:
        """groups(id, group_id) of all ids that have a copy; group_id is the lowest id of its group."""
        return self._groups(self.commit())

    def _groups(self, at: Commit) -> DataFrame:
        merged = self._merges(at)
        if at.merges is not None:
            merged = broadcast_if_small(merged)
        return (self._read("members", at).join(merged, "group_id", "left")
                .select("id", F.coalesce("into", "group_id").alias("group_id")))

    # ---- a load

    def _cuts(self) -> tuple[list[list[int]], list[int]]:
        return mi.cut_bits(self.bits, self.parts), mi.radii(self.distance, self.parts)

    def _keyed(self, rows: DataFrame, probe: bool) -> DataFrame:
        """Substrings as one key column: their number and bits, hashed one to one per number."""
        rows = (mi.asked_rows if probe else mi.listed_rows)(rows, *self._cuts())
        return rows.withColumns({"part": F.col("c0"), "key": F.xxhash64("c0", "v0")}).drop("c0", "v0")

    def equal_stored(self, distinct: DataFrame, at: Commit | None = None) -> DataFrame:
        """pairs(id_a, id_b) of stored hashes (id_a) and equal ones of distinct(h, id). Only the latter are shuffled."""
        cuts, within = self._cuts()
        part = within.index(max(within))  # every hash is listed under this substring
        stored = self._read("entries", at or self.commit()).filter(F.col("part") == part).select("key", F.col("h").alias("ha"), F.col("id").alias("id_a"))
        asked = self._keyed(distinct, probe=False).filter(F.col("part") == part).select("key", F.col("h").alias("hb"), F.col("id").alias("id_b"))
        return stored.join(asked.hint("merge"), "key").filter("ha = hb").select("id_a", "id_b")

    def near_stored(self, distinct: DataFrame, at: Commit | None = None, bucket_rows: int = mi.BUCKET_ROWS) -> DataFrame:
        """pairs(id_a, id_b, distance) of stored hashes (id_a) and those of distinct(h, id).

        Only look-ups are shuffled. A substring that more than `bucket_rows` stored hashes
        share is cut again, for which those hashes alone are dealt anew.
        """
        first = mi.first_near(*self._cuts(), "pa")
        stored, asked = self._read("entries", at or self.commit()), self._keyed(distinct, probe=True)
        # Counted where the rows lie: the table is bucketed by this column.
        crowded = cut(stored.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket_rows).select("key"), "crowded")
        deeper = None
        if self.parts > 1 and not crowded.isEmpty():
            hot, names = broadcast_if_small(crowded), {"part": "c0", "key": "v0"}
            left, right = (cut(t.join(hot, "key", "left_semi").withColumnsRenamed(names), "crowd") for t in (stored, asked))
            stored, asked = (t.join(hot, "key", "left_anti") for t in (stored, asked))
            deeper = mi.look_up(left, right, self.bits, self.distance, ["c0", "v0"], [first.replace("pa", "c0")], bucket_rows)
        a = stored.withColumnsRenamed({"h": "ha", "id": "ia", "part": "pa"})
        b = asked.withColumnsRenamed({"h": "hb", "id": "ib", "part": "pb"})
        # `pa - pb = 0` is no join key: the stored side is bucketed by `key` alone.
        near = f"if(bit_count(ha ^ hb) <= {self.distance}, pa - pb = 0 AND {first}, false)"
        pairs = (a.join(b.hint("merge"), "key").filter(F.expr(near))
                 .select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"), F.expr("bit_count(ha ^ hb)").alias("distance")))
        return pairs if deeper is None else pairs.unionByName(deeper)

    def add(self, rows: DataFrame, hash_col: str = "hash", id_col: str = "id") -> DataFrame:
        """Store a load and return its changes(id, group_id, was): ids whose group is new or another.

        `was` is the group an id had before, null for none; ids of stored groups that have
        been joined to others are listed with both. Ids must be new to the index; null
        hashes and ids are left out. An id without copies is in no group.
        """
        require(rows, hash_col, id_col)
        at, load = self.commit(), uuid.uuid4().hex
        new = cut(rows.select(F.col(id_col).cast("long").alias("id"), F.col(hash_col).cast("long").alias("h")).filter("id IS NOT NULL AND h IS NOT NULL"), "load")
        distinct = cut(first_of_value(new, F.col("h")).withColumnRenamed("value", "h"), "distinct")
        # Hashes already stored are represented by the stored row, whose near ones are in its group; the others are looked up and listed from now on.
        same = cut(self.equal_stored(distinct, at), "same")
        fresh = cut(distinct.join(broadcast_if_small(same.select(F.col("id_b").alias("id"))), "id", "left_anti"), "fresh")
        links = copy_links(new, F.col("h")).select("id_a", "id_b").unionByName(same.filter("id_a <> id_b"))
        if self.distance:
            near = mi.look_up(fresh, fresh, self.bits, self.distance, [], ["ia < ib"], mi.BUCKET_ROWS).unionByName(self.near_stored(fresh, at))
            links = links.unionByName(near.select("id_a", "id_b"))
        # Near pairs grow with the square of the rows: the tasks that find them pass on what connects the same ids.
        links = cut(contracted_links(links), "links")

        # Groups of groups: a stored end of a link stands for its whole group.
        ends = cut(links.select(F.col("id_a").alias("id")).unionByName(links.select(F.col("id_b").alias("id"))).distinct(), "ends")
        held = cut(self._groups_of(ends, at), "held")
        known = broadcast_if_small(held)
        of = links
        for end in ("id_a", "id_b"):
            of = (of.join(known.withColumnsRenamed({"id": end, "group_id": f"g_{end}"}), end, "left")
                  .withColumn(f"g_{end}", F.coalesce(f"g_{end}", end)))
        roots = cut(duplicate_groups(of.select(F.col("g_id_a").alias("id_a"), F.col("g_id_b").alias("id_b"))).distinct(), "roots")
        placed = ends.join(held, "id", "left").select("id", F.col("group_id").alias("was"), F.coalesce("group_id", "id").alias("node"))
        placed = cut(placed.join(roots.withColumnRenamed("id", "node"), "node", "left")
                     .select("id", "was", F.coalesce("group_id", "node").alias("group_id")), "placed")
        grown = placed.filter("was IS NULL").select("id", "group_id")
        into = cut(held.select("group_id").distinct().join(roots.select(F.col("id").alias("group_id"), F.col("group_id").alias("into")), "group_id")
                   .filter(F.col("into") != F.col("group_id")), "into")

        self._append("entries", at.generation, self._keyed(fresh, probe=False), load)
        self._append("members", at.generation, grown, load)
        merges = self._merged(at, into)
        changes = self._changes(at, grown, into)
        self._commit(Commit(at.version + 1, (load,), at.generation, merges), load)
        return changes

    def _groups_of(self, ids: DataFrame, at: Commit) -> DataFrame:
        """groups(id, group_id) of some ids: they are dealt to the buckets of the members."""
        merged = self._merges(at)
        return (self._read("members", at).join(ids, "id").join(merged, "group_id", "left")
                .select("id", F.coalesce("into", "group_id").alias("group_id")))

    def _merged(self, at: Commit, into: DataFrame) -> str | None:
        """Path of the table of merged groups with `into` applied; the old one if nothing was merged."""
        if into.isEmpty():
            return at.merges
        old = self._merges(at)
        # A group that was merged earlier follows the one it became part of.
        moved = (old.withColumnsRenamed({"into": "mid"}).join(into.withColumnsRenamed({"group_id": "mid"}), "mid", "left")
                 .select("group_id", F.coalesce("into", "mid").alias("into")))
        path = f"{self.folder}/merges-{uuid.uuid4().hex}"
        moved.unionByName(into).write.parquet(path)
        return path

    def _changes(self, at: Commit, grown: DataFrame, into: DataFrame) -> DataFrame:
        moved = self._groups(at).withColumnRenamed("group_id", "was").join(broadcast_if_small(into.withColumnsRenamed({"group_id": "was", "into": "group_id"})), "was")
        both = grown.withColumn("was", F.lit(None).cast("long")).unionByName(moved.select("id", "group_id", "was"))
        return cut(both, "changes")

    def _commit(self, commit: Commit, load: str) -> None:
        row = [(commit.version, load, commit.generation, commit.merges)]
        self.spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def compact(self) -> None:
        """Rewrite the tables as one load, groups as they now are: as many files as buckets again."""
        at, load = self.commit(), uuid.uuid4().hex
        generation = at.generation + 1
        self._append("entries", generation, self._read("entries", at), load)
        self._append("members", generation, self._groups(at), load)
        self._commit(Commit(at.version + 1, (load,), generation, None), load)


def displaced(groups: DataFrame, changes: DataFrame, scores: DataFrame) -> DataFrame:
    """removals(id, group_id, kept_id) in the groups that a load has changed.

    scores(id, score): the lowest score of a group is kept, then the lowest id; a null
    score, or none, loses to any. Groups that the load leaves alone are not looked at.
    """
    require(scores, "id", "score")
    touched = broadcast_if_small(changes.select("group_id").distinct())
    rows = groups.join(touched, "group_id", "left_semi").join(scores.select("id", "score"), "id", "left")
    rank = F.struct(F.col("score").isNull().alias("none"), "score", "id")
    rows = cut(rows.select("id", "group_id", rank.alias("rank")), "ranked")
    best = rows.groupBy("group_id").agg(F.min("rank")["id"].alias("kept_id"))
    return rows.join(best, "group_id").filter(F.col("id") != F.col("kept_id")).select("id", "group_id", "kept_id")
