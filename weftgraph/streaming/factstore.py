"""A store of file facts that is updated file by file: changed, deleted and renamed files.

Every table has a path column and is kept in PARTS hash partitions of it. An update reads and
rewrites only the partitions that its files fall into, in all tables; the others keep their
files. One manifest for each version, written last, says which write of each partition is in
force and what its digest is, so an update that fails changes nothing and one that is tried
again (same batch number) is passed over.

Path evidence spans files: ``by_file`` lists, under each file, the evidence that one of its facts is
part of, so a change finds the evidence to delete from its own partitions, without a scan.

A partition's digest is its rows' number and the sums of two hashes of each, which is no
matter of order and sees repeated rows. Digests form a tree of FANOUT children a node; an
update recomputes the leaves of what it rewrote and the nodes above them, and two roots that
differ are followed down to the partitions that do.

Cases: rows with a null path are left out; a file that comes twice in a batch is kept once (the
greater hash); a file whose hash is the stored one is passed over with its facts; deleting
an unknown file does nothing; a deleted file and a new one of the same hash in one batch are
a rename (counted; smallest paths first); facts of files that aren't in the batch are left
out; empty batches make no version.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import materialized, shared_path

PARTS = 64
FANOUT = 8
#: files that a partition is written as, so that a very large file's facts are more than one task
FILES_A_PART = 4
FILES = "path string, hash string"
EVIDENCE = "path string, id string, files array<string>"
BY_FILE = "path string, id string, home string"


def part_of(path: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(parts)).cast("int")


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def leaf_digests(rows: DataFrame) -> DataFrame:
    """(part, n, s1, s2): number of a partition's rows and sums of two hashes of each row's text."""
    m = F.md5(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "part")), {"ignoreNullFields": "false"}).cast("binary"))
    piece = lambda at: F.sum(F.conv(F.substring("m", at, 15), 16, 10).cast("decimal(20,0)"))
    return rows.select("part", m.alias("m")).groupBy("part").agg(F.count("*").alias("n"), piece(1).alias("s1"), piece(16).alias("s2"))


@dataclass(frozen=True)
class FactStore:
    """One version of a store; tables are its fact tables' schemas by name."""

    spark: SparkSession
    root: str
    tables: dict[str, str]
    parts: int = PARTS
    version: int = 0
    batch: int = -1
    written: dict[str, int] = field(default_factory=dict)  # "table/part" to the write in force
    leaves: dict[str, str] = field(default_factory=dict)  # "table/part" to digest
    nodes: dict[str, str] = field(default_factory=dict)  # "level/place" to digest, for inner nodes

    @staticmethod
    def create(spark: SparkSession, tables: dict[str, str], root: str | None = None, parts: int = PARTS) -> FactStore:
        """An empty store; tables maps fact tables to their schemas, each with a path."""
        own = {"files": FILES, "evidence": EVIDENCE, "by_file": BY_FILE} | tables
        return FactStore(spark, root or shared_path(spark, "facts"), own, parts)._commit()

    @staticmethod
    def open(spark: SparkSession, root: str) -> FactStore:
        """The newest version of the store in a folder."""
        last = spark.read.schema("manifest string, version int").parquet(f"{root}/manifest").orderBy(F.desc("version")).first()
        known = json.loads(last["manifest"])
        return FactStore(spark, root, known["tables"], known["parts"], last["version"], known["batch"], known["written"], known["leaves"], known["nodes"])

    def _commit(self) -> FactStore:
        known = {"tables": self.tables, "parts": self.parts, "batch": self.batch, "written": self.written, "leaves": self.leaves, "nodes": self.nodes}
        self.spark.createDataFrame([(json.dumps(known),)], "manifest string").coalesce(1).write.parquet(f"{self.root}/manifest/version={self.version}")
        return self

    # ---- reading

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        """Rows of a table, of some of its partitions only if asked."""
        among = range(self.parts) if parts is None else parts
        paths = [f"{self.root}/{table}/v={self.written[k]}/part={p}" for p in among if (k := f"{table}/{p}") in self.written]
        schema = self.tables[table]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def has_facts(self, path: str) -> bool:
        """Whether any table but files has a row of the path."""
        part = self.spark.createDataFrame([(path,)], "path string").select(part_of(F.col("path"), self.parts)).first()[0]
        return any(self.read(t, [part]).where(F.col("path") == path).take(1) for t in self.tables if t not in ("files", "by_file"))

    # ---- writing

    def _parts(self, *frames: DataFrame) -> list[int]:
        """Numbers of the at most PARTS partitions that the paths of frames fall into."""
        return sorted({r[0] for df in frames for r in df.select(part_of(F.col("path"), self.parts)).distinct().collect()})

    def _replace(self, table: str, parts: list[int], gone: DataFrame, rows: DataFrame, gone_key: list[str] | None = None) -> dict:
        """Rewrite partitions of a table, all that gone (path, ...) and rows fall into: rows are made once, as they are written."""
        names, path = [f.split()[0] for f in self.tables[table].split(", ")], f"{self.root}/{table}/v={self.version + 1}"
        old = self.read(table, parts)
        now = old.join(gone, gone_key or ["path"], "left_anti").select(*names).unionByName(rows.select(*names)).withColumn("part", part_of(F.col("path"), self.parts))
        now.repartition("part", F.pmod(F.xxhash64(*names), F.lit(FILES_A_PART))).sortWithinPartitions("part", "path").write.mode("overwrite").partitionBy("part").parquet(path)
        written = self.spark.read.schema(f"{self.tables[table]}, part int").parquet(path)
        leaves = {r["part"]: _md5(f"{r['n']}|{r['s1']}|{r['s2']}") for r in leaf_digests(written).collect()}
        return {p: leaves.get(p) for p in parts}

    def _with(self, changes: dict[str, dict]) -> FactStore:
        """This store after the changed partitions' digests went up the tree."""
        version, written, leaves, nodes = self.version + 1, dict(self.written), dict(self.leaves), dict(self.nodes)
        dirty = set()
        for table, parts in changes.items():
            for p, leaf in parts.items():
                key = f"{table}/{p}"
                if leaf is None:
                    written.pop(key, None)
                    leaves.pop(key, None)
                else:
                    written[key], leaves[key] = version, leaf
                dirty.add(p)
        # a partition's leaf holds all its tables' digests; level 0 has a node a partition
        level, width = 0, self.parts
        below = {p: _md5("|".join(f"{t}:{leaves.get(f'{t}/{p}', '')}" for t in sorted(self.tables))) for p in dirty}
        nodes |= {f"0/{p}": d for p, d in below.items()}
        while width > 1:
            dirty = {p // FANOUT for p in dirty}
            nodes |= {f"{level + 1}/{q}": _md5("|".join(nodes.get(f"{level}/{c}") or self._bare(level, c) for c in range(q * FANOUT, min(width, (q + 1) * FANOUT)))) for q in dirty}
            level, width = level + 1, -(-width // FANOUT)
        return FactStore(self.spark, self.root, self.tables, self.parts, version, self.batch, written, leaves, nodes)

    def apply(self, batch: int, files: DataFrame, facts: dict[str, DataFrame], deleted: DataFrame | None = None, evidence: DataFrame | None = None) -> tuple[FactStore, dict[str, int]]:
        """(the store after a batch, what was done).

        files (path, hash) are new or changed, deleted (path) are gone; facts has their rows by
        table, evidence (path, id, files) the path evidence of their own. All that was stored
        for changed and deleted files goes, and the evidence of any file that one of them is in.
        """
        if batch <= self.batch:
            return self, {"passed_over": 1}
        files = files.where("path is not null").groupBy("path").agg(F.max("hash").alias("hash"))
        files = materialized(files.withColumn("part", part_of(F.col("path"), self.parts)), "changed")
        out = (deleted if deleted is not None else files.limit(0)).select("path").where("path is not null").distinct()
        out = materialized(out.join(files, "path", "left_anti").withColumn("part", part_of(F.col("path"), self.parts)), "deleted")
        near = sorted(r[0] for r in files.select("part").union(out.select("part")).distinct().collect())  # numbers of at most PARTS partitions
        stored = materialized(self.read("files", near).select("path", F.col("hash").alias("was")), "stored")
        changed = materialized(files.join(stored, "path", "left").where("was is null or not (was <=> hash)").select("path", "hash", F.col("was").isNull().alias("new")), "really")
        dead = materialized(out.join(stored, "path").select("path", F.col("was").alias("hash")), "dead")
        gone = materialized(changed.select("path").union(dead.select("path")), "gone")
        if not gone.take(1):
            return self, {"unchanged": files.count()}
        nth = F.row_number().over(W.partitionBy("hash").orderBy("path"))
        renamed = dead.withColumn("nth", nth).join(changed.where("new").withColumn("nth", nth), ["hash", "nth"]).count()

        changes, removed, parts = {}, 0, self._parts(gone)  # new facts are of files that changed, so they fall into these
        for table in self.tables:
            if table in ("files", "evidence", "by_file"):
                continue
            rows = facts[table].join(changed.select("path"), "path", "left_semi") if table in facts else self.spark.createDataFrame([], self.tables[table])
            removed += self.read(table, near).join(gone, "path", "left_semi").count()
            changes[table] = self._replace(table, parts, gone, rows)
        changes["files"] = self._replace("files", parts, gone, changed.select("path", "hash"))
        # evidence of other files that a changed file is part of, found under that file
        listed = self.read("by_file", near).join(gone, "path", "left_semi")
        stale = materialized(listed.select(F.col("home").alias("path"), "id").union(self.read("evidence", near).join(gone, "path", "left_semi").select("path", "id")).distinct(), "stale")
        own = (evidence if evidence is not None else self.spark.createDataFrame([], EVIDENCE)).join(changed.select("path"), "path", "left_semi")
        own = materialized(own.select("path", "id", "files"), "evidence")
        homes = sorted(r[0] for r in stale.select(part_of(F.col("path"), self.parts)).distinct().collect())  # numbers of at most PARTS partitions
        entries = lambda e: e.select(F.explode(F.array_distinct(F.array_append("files", F.col("path")))).alias("path"), "id", F.col("path").alias("home"))
        old_entries = materialized(entries(self.read("evidence", homes).join(stale, ["path", "id"], "left_semi")), "entries")
        dropped = stale.count()
        changes["evidence"] = self._replace("evidence", self._parts(stale, own), stale, own, gone_key=["path", "id"])
        changes["by_file"] = self._replace("by_file", self._parts(old_entries, entries(own)), old_entries, entries(own), gone_key=["path", "id", "home"])
        after = self._with(changes)
        after = FactStore(after.spark, after.root, after.tables, after.parts, after.version, batch, after.written, after.leaves, after.nodes)._commit()
        n = changed.agg(F.count("*"), F.count_if("new")).first()
        return after, {"indexed": n[0], "new": n[1], "deleted": dead.count(), "renamed": renamed, "unchanged": files.count() - n[0], "facts_removed": removed, "evidence_removed": dropped, "partitions": len({p for c in changes.values() for p in c})}

    # ---- digests

    def _width(self, level: int) -> int:
        """Nodes of a level."""
        width = self.parts
        for _ in range(level):
            width = -(-width // FANOUT)
        return width

    def _bare(self, level: int, place: int) -> str:
        """Digest of a node under which nothing was ever written."""
        if not level:
            return _md5("|".join(f"{t}:" for t in sorted(self.tables)))
        return _md5("|".join(self._bare(level - 1, c) for c in range(place * FANOUT, min(self._width(level - 1), (place + 1) * FANOUT))))

    def _node(self, level: int, place: int) -> str:
        return self.nodes.get(f"{level}/{place}") or self._bare(level, place)

    def digest(self) -> str:
        """Digest of all facts; equal for equal facts, however they came about."""
        return self._node(self._top(), 0)

    def _top(self) -> int:
        top = 0
        while self._width(top) > 1:
            top += 1
        return top

    def differing(self, other: FactStore) -> list[int]:
        """Partitions in which two stores of the same shape differ, found from the root down."""
        front = [0]
        for level in range(self._top(), -1, -1):
            front = [q for q in front if self._node(level, q) != other._node(level, q)]
            if level:
                front = [c for q in front for c in range(q * FANOUT, min(self._width(level - 1), (q + 1) * FANOUT))]
        return front


def stream_changes(spark: SparkSession, store: FactStore, source: str, extract) -> FactStore:
    """Apply files of changes as they arrive under source, one micro-batch each.

    extract(batch) gives (files, facts, deleted, evidence) of a batch of the stream's rows. The
    stream's progress is kept beside the store, so a later call goes on from there.
    """
    schema = spark.read.parquet(source).schema

    def step(rows: DataFrame, n: int) -> None:
        files, facts, deleted, evidence = extract(rows)
        FactStore.open(rows.sparkSession, store.root).apply(n, files, facts, deleted, evidence)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{store.root}/progress").foreachBatch(step).start().awaitTermination()
    return FactStore.open(spark, store.root)
