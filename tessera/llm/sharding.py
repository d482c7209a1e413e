"""Size-tiered shards under a versioned manifest, by DataFrame reads and writes alone.

Arrivals are appended as small immutable runs, each a folder of Parquet files. Runs of similar size (the same tier, a power of
the fan-in) are merged, fan_in at a time, into files of the target size, without a shuffle. A manifest lists the live runs; as
tiers hold fewer than fan_in runs after compaction, it stays short whatever the number of files. Version n + 1 is written to the side
and then named, which fails if another writer was first (a rename on HDFS, a link on a local disk; an object store needs a
committer that can create a name once), whereupon the change is made again on that writer's version. Readers of an older
version keep their files, as nothing is changed in place.
"""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a shard after compaction, and runs merged at once.
TARGET_BYTES = 64 << 20
FAN_IN = 4
#: Merges that run at the same time, and attempts to commit.
MERGES, ATTEMPTS = 8, 20


class ManifestConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Shards of one table under `root`, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifest

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:13]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The given version, or the last; an empty one before the first commit."""
        have = self.versions()
        if not have:
            return {"version": 0, "runs": []}
        f = self._fs.open(self._path(self._manifest(have[-1] if version is None else version)))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def commit(self, base: dict, runs: list[dict]) -> dict:
        """Makes `runs` the next version after `base`, or raises ManifestConflict: creating its name succeeds for one writer alone."""
        new = {"version": base["version"] + 1, "parent": base["version"], "runs": runs}
        final = self._path(self._manifest(new["version"]))
        if self._fs.exists(final):
            raise ManifestConflict(str(new["version"]))
        side, data = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), bytearray(json.dumps(new).encode())
        out = self._fs.create(side, False)
        out.write(data)
        out.close()
        try:
            self._name(self._fs.makeQualified(side), self._fs.makeQualified(final))
        except Exception as e:
            raise ManifestConflict(str(new["version"])) from e
        finally:
            self._fs.delete(side, False)
        return new

    def _name(self, side, final) -> None:
        """Gives a file its name, or raises if that is taken. Renaming checks first on a local disk, so there it is a link."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        if side.toUri().getScheme() == "file":
            at = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(at(final), at(side))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(side.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(side, final, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _committed(self, change) -> dict:
        """Commits change(runs), and where another writer was first, again on what that one left; None changes nothing."""
        for _ in range(ATTEMPTS):
            base = self.manifest()
            runs = change(base["runs"])
            if runs is None:
                return base
            with contextlib.suppress(ManifestConflict):
                return self.commit(base, runs)
        raise ManifestConflict(f"lost {ATTEMPTS} times")

    # ---- runs

    def _written(self, df: DataFrame) -> dict:
        """df as a run: a folder of Parquet files that never changes."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._run(folder)

    def _run(self, folder: str) -> dict:
        sizes = [s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        return {"folder": folder, "files": len(sizes), "bytes": sum(sizes), "tier": self.tier(sum(sizes))}

    def tier(self, size: int) -> int:
        """Runs of similar size: the power of the fan-in that the size in MB reaches."""
        return max(0, int(math.log(max(size / (1 << 20), 1), self.fan_in)))

    def append(self, df: DataFrame) -> dict:
        """Adds df's rows as a new run and commits. Other appends and merges may go on meanwhile."""
        run = self._written(df)
        return self._committed(lambda runs: [*runs, run])

    def append_split(self, df: DataFrame, arrival: Column, n: int) -> None:
        """Adds df's rows as n runs by `arrival` (0 to n - 1), one commit after the other, from one pass over df.

        The rows are written in folders by arrival to the side; each then gets the name of a run, and is committed.
        """
        side, tag = f"{self.root}/data/{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        df.withColumn(tag, arrival).write.partitionBy(tag).option("compression", "zstd").parquet(side)
        for k in range(n):
            folder, part = f"{self.root}/data/{uuid.uuid4().hex}", self._path(f"{side}/{tag}={k}")
            self._fs.rename(part, self._path(folder)) if self._fs.exists(part) else self._fs.mkdirs(self._path(folder))
            run = self._run(folder)
            self._committed(lambda runs, run=run: [*runs, run])
        self._fs.delete(self._path(side), True)

    def _merge(self, group: list[dict], schema) -> dict:
        """The rows of some runs in files of about the target size; a task reads whole files, nothing is shuffled."""
        n = max(1, math.ceil(sum(r["bytes"] for r in group) / self.target_bytes))
        made = self._written(self.spark.read.schema(schema).parquet(*[r["folder"] for r in group]).coalesce(n))
        return made | {"tier": max([made["tier"], *[r["tier"] + 1 for r in group]])}

    def _full(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of fan_in runs of one tier, oldest first."""
        tiers: dict[int, list[dict]] = {}
        for r in runs:
            tiers.setdefault(r["tier"], []).append(r)
        return [t[k : k + self.fan_in] for _, t in sorted(tiers.items()) for k in range(0, len(t) - self.fan_in + 1, self.fan_in)]

    def compact(self, schema) -> dict:
        """Merges fan_in runs of a tier as long as a tier has so many; a merged run goes up a tier.

        Merges that don't depend on each other run at the same time, and each commits by itself. One whose runs another writer has
        merged meanwhile is dropped.
        """
        while groups := self._full(self.manifest()["runs"]):
            with ThreadPoolExecutor(max_workers=MERGES) as pool:
                list(pool.map(lambda g: self._merged(g, schema), groups))
        return self.manifest()

    def _merged(self, group: list[dict], schema) -> None:
        made, gone = self._merge(group, schema), {r["folder"] for r in group}

        def change(runs: list[dict]) -> list[dict] | None:
            if not gone <= {r["folder"] for r in runs}:
                return None
            return [*[r for r in runs if r["folder"] not in gone], made]

        if not any(r["folder"] == made["folder"] for r in self._committed(change)["runs"]):
            self._fs.delete(self._path(made["folder"]), True)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version (the last by default)."""
        folders = [r["folder"] for r in self.manifest(version)["runs"] if r["files"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def vacuum(self, keep_versions: int = 1, grace_seconds: float = 86400) -> int:
        """Deletes what no reader of the last keep_versions versions needs: older manifests, and folders that these versions don't list.

        So do folders that a crashed append or merge left behind. Folders younger than grace_seconds stay, as a writer may be
        about to commit them. Returns how many folders went.
        """
        kept, gone = self.versions()[-keep_versions:], 0
        live = {self._path(r["folder"]).getName() for v in kept for r in self.manifest(v)["runs"]}
        data, now = self._path(f"{self.root}/data"), time.time()
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in live and now - s.getModificationTime() / 1000 >= grace_seconds:
                gone += bool(self._fs.delete(s.getPath(), True))
        for v in self.versions():
            if v not in kept:
                self._fs.delete(self._path(self._manifest(v)), False)
        return gone


def shard_documents(docs: DataFrame, root: str, arrivals: int = 8, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardStore:
    """Appends docs in `arrivals` batches (by a hash of doc_id and text), one commit after the other, and compacts them.

    Null texts, null ids, repeated rows and further columns of any names are stored as they are; an empty table commits
    empty runs. A lost task is run again by Spark's committer; what a lost driver leaves uncommitted is in no manifest, and
    vacuum() removes it.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes, fan_in)
    store.append_split(docs, F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(arrivals)).cast("int"), arrivals)
    store.compact(docs.schema)
    return store
