"""Tables in units, and the manifest that says what is in them.

A batch writes one *unit*: a folder with the rows it adds to each table.  A unit is
never changed.  The manifest is one small file, written anew under the next number
when a batch, a rollback or a merge is committed; whoever holds a manifest sees one
state of all tables.  A rollback only lowers the block up to which older units are
read.  ``TIER`` neighbouring units of one level are merged into one of the next, so
that the number of units grows with the logarithm of the number of batches and
every row is rewritten that many times.

Rows are tested against what is there when they are written, so reading is a plain
scan: no grouping, no join, and filters reach the files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of one level that are merged into one of the next.
TIER = 16
#: Manifests that are kept; units that none of them names are deleted at a merge.
KEPT_MANIFESTS = 4
#: Rollbacks that the manifest remembers.
KEPT_ROLLBACKS = 100


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since the manifest was read."""


@dataclass(frozen=True)
class Unit:
    """What one batch, or a merge of neighbouring ones, has added: blocks ``low`` to
    ``high``, ``blocks`` of them; rows above ``limit`` are rolled back."""

    name: str
    low: int
    high: int
    blocks: int
    tables: dict[str, str] = field(default_factory=dict)
    level: int = 0
    limit: int | None = None

    @property
    def top(self) -> int:
        return self.high if self.limit is None else min(self.high, self.limit)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    units: tuple[Unit, ...] = ()
    epochs: tuple[str, ...] = ()
    rollbacks: tuple[tuple[int, int], ...] = ()
    holes: bool = False
    runs: tuple[tuple[int, int], ...] = ()

    def done(self, epoch: str) -> bool:
        """Whether a batch is committed; numbered ones are kept as runs."""
        return any(a <= int(epoch) <= b for a, b in self.runs) if epoch.isdigit() else epoch in self.epochs

    def with_epoch(self, epoch: str) -> Manifest:
        if not epoch.isdigit():
            return replace(self, epochs=(*self.epochs, epoch))
        runs: list[list[int]] = []
        for a, b in sorted([*self.runs, (int(epoch), int(epoch))]):
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        return replace(self, runs=tuple(map(tuple, runs)))

    def rolled_back(self, ancestor: int) -> Manifest:
        """Blocks above ``ancestor`` are no more; units of nothing else go."""
        units = tuple(replace(u, limit=ancestor) if u.top > ancestor else u for u in self.units if u.low <= ancestor)
        return replace(self, units=units, rollbacks=(*self.rollbacks, (self.version + 1, ancestor))[-KEPT_ROLLBACKS:])

    @property
    def checkpoint(self) -> int:
        """Largest block that is there; 0 if none is."""
        return max((u.top for u in self.units), default=0)

    def overlapping(self, low: int, high: int) -> bool:
        return any(u.low <= high and u.top >= low for u in self.units)


def _parse(text: str) -> Manifest:
    raw = json.loads(text)
    return Manifest(
        raw["version"], tuple(Unit(**u) for u in raw["units"]), tuple(raw["epochs"]), tuple(map(tuple, raw["rollbacks"])), raw["holes"], tuple(map(tuple, raw["runs"]))
    )


class Store:
    """A folder of units and manifests in any file system that Spark can write.
    One writer at a time; a second one fails at its commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm = jvm
        self._fs = self._path("").getFileSystem(conf)

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def names(self, below: str) -> list[str]:
        """Names in a folder; none if it is not there."""
        path = self._path(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    # -- manifest --------------------------------------------------------------

    def manifest(self) -> Manifest:
        """The state last committed."""
        found = [n for n in self.names("_manifest") if n.endswith(".json")]
        if not found:
            return Manifest()
        stream = self._fs.open(self._path(f"_manifest/{found[-1]}"))
        try:
            return _parse(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, new: Manifest) -> Manifest:
        """Makes ``new``, which follows the state it was made from, the state."""
        new = replace(new, version=new.version + 1)
        aside, final = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(f"_manifest/{new.version:012d}.json")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(asdict(new)).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise ConcurrentCommit(f"version {new.version} is there already")
        for name in [n for n in self.names("_manifest") if n.endswith(".json")][:-KEPT_MANIFESTS]:
            self._fs.delete(self._path(f"_manifest/{name}"), False)
        return new

    # -- units -----------------------------------------------------------------

    def folder(self, unit: str) -> str:
        return f"{self.root}/data/{unit}"

    def clear(self, unit: str) -> None:
        """Removes what a failed attempt at this unit has left."""
        self._fs.delete(self._path(f"data/{unit}"), True)

    def write(self, unit: str, table: str, rows: DataFrame) -> dict[str, str]:
        """Writes a unit's rows of one table."""
        rows.write.mode("overwrite").parquet(f"{self.folder(unit)}/{table}")
        return {table: table}

    def write_many(self, unit: str, folder: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows of several tables, named by the column ``table``, in one job;
        tables without rows get no folder."""
        rows.write.mode("overwrite").partitionBy("table").parquet(f"{self.folder(unit)}/{folder}")
        found = (n for n in self.names(f"data/{unit}/{folder}") if n.startswith("table="))
        return {n.removeprefix("table="): f"{folder}/{n}" for n in found}

    def read(self, table: str, schema: T.StructType, manifest: Manifest, block: str = "block_number", low: int | None = None, high: int | None = None) -> DataFrame:
        """A table's visible rows.  With ``low`` and ``high``, units of other blocks
        are not opened."""
        groups: dict[int | None, list[str]] = {}
        for u in manifest.units:
            if table in u.tables and (high is None or u.low <= high) and (low is None or u.top >= low):
                groups.setdefault(u.limit if u.top < u.high else None, []).append(f"{self.folder(u.name)}/{u.tables[table]}")
        rows = None
        for limit, paths in groups.items():
            part = self.spark.read.schema(schema).parquet(*paths)
            part = part if limit is None else part.where(F.col(block) <= limit)
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        if low is not None and high is not None:
            rows = rows.where(F.col(block).between(low, high))
        return rows

    def units_of(self, table: str, manifest: Manifest) -> list[tuple[Unit, str]]:
        return [(u, f"{self.folder(u.name)}/{u.tables[table]}") for u in manifest.units if table in u.tables]

    # -- merging ---------------------------------------------------------------

    def merge(self, manifest: Manifest, schemas: dict[str, T.StructType], blocks: dict[str, str]) -> Manifest:
        """Merges where ``TIER`` neighbouring units of one level stand together,
        the lowest level first, until none do."""
        while True:
            for at in range(len(manifest.units) - TIER + 1):
                group = manifest.units[at : at + TIER]
                if len({u.level for u in group}) == 1:
                    break
            else:
                return manifest
            manifest = self._merge(manifest, at, group, schemas, blocks)

    def _merge(self, manifest: Manifest, at: int, group: tuple[Unit, ...], schemas: dict[str, T.StructType], blocks: dict[str, str]) -> Manifest:
        name = f"merged-{uuid.uuid4().hex}"
        part = Manifest(units=group)
        tables: dict[str, str] = {}
        for table in dict.fromkeys(t for u in group for t in u.tables):
            if table not in schemas:  # of an entry that the spec has no more
                continue
            block = blocks.get(table, "block_number")
            rows = self.read(table, schemas[table], part, block)
            tables |= self.write(name, table, rows.repartitionByRange(block).sortWithinPartitions(block))
        one = Unit(name, min(u.low for u in group), max(u.top for u in group), sum(u.blocks for u in group), tables, group[0].level + 1)
        done = self.commit(replace(manifest, units=(*manifest.units[:at], one, *manifest.units[at + TIER :])))
        self._collect_garbage()
        return done

    def _collect_garbage(self) -> None:
        """Deletes units that no kept manifest names."""
        named: set[str] = set()
        for version in (n for n in self.names("_manifest") if n.endswith(".json")):
            stream = self._fs.open(self._path(f"_manifest/{version}"))
            try:
                named |= {u.name for u in _parse(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).units}
            finally:
                stream.close()
        for unit in set(self.names("data")) - named:
            self.clear(unit)

    def reset(self) -> None:
        """Deletes all tables and all state."""
        self._fs.delete(self._path(""), True)
