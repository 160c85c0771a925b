"""Mutable tables on immutable files.

A table is a folder with a JSON pointer to its current state: its base and delta folders, the numbers of its deleted rows, and
its columns and layout. Every row has a number ``__seq``. A change writes new files and then swaps the pointer once, by a
rename, so a reader sees one state or the other, and a writer that dies before the swap leaves the table as it was.

Many small deltas are merged with each other; the base is not touched. Many deletions rewrite only the files that hold such
rows. ``compact`` rewrites the whole table in the order of its layout; it runs only when it is asked for.

A spatial table stores its coordinates as numbers too, with the code of a cell on a Z-order curve, by which its base is sorted:
the minima and maxima of the files then let a search skip all places far away.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.functions.geo import z_cell
from tesela.plans.ast import ColumnDef, EngineError, IndexSpec
from tesela.sources.csv_source import field as struct_field

SEQ, LON, LAT, CELL = "__seq", "__lon", "__lat", "__cell"
#: Columns that a table stores beside its own.
HIDDEN = (SEQ, LON, LAT, CELL)
#: Name of the column that tells deleted rows, where a scan asks for it (a fixed value of the row format).
DELETED = "eliminado"
#: Bytes of a row group of a spatial base: small enough that a circle touches few rows.
SPATIAL_ROW_GROUP = 4 << 20
#: Seconds after which the lock of a writer that no longer renews it may be taken.
LEASE = 120.0


@dataclass(frozen=True)
class Part:
    """A folder of files, without those that were rewritten elsewhere."""

    folder: str
    dropped: tuple[str, ...] = ()


@dataclass(frozen=True)
class State:
    name: str
    columns: tuple[ColumnDef, ...]
    index: IndexSpec
    bases: tuple[Part, ...] = ()
    deltas: tuple[Part, ...] = ()
    deleted: tuple[int, ...] = ()
    next_seq: int = 0
    lon: str | None = None
    lat: str | None = None
    #: The last batch that was appended of each stream.
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def spatial(self) -> bool:
        return self.lon is not None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([struct_field(c) for c in self.columns])

    @property
    def stored(self) -> T.StructType:
        places = [T.StructField(LON, T.DoubleType()), T.StructField(LAT, T.DoubleType()), T.StructField(CELL, T.LongType())] if self.spatial else []
        return T.StructType([*self.schema.fields, T.StructField(SEQ, T.LongType()), *places])


class Lock:
    """One writer a table, by a file that only one process can create; its owner renews it, and a stale one is taken over."""

    def __init__(self, path: str, wait: float = 30.0, lease: float = LEASE):
        self.path, self.wait, self.lease, self.owner = path, wait, lease, uuid.uuid4().hex
        self.done = threading.Event()

    def __enter__(self) -> Lock:
        end = time.time() + self.wait
        while True:
            try:
                f = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(f, self.owner.encode())
                os.close(f)
                threading.Thread(target=self._renew, daemon=True).start()
                return self
            except FileExistsError:
                self._break()
                if time.time() > end:
                    raise EngineError(500, "another writer holds the table") from None
                time.sleep(0.02)

    def _break(self) -> None:
        try:
            if time.time() - os.stat(self.path).st_mtime > self.lease:
                gone = f"{self.path}.{self.owner}"
                os.rename(self.path, gone)  # only one writer can move it
                os.unlink(gone)
        except FileNotFoundError:
            pass

    def _renew(self) -> None:
        while not self.done.wait(self.lease / 6):
            if self.held():
                os.utime(self.path)

    def held(self) -> bool:
        try:
            with open(self.path) as f:
                return f.read() == self.owner
        except FileNotFoundError:
            return False

    def __exit__(self, *_: object) -> None:
        self.done.set()
        if self.held():
            os.unlink(self.path)


def _path(folder: str) -> str:
    """``folder`` as a path; the pointers and locks need a folder that the driver can reach so."""
    u = urlparse(folder)
    if u.scheme not in ("", "file"):
        raise EngineError(500, f"the warehouse must be a path, not {folder}")
    return u.path if u.scheme else folder


class Storage:
    def __init__(self, spark: SparkSession, warehouse: str, compact_after: int = 32):
        self.spark, self.root, self.compact_after = spark, _path(warehouse), compact_after
        self.locks: dict[str, Lock] = {}
        os.makedirs(os.path.join(self.root, ".locks"), exist_ok=True)

    def names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.root) if self.exists(n))

    def _pointer(self, name: str) -> str:
        return os.path.join(self.root, name, "table.json")

    def lock(self, name: str) -> Lock:
        self.locks[name] = Lock(os.path.join(self.root, ".locks", name))
        return self.locks[name]

    def state(self, name: str) -> State:
        try:
            with open(self._pointer(name)) as f:
                raw = json.load(f)
        except FileNotFoundError:
            raise EngineError(400, f"no table {name}") from None
        parts = {k: tuple(Part(p["folder"], tuple(p["dropped"])) for p in raw[k]) for k in ("bases", "deltas")}
        return State(**raw | parts | {"columns": tuple(ColumnDef(**c) for c in raw["columns"]), "index": IndexSpec(raw["index"]["kind"], tuple(raw["index"]["columns"])), "deleted": tuple(raw["deleted"])})

    def swap(self, s: State) -> None:
        lock = self.locks.get(s.name)
        if lock is not None and not lock.done.is_set() and not lock.held():
            raise EngineError(500, "the lock was lost")
        path = self._pointer(s.name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.new", "w") as f:
            json.dump(asdict(s), f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.new", path)

    def exists(self, name: str) -> bool:
        return os.path.exists(self._pointer(name))

    def _write(self, s: State, df: DataFrame, kind: str) -> Part:
        folder = f"{kind}-{uuid.uuid4().hex}"
        writer = df.select(*s.stored.fieldNames()).write
        for c in s.index.columns if s.index.kind == "hash" else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if s.spatial and kind == "base":
            writer = writer.option("parquet.block.size", SPATIAL_ROW_GROUP)
        writer.parquet(os.path.join(self.root, s.name, folder))
        return Part(folder)

    def placed(self, s: State, df: DataFrame) -> DataFrame:
        """Rows with the stored coordinates (a missing one is 0) and their cell."""
        if not s.spatial:
            return df
        number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0))
        return df.withColumn(LON, number(s.lon)).withColumn(LAT, number(s.lat)).withColumn(CELL, z_cell(F.col(LON), F.col(LAT)))

    def _laid_out(self, s: State, df: DataFrame) -> DataFrame:
        """Rows in the order of the layout; an index never changes an answer, only how much a scan can skip."""
        if s.index.kind in ("bplustree", "isam"):
            return df.repartitionByRange(*s.index.columns).sortWithinPartitions(*s.index.columns)
        if s.index.kind == "hash":
            return df.repartition(*s.index.columns).sortWithinPartitions(*s.index.columns)
        return df.repartitionByRange(CELL).sortWithinPartitions(CELL) if s.spatial else df

    def create(self, s: State, rows: DataFrame | None = None) -> tuple[State, int]:
        """Make the table; ``rows`` must be in the order in which they count as first."""
        if self.exists(s.name):
            raise EngineError(400, f"table {s.name} exists")
        n = 0
        if rows is not None:
            # row numbers follow the order of the input; gaps between partitions do not matter
            part = self._write(s, self._laid_out(s, self.placed(s, rows)), "base")
            n, top = self._numbers(s, part)
            s = replace(s, bases=(part,), next_seq=top + 1)
        self.swap(s)
        return s, n

    def _numbers(self, s: State, part: Part) -> tuple[int, int]:
        """The rows of a part and their greatest number."""
        n, top = self._read(s, (part,)).agg(F.count("*"), F.max(SEQ)).first()
        return n, -1 if top is None else top

    def _read(self, s: State, parts: tuple[Part, ...]) -> DataFrame:
        paths = []
        for p in parts:
            at = os.path.join(self.root, s.name, p.folder)
            paths += [os.path.join(at, f) for f in sorted(os.listdir(at)) if f.endswith(".parquet") and f not in p.dropped] if p.dropped else [at]
        return self.spark.read.schema(s.stored).parquet(*paths) if paths else self.spark.createDataFrame([], s.stored)

    def scan(self, name: str, include_deleted: bool = False, flag: bool = False, state: State | None = None) -> DataFrame:
        """The rows with their hidden columns; a bounded list of deleted numbers is filtered in the scan.

        Deleted rows are kept on demand, until their file is rewritten; ``flag`` tells them by a column.
        """
        s = state or self.state(name)
        df = self._read(s, (*s.bases, *s.deltas))
        gone = F.col(SEQ).isin(list(s.deleted)) if s.deleted else F.lit(False)
        if flag:
            df = df.withColumn(DELETED, gone)
        return df if include_deleted or not s.deleted else df.filter(~gone)

    def append(self, s: State, rows: DataFrame, count: int | None = None, stream: str = "", batch: int = -1) -> tuple[State, int]:
        """Add rows, numbered from ``next_seq`` on, as one delta; (state, rows added)."""
        part = self._write(s, self.placed(s, rows), "delta")
        if count is None:
            count, top = self._numbers(s, part)
        else:
            top = s.next_seq + count - 1
        s = replace(s, deltas=(*s.deltas, part), next_seq=max(s.next_seq, top + 1), batches=s.batches | ({stream: batch} if stream else {}))
        self.swap(s)
        return (self.merge(s) if len(s.deltas) > self.compact_after else s), count

    def delete(self, s: State, seq: int) -> State:
        s = replace(s, deleted=(*s.deleted, seq))
        self.swap(s)
        return self.purge(s) if len(s.deleted) > 8 * self.compact_after else s

    def merge(self, s: State) -> State:
        """All deltas into one; the base stays as it is. A delta of a base's size becomes a base itself, in the layout."""
        gone = F.col(SEQ).isin(list(s.deleted)) if s.deleted else F.lit(False)
        rows = self._read(s, s.deltas).filter(~gone)
        here = {r[0] for r in self._read(s, s.deltas).filter(gone).select(SEQ).collect()} if s.deleted else set()
        size = lambda parts: sum(os.path.getsize(os.path.join(self.root, s.name, p.folder, f)) for p in parts for f in os.listdir(os.path.join(self.root, s.name, p.folder)) if f not in p.dropped)
        grown = size(s.deltas) * 4 > size(s.bases)
        part = self._write(s, self._laid_out(s, rows) if grown else rows.coalesce(8), "base" if grown else "delta")
        s = replace(s, bases=(*s.bases, part) if grown else s.bases, deltas=() if grown else (part,), deleted=tuple(x for x in s.deleted if x not in here))
        self.swap(s)
        return s

    def purge(self, s: State) -> State:
        """Rewrite the files that hold deleted rows, of which there are no more than deleted rows; all others stay."""
        gone = F.col(SEQ).isin(list(s.deleted))
        every = (*s.bases, *s.deltas)
        hit = [r[0] for r in self._read(s, every).filter(gone).select(F.input_file_name()).distinct().collect()]
        files = {(os.path.basename(os.path.dirname(p)), os.path.basename(p)) for p in (urlparse(h).path for h in hit)}
        if files:
            rows = self.spark.read.schema(s.stored).parquet(*[os.path.join(self.root, s.name, *f) for f in sorted(files)]).filter(~gone)
            part = self._write(s, self._laid_out(s, rows), "base")
            rest = lambda parts: tuple(replace(p, dropped=(*p.dropped, *sorted(f for at, f in files if at == p.folder))) for p in parts)
            s = replace(s, bases=(*rest(s.bases), part), deltas=rest(s.deltas))
        s = replace(s, deleted=())
        self.swap(s)
        return s

    def compact(self, name: str) -> State:
        """Base and deltas into one base without deleted rows. Old files stay for readers that hold them."""
        s = self.state(name)
        s = replace(s, bases=(self._write(s, self._laid_out(s, self.scan(name, state=s)), "base"),), deltas=(), deleted=())
        self.swap(s)
        return s
