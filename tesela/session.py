"""The engine: statements in, results out."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tesela.functions.geo import valid_point
from tesela.operators.prepare import first_wins
from tesela.operators.spatial import nearest, place_key, radius
from tesela.plans import analyzer
from tesela.plans.ast import Between, ColumnDef, CreateFromFile, CreateTable, Delete, EngineError, Equal, IndexSpec, Insert, Literal, Nearest, Select, Statement, Within
from tesela.plans.parser import parse
from tesela.sources import csv_source
from tesela.sources.storage import HIDDEN, LAT, LON, SEQ, State, Storage


@dataclass
class Result:
    status: int
    message: str = ""
    df: DataFrame | None = None
    execution_time_ms: float = 0.0
    rows_skipped: int = 0

    @property
    def execution_time_seconds(self) -> float:
        """Milliseconds, under the name that older clients read."""
        return self.execution_time_ms

    def rows(self) -> list[Row]:
        return self.df.collect() if self.df is not None else []

    def show(self, n: int = 20) -> None:
        if self.df is None:
            print(self.message)
        else:
            self.df.show(n, truncate=False)


def bind_point(columns: tuple[str, ...]) -> tuple[str, str]:
    """(longitude, latitude) of an ``rtree(a, b)``: by the names if they tell, else in the declared order x, y."""
    lon = [c for c in columns if c.lower().startswith(("lon", "lng"))]
    lat = [c for c in columns if c.lower().startswith("lat")]
    return (lon[0], lat[0]) if lon and lat else (columns[0], columns[1])


class Engine:
    def __init__(self, spark: SparkSession, warehouse: str, profile: str | None = None, compact_after: int = 32, range_mode: str = "circle"):
        self.spark, self.profile, self.range_mode = spark, profile, range_mode
        self.storage = Storage(spark, warehouse, compact_after)
        self.views: dict[str, tuple[DataFrame, str, str | None, str | None]] = {}
        for name in self.storage.names():
            self._refresh(name)

    def _refresh(self, name: str) -> None:
        """Show the current state of a table under its name in Spark SQL."""
        self.scan(name).createOrReplaceTempView(name)

    def scan(self, name: str, include_deleted: bool = False, include_deleted_flag: bool = False) -> DataFrame:
        """The rows of a stored table; deleted ones too on demand, as long as their file is not rewritten, with a column that tells them."""
        return self.storage.scan(name, include_deleted, include_deleted_flag).drop(*HIDDEN)

    def register(self, name: str, df: DataFrame, key: str, lon: str | None = None, lat: str | None = None) -> None:
        """Make a DataFrame readable as a table."""
        self.views[name] = (df, key, lon, lat)

    def sql(self, text: str) -> Result:
        began = time.perf_counter()
        try:
            result = self.execute(parse(text))
        except EngineError as e:
            result = Result(e.status, e.message)
        result.execution_time_ms = (time.perf_counter() - began) * 1000
        return result

    def execute(self, s: Statement) -> Result:
        run = {CreateTable: self._create, CreateFromFile: self._load, Select: self._select, Insert: self._insert, Delete: self._delete}
        result = run[type(s)](s)
        if not isinstance(s, Select):
            self._refresh(s.table)
        return result

    def _create(self, s: CreateTable) -> Result:
        if self.storage.exists(s.table):
            raise EngineError(400, f"table {s.table} exists")
        with self.storage.lock(s.table):
            self.storage.create(State(s.table, s.columns, IndexSpec("none")))
        return Result(200, f"table {s.table} created")

    def _load(self, s: CreateFromFile) -> Result:
        if self.storage.exists(s.table):
            raise EngineError(400, f"table {s.table} exists")
        raw = csv_source.read_csv(self.spark, s.path)
        if s.index.kind == "rtree" and not set(s.index.columns) <= set(raw.columns):
            raw = csv_source.places(raw)
        columns = csv_source.infer(raw)
        missing = [c for c in s.index.columns if c not in raw.columns]
        if missing:
            raise EngineError(400, f"no column {missing[0]}")
        rows = csv_source.load(raw, columns, self.profile).withColumn(SEQ, F.monotonically_increasing_id())
        state, total = State(s.table, columns, s.index), rows.count()
        if s.index.kind == "rtree":
            lon, lat = bind_point(s.index.columns)
            state = State(s.table, columns, s.index, lon=lon, lat=lat)
            rows = rows.filter(valid_point(F.coalesce(F.col(lat).try_cast("double"), F.lit(0.0)), F.coalesce(F.col(lon).try_cast("double"), F.lit(0.0))))
        elif "id" in rows.columns:
            rows = first_wins(rows, "id", SEQ)
        with self.storage.lock(s.table):
            _, kept = self.storage.create(state, rows)
        return Result(200, f"table {s.table} created", rows_skipped=total - kept)

    def _table(self, name: str) -> tuple[DataFrame, str | None, str | None, str | None]:
        """(rows, key column, longitude, latitude)."""
        if name in self.views:
            df, key, lon, lat = self.views[name]
            return (df if SEQ in df.columns else df.withColumn(SEQ, F.lit(0).cast("long"))), key, lon, lat
        s = self.storage.state(name)
        return self.storage.scan(name), (None if s.spatial else "id"), s.lon, s.lat

    def _keyed(self, df: DataFrame, spatial: bool) -> DataFrame:
        have = {c.lower(): c for c in df.columns}
        name = next((have[c] for c in ("name", "city") if c in have), None)
        country = have.get("country")
        return df.withColumn("__key", place_key(F.col(name) if name else F.lit(None), F.col(country) if country else F.lit(None))) if spatial else df

    def _select(self, s: Select) -> Result:
        df, key, lon, lat = self._table(s.table)
        w, spatial = s.where, lon is not None
        out = [c for c in df.columns if c not in HIDDEN]
        if isinstance(w, Within | Nearest):
            if not spatial:
                raise EngineError(400, f"table {s.table} has no places")
            if isinstance(w, Nearest) and w.k < 0:
                raise EngineError(400, "k is negative")
            d = self._keyed(df, True)
            if LON not in d.columns:  # a registered DataFrame; stored tables have their coordinates as numbers, which the scan can filter
                d = d.withColumn(LON, F.coalesce(F.col(lon).try_cast("double"), F.lit(0.0))).withColumn(LAT, F.coalesce(F.col(lat).try_cast("double"), F.lit(0.0)))
            found = radius(d, LON, LAT, w.center.x, w.center.y, w.radius, ["__key", SEQ], self.range_mode) if isinstance(w, Within) else nearest(d, LON, LAT, w.center.x, w.center.y, w.k, ["__key", SEQ])
            return Result(200, df=found.select(*out))
        if isinstance(w, Equal):
            if w.column in ("id", "key") and w.column not in df.columns:
                if spatial:
                    found = self._keyed(df, True).filter(F.col("__key") == F.lit(str(w.value.value))).orderBy(SEQ).limit(1)
                else:
                    found = df.filter(analyzer.equal(Equal(key or "id", w.value), df.schema)).limit(1)
            else:
                found = df.filter(analyzer.equal(w, df.schema))
            return Result(200, df=found.select(*out))
        if isinstance(w, Between):
            df = df.filter(analyzer.between(w, df.schema))
        return Result(200, df=df.select(*out))

    def _stored(self, v: Literal, c: ColumnDef):
        return csv_source.typed(F.lit(str(v.value)), c) if c.type not in ("INT", "FLOAT") else self._plain(v, c)

    @staticmethod
    def _plain(v: Literal, c: ColumnDef):
        try:
            n = float(v.value)
        except ValueError:
            raise EngineError(400, f"{c.name} holds numbers, not {v.value!r}") from None
        return F.lit(int(n)).cast("int") if c.type == "INT" else F.lit(n).cast("float")

    def _insert(self, s: Insert) -> Result:
        with self.storage.lock(s.table) if self.storage.exists(s.table) else _missing(s.table):
            state = self.storage.state(s.table)
            if len(s.values) != len(state.columns):
                raise EngineError(400, f"{len(state.columns)} values are needed, {len(s.values)} given")
            row = self.spark.range(1).select(*[self._stored(v, c).alias(c.name) for v, c in zip(s.values, state.columns)], F.lit(state.next_seq).cast("long").alias(SEQ))
            live = self.storage.scan(s.table)
            if state.spatial:
                one = self._keyed(row, True).select("__key", F.col(state.lon).try_cast("double").alias("x"), F.col(state.lat).try_cast("double").alias("y")).first()
                if one["x"] is None or one["y"] is None or not (abs(one["x"]) <= 180 and abs(one["y"]) <= 90):
                    raise EngineError(400, "invalid coordinates")
                taken = self._keyed(live, True).filter(F.col("__key") == one["__key"])
            else:
                k = "id" if "id" in live.columns else None
                taken = live.filter(F.col(k) == row.first()[k]) if k else live.filter(F.lit(False))
            if taken.limit(1).count():
                raise EngineError(400, "the key is taken")
            self.storage.append(state, row, 1)
        return Result(200, "row inserted")

    def _delete(self, s: Delete) -> Result:
        with self.storage.lock(s.table) if self.storage.exists(s.table) else _missing(s.table):
            state, live = self.storage.state(s.table), self.storage.scan(s.table)
            if s.column != ("key" if state.spatial else "id"):
                raise EngineError(400, f"rows are deleted by {'key' if state.spatial else 'id'}")
            found = self._keyed(live, True).filter(F.col("__key") == F.lit(str(s.value.value))) if state.spatial else live.filter(analyzer.equal(Equal("id", s.value), live.schema))
            first = found.agg(F.min(SEQ)).first()[0]
            if first is None:
                raise EngineError(404, "no such row")
            self.storage.delete(state, first)
        return Result(200, "row deleted")

    def count(self, table: str) -> int:
        return self._table(table)[0].count()

    def compact(self, table: str) -> None:
        """Rewrite a table in the order of its layout, without deleted rows."""
        with self.storage.lock(table) if self.storage.exists(table) else _missing(table):
            self.storage.compact(table)
        self._refresh(table)

    def bulk_append(self, table: str, rows: DataFrame, stream: str = "", batch: int = -1) -> int:
        """Add many places at once; those with invalid coordinates are skipped, keys may repeat. Returns the number added.

        A ``batch`` of a ``stream`` that is not after the last one was added before, and is skipped.
        """
        with self.storage.lock(table) if self.storage.exists(table) else _missing(table):
            state = self.storage.state(table)
            if stream and batch <= state.batches.get(stream, -1):
                return 0
            good = rows.select(*[F.col(f"`{c.name}`").cast(csv_source.field(c).dataType).alias(c.name) for c in state.columns])
            if state.spatial:
                good = good.filter(valid_point(F.col(state.lat).try_cast("double"), F.col(state.lon).try_cast("double")))
            # numbers are unique and above all earlier ones; gaps do not matter
            good = good.withColumn(SEQ, F.lit(state.next_seq) + F.monotonically_increasing_id())
            _, n = self.storage.append(state, good, stream=stream, batch=batch)
        self._refresh(table)
        return n


class _missing:
    def __init__(self, table: str):
        self.table = table

    def __enter__(self) -> None:
        raise EngineError(400, f"no table {self.table}")

    def __exit__(self, *_: object) -> None:
        pass
