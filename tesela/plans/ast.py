"""Statements of the SQL dialect, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass


class EngineError(Exception):
    """A refused statement: ``status`` is 400 (wrong), 404 (nothing there) or 500 (failed)."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status, self.message = status, message


@dataclass(frozen=True)
class Literal:
    value: str | int | float
    kind: str  # text, number or name


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # INT, FLOAT, DATE, TEXT, VARCHAR
    width: int | None = None
    index: str | None = None


@dataclass(frozen=True)
class IndexSpec:
    kind: str  # bplustree, isam, rtree, hash, none
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Point:
    x: float
    y: float


@dataclass(frozen=True)
class Equal:
    column: str
    value: Literal


@dataclass(frozen=True)
class Between:
    column: str
    low: Literal
    high: Literal


@dataclass(frozen=True)
class Within:
    """RANGE, and DISTANCE, which is RANGE on its second point."""

    center: Point
    radius: float


@dataclass(frozen=True)
class Nearest:
    center: Point
    k: int


Predicate = Equal | Between | Within | Nearest


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateFromFile:
    table: str
    path: str
    index: IndexSpec


@dataclass(frozen=True)
class Select:
    table: str
    where: Predicate | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    column: str
    value: Literal


Statement = CreateTable | CreateFromFile | Select | Insert | Delete
