"""Statements as frozen values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Eq:
    column: str
    value: object


@dataclass(frozen=True)
class Between:
    column: str
    low: object
    high: object


@dataclass(frozen=True)
class Radius:
    """Within `radius` of `center`: one column of points as text, or two numeric columns."""

    columns: tuple[str, ...]
    center: tuple[float, ...]
    radius: float


@dataclass(frozen=True)
class Match:
    column: str
    query: str


@dataclass(frozen=True)
class Similar:
    column: str
    path: str
    k: int | None = None
    mode: str = "INDEX"


Predicate = Eq | Between | Radius | Match | Similar


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    index: str | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateFromFile:
    table: str
    path: str
    index: tuple[str, str] | None = None  # (kind, column)


@dataclass(frozen=True)
class CreateIndex:
    table: str
    columns: tuple[str, ...]
    kind: str


@dataclass(frozen=True)
class CreateFts:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class CreateMm:
    table: str
    column: str
    k: int
    kind: str = "BOVW"


@dataclass(frozen=True)
class DropIndex:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[object, ...], ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Eq


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] = ("*",)
    where: Predicate | None = None
    limit: int | None = None
    options: dict = field(default_factory=dict, compare=False)


Statement = CreateTable | CreateFromFile | CreateIndex | CreateFts | CreateMm | DropIndex | Insert | Delete | Select
