"""Table sources: what an increment is, by strategy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ANCHOR, EXPORT_DATE, MARKERS
from ..operators.errors import PlatformViolation
from ..operators.shape import q, stamp_table_read
from .store import Store, Table

BEGINNING = datetime(1900, 1, 1, tzinfo=UTC)


def kind_of(columns: list[str]) -> str:
    """stamped (all markers), foreign (none) or malformed (some), whatever their case."""
    have = {c.upper() for c in columns} & set(MARKERS)
    return "foreign" if not have else "stamped" if len(have) == len(MARKERS) else "malformed"


def require_kind(name: str, columns: list[str], strategy: str) -> None:
    kind = kind_of(columns)
    if kind == "malformed":
        raise PlatformViolation("malformed_table", f"{name} carries only some of {', '.join(MARKERS)}")
    if strategy in ("checkpoint", "watermark") and kind == "foreign":
        raise PlatformViolation("unstamped_table", f"{name} has no exports to follow; read it with full_read or delta_read")
    if strategy in ("full_read", "delta_read") and kind == "stamped":
        raise PlatformViolation("stamped_table", f"{name} holds exports already; {strategy} would stamp them again")


def after(df: DataFrame, column: str, mark) -> DataFrame:
    """Rows whose column is later than the mark. The mark takes the column's type, never the reverse, so the filter reaches the scan."""
    return df.where(q(column) > F.lit(mark).cast(df.schema[column].dataType))


def high_mark(target: DataFrame | None, column: str):
    """The target's highest value; the beginning of time if it has none."""
    if target is None:
        return BEGINNING
    return target.agg(F.max(column)).first()[0] or BEGINNING


def delta_rows(df: DataFrame, anchor: str, mark) -> DataFrame:
    """Rows changed after the mark, with the change in the anchor column. Null anchors are never read."""
    name = next((c for c in df.columns if c.lower() == anchor.lower()), None)
    if name is None:
        raise PlatformViolation("anchor_column_missing", f"no column {anchor}")
    if not isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise PlatformViolation("anchor_wrong_type", f"{name} is {df.schema[name].dataType.simpleString()}, not a date or timestamp")
    return after(df, name, mark).withColumn(ANCHOR, q(name).cast("timestamp"))


@dataclass
class TableReader:
    """Reads the source and its deletes feed with one mark, resolved before anything is written."""

    store: Store
    strategy: str
    target: Table
    read_time: datetime
    anchor: str | None = None
    by_anchor: bool = False
    offset: Callable[[], int] | None = None  # last version consumed, for checkpoint
    _mark: object = None

    def mark(self, column: str):
        if self._mark is None:
            target = self.target.read() if self.target.exists() else None
            if target is not None and column not in target.columns:
                raise PlatformViolation("anchor_not_stamped", f"{self.target.name} has no {column}")
            self._mark = high_mark(target, column)
        return self._mark

    def read(self, name: str) -> tuple[DataFrame, int | None]:
        """(rows, source version consumed)."""
        table = self.store.table(name)
        own = table.exists()
        df = table.read() if own else self.store.spark.table(name)
        require_kind(name, df.columns, self.strategy)
        if self.strategy == "checkpoint":
            files, now = table.appended_since(self.offset() if self.offset else -1)
            return table.read_files(files, table.commit_at().struct), now
        if self.strategy == "watermark":
            column = ANCHOR if self.by_anchor else EXPORT_DATE
            if column not in df.columns:
                raise PlatformViolation("anchor_not_stamped", f"{name} has no {column}")
            mark = self.mark(column)
            if own and column == EXPORT_DATE:
                df = table.read(export_after=mark)  # whole files are skipped by their newest export
            return after(df, column, mark), None
        if self.strategy == "full_read":
            return stamp_table_read(df, name, self.read_time), None
        return stamp_table_read(delta_rows(df, self.anchor, self.mark(ANCHOR)), name, self.read_time), None
