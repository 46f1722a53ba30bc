"""From what a source delivers to rows with provenance: names, renames, types, hash, anchor, envelope."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ANCHOR, EXPORT_DATE, RECORD_HASH, SOURCE, is_own
from ..functions.values import as_timestamp, export_stamp, record_hash
from .errors import PlatformViolation

UNSAFE = re.compile(r"[ ,;{}()\n\t=./]")
RESCUED = "_rescued_data"


def q(name: str):
    return F.col(f"`{name}`")


def add_provenance(df: DataFrame, pattern: str = "datetime") -> DataFrame:
    """Source file and export time of rows just read from files."""
    path = F.col("_metadata.file_path")
    return df.select("*", F.concat(F.lit("FILE:"), path).alias(SOURCE), export_stamp(path, pattern).alias(EXPORT_DATE))


def stamp_table_read(df: DataFrame, name: str, read_time) -> DataFrame:
    """One source and export time for all rows of a table that carries none."""
    return df.select("*", F.lit(f"TABLE:{name}@{read_time.isoformat()}").alias(SOURCE), F.lit(read_time).cast("timestamp").alias(EXPORT_DATE))


def reject_unstamped(df: DataFrame) -> None:
    bad = df.where(F.col(EXPORT_DATE).isNull()).select(SOURCE).first()
    if bad:
        raise PlatformViolation("unstamped_file", f"no export time in the name of {bad[0]}")


def sanitize(df: DataFrame) -> DataFrame:
    """Upper-case names without characters that a table cannot carry; the reader's rescue column goes."""
    return df.select(*[q(c).alias(c if is_own(c) else UNSAFE.sub("_", c).upper()) for c in df.columns if c != RESCUED])


def rename(df: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Apply (regex, replacement) pairs in order to every name that is not the engine's."""

    def new(name: str) -> str:
        if is_own(name):
            return name
        for regex, to in patterns:
            name = re.sub(regex, to, name)
        return name

    return df.select(*[q(c).alias(new(c)) for c in df.columns])


def column_order(df: DataFrame, first: list[str]) -> DataFrame:
    """Configured columns, then the others, then the engine's."""
    rest = [c for c in df.columns if c not in first]
    return df.select(*[q(c) for c in [*first, *[c for c in rest if not is_own(c)], *[c for c in rest if is_own(c)]]])


@dataclass(frozen=True)
class Cast:
    column: str
    target: str | None = None  # None: named for order or comment only
    layout: str | None = None


def cast_columns(df: DataFrame, casts: list[Cast], validate: bool = True) -> DataFrame:
    """Declared types; a value that was there and becomes null stops the batch, with one example per column."""
    if missing := [c.column for c in casts if c.column not in df.columns]:
        raise ValueError(f"configured columns are not in the batch: {', '.join(missing)}")
    typed = {c.column: _typed(c) for c in casts if c.target}
    if validate and (bad := silent_nulls(df, casts)):
        shown = "; ".join(f"{c}={v!r}" for c, v in bad.items())
        raise PlatformViolation("cast_silent_null", f"values lost in casts: {shown}", len(bad))
    out = df.select(*[typed[c].alias(c) if c in typed else q(c) for c in df.columns])
    return column_order(out, [c.column for c in casts])


def _typed(c: Cast):
    target = c.target.lower()
    if c.layout and target == "timestamp":
        return F.try_to_timestamp(q(c.column).cast("string"), F.lit(c.layout))
    if c.layout and target == "date":
        return F.try_to_timestamp(q(c.column).cast("string"), F.lit(c.layout)).cast("date")
    return q(c.column).try_cast(c.target)


def silent_nulls(df: DataFrame, casts: list[Cast]) -> dict[str, str]:
    """Per column the first value that a cast would lose, in one pass."""
    checked = [c for c in casts if c.target and c.target.lower() != "string"]
    if not checked:
        return {}
    lost = lambda c: F.when((F.trim(q(c.column).cast("string")) != "") & _typed(c).isNull(), q(c.column).cast("string"))
    row = df.agg(*[F.first(lost(c), ignorenulls=True).alias(c.column) for c in checked]).first()
    return {c.column: row[c.column] for c in checked if row[c.column] is not None}


def stamp_record_hash(df: DataFrame, from_table: bool) -> DataFrame:
    """The hash travels with rows of a table that has it; it is computed for all others."""
    return df if from_table and RECORD_HASH in df.columns else df.withColumn(RECORD_HASH, record_hash(df))


def stamp_anchor(df: DataFrame, column: str, layout: str | None = None) -> tuple[DataFrame, int]:
    """Copy the record's own date into the anchor; returns also how many rows have none."""
    if column not in df.columns:
        raise PlatformViolation("anchor_column_missing", f"no column {column} in the batch")
    kind = df.schema[column].dataType
    value = as_timestamp(q(column), kind, layout)
    given = q(column).isNotNull() & (F.trim(q(column).cast("string")) != "")
    row = df.agg(
        F.first(F.when(given & value.isNull(), q(column).cast("string")), ignorenulls=True).alias("bad"),
        F.count(F.when(given & value.isNull(), 1)).alias("n_bad"),
        F.count(F.when(~F.coalesce(given, F.lit(False)), 1)).alias("missing"),
    ).first()
    if row["n_bad"]:
        raise PlatformViolation("anchor_unparseable", f"{row['n_bad']} values of {column} are no times, e.g. {row['bad']!r}", row["n_bad"])
    return df.withColumn(ANCHOR, value), row["missing"]


def record_envelope(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per item of a delivery ``{metadata: {export_date}, data: [...]}``.

    The named fields become columns, the whole item stays as JSON text in DATA, the
    envelope's date (its first 14 digits) becomes EXPORT_DATE. Text and typed columns
    are understood; other columns are carried along.
    """
    names = {c.lower(): c for c in df.columns}
    meta, data = (q(names[n]) for n in ("metadata", "data"))
    as_text = lambda name, c: c if isinstance(df.schema[names[name]].dataType, T.StringType) else F.to_json(c, {"ignoreNullFields": "false"})
    digits = F.regexp_replace(F.get_json_object(as_text("metadata", meta), "$.export_date"), "[^0-9]", "")
    others = [q(c) for c in df.columns if c.lower() not in ("metadata", "data")]
    items = df.select(*others, F.explode(F.from_json(as_text("data", data), "array<string>")).alias("DATA"), F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss")).alias("EXPORT_DATE"))
    lifted = [F.get_json_object("DATA", f"$.{f}").alias(f.upper()) for f in fields]
    return items.select(*lifted, "DATA", "EXPORT_DATE", *others)


#: Transforms a task may name in ``source.preprocessors``: (frame, source settings) -> frame.
PREPROCESSORS: dict[str, Callable] = {"record_envelope": lambda df, source: record_envelope(df, source.envelope_fields)}
