"""What a batch goes through before a verb: time checks, latest rows, newest export, snapshots, the quality gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import EXPORT_DATE, RECORD_HASH
from ..functions.rules import RULES, argument_errors, columns_of
from ..functions.values import as_timestamp
from .errors import PlatformViolation
from .shape import q


@dataclass(frozen=True)
class Time:
    """A column to compare by, and its layout if it is text."""

    column: str
    layout: str | None = None

    def of(self, df: DataFrame):
        return as_timestamp(q(self.column), df.schema[self.column].dataType, self.layout)


def require_valid_times(df: DataFrame, times: dict[str, Time]) -> None:
    """Every time that something is compared by must be there and parse: one pass for all of them."""
    checks = []
    for name, t in times.items():
        bad = F.coalesce(F.trim(q(t.column).cast("string")) == "", F.lit(True)) | t.of(df).isNull()
        checks += [F.count(F.when(bad, 1)).alias(f"{name} n"), F.first(F.when(bad, F.coalesce(q(t.column).cast("string"), F.lit("null"))), ignorenulls=True).alias(f"{name} v")]
    if not checks:
        return
    row = df.agg(*checks).first()
    wrong = [f"{n}: {row[f'{n} n']} rows, e.g. {row[f'{n} v']!r}" for n in times if row[f"{n} n"]]
    if wrong:
        raise PlatformViolation("event_time_invalid", "; ".join(wrong), sum(row[f"{n} n"] for n in times))


def latest_per_key(df: DataFrame, keys: list[str], order: Time, per_snapshot: bool = False) -> DataFrame:
    """The latest row of each key (of each key and export): newest time, then newest export, then largest hash."""
    by = [q(k) for k in keys] + ([F.col(EXPORT_DATE)] if per_snapshot else [])
    rank = [order.of(df).desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in (EXPORT_DATE, RECORD_HASH) if c in df.columns]
    rn = F.row_number().over(W.partitionBy(*by).orderBy(*rank))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def newest_export(df: DataFrame):
    return df.agg(F.max(EXPORT_DATE)).first()[0]


def of_export(df: DataFrame, stamp) -> DataFrame:
    """Rows of one export; the literal takes the column's type, so the filter reaches the scan."""
    return df.where(F.col(EXPORT_DATE) == F.lit(stamp).cast(df.schema[EXPORT_DATE].dataType))


def snapshots(*frames: DataFrame | None) -> list:
    """Distinct export times of all frames, oldest first."""
    parts = [f.select(EXPORT_DATE) for f in frames if f is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return [r[0] for r in out.where(F.col(EXPORT_DATE).isNotNull()).distinct().orderBy(EXPORT_DATE).collect()]


# ---------------------------------------------------------------- quality gate
@dataclass(frozen=True)
class Check:
    function: str
    arguments: dict
    criticality: str = "error"
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or "_".join([*map(str, columns_of(self.arguments)), self.function])


def load_checks(entries) -> list[Check]:
    """Checks from parsed YAML; raises ValueError with everything that is wrong. None (an empty file) is no checks."""
    if entries is None:
        return []
    if not isinstance(entries, list):
        raise ValueError("a ruleset is a list of checks")
    out, wrong = [], []
    for i, e in enumerate(entries):
        body = e.get("check") if isinstance(e, dict) else None
        if not isinstance(body, dict) or "function" not in body:
            wrong.append(f"entry {i}: no check.function")
            continue
        f, args, level = body["function"], body.get("arguments") or {}, e.get("criticality", "error")
        if f not in RULES:
            wrong.append(f"entry {i}: unknown function {f}")
        elif problem := argument_errors(f, args):
            wrong.append(f"entry {i}: {f}: {problem}")
        elif level not in ("error", "warn"):
            wrong.append(f"entry {i}: criticality must be error or warn")
        else:
            out.append(Check(f, args, level, e.get("name")))
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def evaluate(df: DataFrame, checks: list[Check], by: str | None = None) -> DataFrame:
    """([by,] criticality, name, message, failed): rows that fail each check, in one job.

    With ``by`` every value of that column is a batch of its own. A check on a
    column the batch lacks counts every row as skipped.
    """
    failures = []
    for c in checks:
        gone = [x for x in columns_of(c.arguments) if x not in df.columns]
        says = lambda m, c=c: F.struct(F.lit(c.criticality).alias("criticality"), F.lit(c.label).alias("name"), F.lit(m).alias("message"))
        if gone:
            failures.append(says(f"skipped: no column {', '.join(gone)}"))
            continue
        arguments = dict(c.arguments)
        if by and c.function == "is_unique":
            arguments["columns"] = [*columns_of(arguments), by]
        failures.append(F.when(RULES[c.function](**arguments), says(f"{c.function} failed")))
    batch = [q(by)] if by else []
    if not failures:
        return df.select(*batch).limit(0).selectExpr("*", *[f"cast(null as {t}) as {n}" for n, t in (("criticality", "string"), ("name", "string"), ("message", "string"), ("failed", "long"))])
    # windows of a check are computed in a projection of their own
    judged = df.select(*batch, *[f.alias(f"f{i}") for i, f in enumerate(failures)])
    names = [f"f{i}" for i in range(len(failures))]
    return (
        judged.select(*batch, F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())).alias("f"))
        .groupBy(*batch, "f.criticality", "f.name", "f.message")
        .agg(F.count("*").alias("failed"))
    )
