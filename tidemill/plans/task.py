"""Run a task: read an increment, shape it, gate it, write it with one verb, and keep the record of all that."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CURRENT, EXPORT_DATE, MODIFIED
from ..operators import batch as B
from ..operators import merges as M
from ..operators import shape as S
from ..operators.errors import ConfigError, PlatformViolation, PolicyViolation
from ..sources.files import READERS, KnownColumns, inbound_glob
from ..sources.store import Files, Store, Table
from ..sources.tables import TableReader
from ..streaming.discovery import drain
from . import config as C
from .audit import Audit
from .layout import apply_layout, apply_metadata

KPI = {"append": "rows_appended", "full": "rows_overwritten", "upsert": "rows_upserted", "scd2": "rows_historized", "complete_delta": "rows_historized"}


@dataclass(frozen=True)
class Context:
    """Everything a task needs, resolved before any data is read."""

    spark: SparkSession
    config: C.TaskConfig
    store: Store
    audit: Audit
    target: Table
    strategy: str
    read_time: datetime
    checks: list[B.Check]
    table_config: C.TableConfig | None

    @property
    def state(self) -> str:
        """Where the task keeps what it remembers between runs."""
        return f"{self.config.metadata_path.rstrip('/')}/{self.target.name}"

    @property
    def evolve(self) -> bool:
        return self.config.schema_evolution.startswith("add_new_columns")


def read_text(spark: SparkSession, path: str) -> str:
    io = Files(spark, path)
    if not io.exists(path):
        raise FileNotFoundError(path)
    return io.read(path)


def build_context(spark: SparkSession, warehouse: str, flat: dict, echo: bool = False) -> Context:
    config, identity, absent = C.load_config(flat)
    store = Store(spark, warehouse)
    catalog = f"{config.catalog}_{config.env}"
    out = config.output
    home = f"{warehouse.rstrip('/')}/{catalog}/"
    if not f"{config.metadata_path.rstrip('/')}/".startswith(home):
        raise ConfigError([f"metadata_path must lie below {home}, with the tables whose reading it remembers"])
    audit = Audit(store, config.env, identity, (catalog, out.schema_name, out.table), echo)
    if absent:
        audit.log("WARNING", "run_identity_missing", "start", description=", ".join(absent))
    return Context(
        spark,
        config,
        store,
        audit,
        store.table(f"{catalog}.{out.schema_name}.{out.table}"),
        config.source.increment_strategy or C.VERBS[out.verb].strategies[0],
        datetime.now(UTC),
        C.load_ruleset(read_text(spark, config.policies.checks_file)) if config.policies.checks_file else [],
        C.load_table_config(read_text(spark, config.table_config)) if config.table_config else None,
    )


# ---------------------------------------------------------------- one batch
def prepare(ctx: Context, df: DataFrame) -> DataFrame:
    s = ctx.config.source
    for name in s.preprocessors:
        df = S.PREPROCESSORS[name](df, s)
    df = S.rename(S.sanitize(df), C.rename_pairs(s.rename_patterns))
    if ctx.table_config:
        df = S.cast_columns(df, ctx.table_config.casts, ctx.config.typing.validate_casts)
    df = S.stamp_record_hash(df, s.origin == "table")
    if s.origin != "table" and s.anchor_dt.column:
        df, missing = S.stamp_anchor(df, s.anchor_dt.column, s.anchor_dt.format)
        if missing:
            ctx.audit.log("WARNING", "anchor_missing", "pipeline", total=missing)
    return df


def gate(ctx: Context, df: DataFrame, by: str | None = None) -> None:
    """Counts failing rows of every check in one job, of each snapshot by itself with ``by``; an error stops the batch before anything is written."""
    if not ctx.checks:
        return
    found = B.evaluate(df, ctx.checks, by).collect()
    for r in sorted(found, key=lambda r: (str(r[by]) if by else "", r["name"])):
        ctx.audit.log("ERROR" if r["criticality"] == "error" else "WARNING", r["name"], "policies", total=r["failed"], description=r["message"])
    if not found:
        ctx.audit.log("INFO", "policies_passed", "policies")
    if bad := [r for r in found if r["criticality"] == "error"]:
        raise PolicyViolation("; ".join(f"{r['name']}: {r['failed']} rows ({r['message']})" for r in bad))


def gate_and_write(ctx: Context, df: DataFrame, batch_id: tuple[str, int] | None = None, deletes: DataFrame | None = None) -> None:
    out, need = ctx.config.output, C.VERBS[ctx.config.output.verb]
    if batch_id and ctx.target.exists() and ctx.target.has_batch(batch_id):
        return  # committed before, but not yet remembered by the stream
    if ctx.config.source.origin != "table":
        S.reject_unstamped(df)
    df = prepare(ctx, df)
    if need.keys:
        times = {"output.event_time": out.event_time.time()} if out.event_time.column else {}
        if out.dedup.enabled and out.dedup.order_by:
            times["output.dedup.order_by"] = B.Time(out.dedup.order_by, out.dedup.order_by_format)
        B.require_valid_times(df, times)
        if out.dedup.enabled:
            order = times.get("output.dedup.order_by") or out.event_time.time()
            df = B.latest_per_key(df, out.dedup.columns or out.keys, order, need.per_snapshot)
    df = df.withColumn(MODIFIED, F.lit(ctx.read_time).cast("timestamp")).persist()
    try:
        if not need.per_snapshot:
            gate(ctx, df)
        WRITERS[out.verb](ctx, df, batch_id, deletes)
    finally:
        df.unpersist()
    if ctx.target.exists():
        apply_layout(ctx.target, need.layout, out.keys)
        if apply_metadata(ctx.target, ctx.table_config):
            ctx.audit.log("INFO", "table_metadata_applied", "output")


# ---------------------------------------------------------------- verbs on the store
def _target(ctx: Context, df: DataFrame) -> DataFrame | None:
    if not ctx.target.exists():
        M.require_creatable(df)
        return None
    target = ctx.target.read()
    M.require_no_new_columns(target, df, ctx.evolve)
    return target


def _written(ctx: Context) -> dict:
    """Counts the rows that this run wrote, as it writes them."""
    return {"new": F.col(MODIFIED) == F.lit(ctx.read_time).cast("timestamp")}


def _touched(ctx: Context, target: DataFrame | None, *batches: tuple[DataFrame, list[str]]) -> tuple[DataFrame | None, list[dict]]:
    """The part of the target that a merge must rewrite, and the files that stay."""
    if target is None:
        return None, []
    keys = ctx.config.output.keys
    wanted = None
    for df, own in batches:
        part = df.select(*[S.q(o).alias(k) for k, o in zip(keys, own, strict=True)])
        wanted = part if wanted is None else wanted.unionByName(part)
    return ctx.target.touched(wanted, keys)


def write_append(ctx, df, batch_id, deletes):
    _target(ctx, df)
    c = ctx.target.write(df, "APPEND", batch=batch_id)
    ctx.audit.kpi("rows_appended", c.metrics["rows_written"])
    if c.metrics["rows_written"]:
        ctx.audit.step(df, "append", "APPEND", c.version)


def write_full(ctx, df, batch_id, deletes):
    if df.isEmpty():
        ctx.audit.log("WARNING", "full_skipped_empty", "output")
        return
    newest = B.newest_export(df)
    target = _target(ctx, df)
    if target is not None and (held := B.newest_export(target)) is not None and newest < held:
        ctx.audit.log("WARNING", "full_skipped_older", "output", description=f"{newest} < {held}")
        return
    rows = B.of_export(df, newest)
    c = ctx.target.write(rows, "OVERWRITE", batch=batch_id)
    ctx.audit.kpi("rows_overwritten", c.metrics["rows_written"])
    ctx.audit.step(rows, "full", "REPLACE", c.version)


def write_upsert(ctx, df, batch_id, deletes):
    out, target = ctx.config.output, _target(ctx, df)
    M.require_single_match(df, out.keys)
    met, keep = _touched(ctx, target, (df, out.keys))
    new = M.upsert(met, df, out.keys, out.event_time.time() if out.event_time.column else None)
    c = ctx.target.write(new, "MERGE" if target is not None else "CREATE", batch=batch_id, counted=_written(ctx), keep=keep)
    ctx.audit.kpi("rows_upserted", c.metrics["new"])
    if c.metrics["new"]:
        ctx.audit.step(df, "upsert", "MERGE", c.version)


def write_scd2(ctx, df, batch_id, deletes):
    out, target, time = ctx.config.output, _target(ctx, df), ctx.config.output.event_time.time()
    if df.isEmpty() and target is not None:
        ctx.audit.log("INFO", "scd2_skipped_empty", "output")
        return
    M.require_single_match(df, out.keys)
    met, keep = _touched(ctx, target, (df, out.keys))
    c = ctx.target.write(M.scd2(met, df, out.keys, time), "MERGE" if target is not None else "CREATE", batch=batch_id, counted=_written(ctx), keep=keep)
    ctx.audit.kpi("rows_historized", c.metrics["new"])
    ctx.audit.step(df, "scd2", "MERGE", c.version)


def write_complete_delta(ctx, df, batch_id, deletes):
    """All snapshots, updates before deletes, in one commit; every snapshot passes the gate before.

    Step records follow the commit, so a run that dies before it records nothing,
    and one that dies after it has changed all that its records say.
    """
    out, time = ctx.config.output, ctx.config.output.event_time.time()
    d_time = out.deletes.event_time.time() if deletes is not None else None
    if deletes is not None:
        B.require_valid_times(deletes, {"output.deletes.event_time": d_time})
        deletes = deletes.persist()
    try:
        full, newest = out.snapshot_scope == "full", None
        if full and (newest := B.newest_export(df)) is not None:
            df = B.of_export(df, newest)
            deletes = deletes.where(F.col(EXPORT_DATE) >= F.lit(newest)) if deletes is not None else None
        stamps = B.snapshots(df, deletes)
        ctx.audit.log("INFO", "snapshots_to_replay", "verb", total=len(stamps))
        gate(ctx, df, EXPORT_DATE)
        if not stamps:
            if not ctx.target.exists():
                M.require_creatable(df)
                ctx.target.create(M.opened(df, time).schema)
            return
        target = _target(ctx, df)
        M.require_single_match(df, [*out.keys, EXPORT_DATE])
        if deletes is not None:
            M.require_single_match(deletes, [*out.deletes.keys, EXPORT_DATE])
        if full:
            keep = []  # keys that the snapshot omits are anywhere
            new = _full_scope(ctx, target, df, newest, deletes, d_time, stamps)
        else:
            parts = [(df, out.keys)] + ([(deletes, out.deletes.keys)] if deletes is not None else [])
            met, keep = _touched(ctx, target, *parts)
            new = M.replayed(df, out.keys, time, deletes, d_time, met, out.deletes.keys or None, marks=True)
        c = ctx.target.write(
            new, "MERGE" if target is not None else "CREATE", batch=batch_id, counted={"new": F.col(M.NEW), "retired": F.col(M.RETIRED)}, keep=keep
        )
        ctx.audit.kpi("rows_historized", c.metrics["new"])
        if c.metrics["new"] or full and newest is not None:
            ctx.audit.step(df, "complete_delta", "REPLACE" if full else "MERGE", c.version)
        if deletes is not None:
            ctx.audit.kpi("rows_retired", c.metrics["retired"])
            if c.metrics["retired"]:
                ctx.audit.step(deletes, "complete_delta", "MERGE", c.version, "deletes")
    finally:
        if deletes is not None:
            deletes.unpersist()


def _full_scope(ctx, target, df, newest, deletes, d_time, stamps) -> DataFrame:
    """The newest snapshot against the whole target, then the deletes from it on."""
    out, time, none = ctx.config.output, ctx.config.output.event_time.time(), F.lit(False)
    wrote = F.col(MODIFIED) == F.lit(ctx.read_time).cast("timestamp")
    if newest is not None:
        new = M.scd2(target, df, out.keys, time, newest if target is not None else None)
    else:
        new = target if target is not None else M.opened(df, time)
    new = new.withColumns({M.NEW: wrote, M.RETIRED: none})
    for s in stamps if deletes is not None else []:
        was = new.withColumn("__mark_was", F.col(CURRENT))
        new = M.soft_delete(was, B.of_export(deletes, s), out.keys, out.deletes.keys, d_time)
        new = new.withColumn(M.RETIRED, F.col(M.RETIRED) | ((F.col("__mark_was") == "Y") & (F.col(CURRENT) == "N"))).drop("__mark_was")
    return new


WRITERS = {"append": write_append, "full": write_full, "upsert": write_upsert, "scd2": write_scd2, "complete_delta": write_complete_delta}


# ---------------------------------------------------------------- a run
def _consumed(ctx: Context, source: str) -> tuple[str, int]:
    """Where the version last read of a source is kept, and that version (-1: nothing read yet)."""
    folder = f"{ctx.state}/consumed/{source}"
    names = Files(ctx.spark, ctx.state).names(folder)
    return folder, max((int(n) for n in names if n.isdigit()), default=-1)


def ingest(ctx: Context) -> None:
    s = ctx.config.source
    if s.origin != "table":
        glob = inbound_glob(s.path, s.directory, s.file_extension or s.origin)
        known = KnownColumns(ctx.spark, f"{ctx.state}/schema", ctx.config.schema_evolution)

        def handle(paths: list[str], batch_id: tuple[str, int]) -> None:
            df = READERS[s.origin](ctx.spark, paths, vars(s.options), s.snapshot_time_pattern)
            gate_and_write(ctx, known.apply(df), batch_id)

        drain(ctx.spark, glob, f"{ctx.state}/checkpoint", handle)
        return
    catalog = f"{s.catalog or ctx.config.catalog}_{ctx.config.env}"
    name = f"{catalog}.{s.schema_name}.{s.table}"
    folder, last = _consumed(ctx, name)
    reader = TableReader(ctx.store, ctx.strategy, ctx.target, ctx.read_time, s.anchor_dt.column, s.increment_anchor, lambda: last)
    df, version = reader.read(name)
    deletes = reader.read(f"{catalog}.{s.schema_name}.{s.deletes_table}")[0] if s.deletes_table else None
    if ctx.strategy == "checkpoint" and version == last:
        return
    gate_and_write(ctx, df, (f"{ctx.state}<{name}", version) if version is not None else None, deletes)
    if version is not None:
        Files(ctx.spark, ctx.state).publish(f"{folder}/{version}", "")


def run_task(spark: SparkSession, warehouse: str, flat: dict, echo: bool = False) -> Context:
    """Run one task from its flat settings; the audit table has the story, whatever happens."""
    ctx = build_context(spark, warehouse, flat, echo)
    ctx.audit.log("INFO", "pipeline_start", "run", metadata={k: str(v) for k, v in flat.items()})
    ctx.audit.log("INFO", "promotion_start", "run", total=ctx.target.version)
    ctx.audit.flush()  # a log that cannot be written stops the run before it changes anything
    try:
        ingest(ctx)
        ctx.audit.log("INFO", "pipeline_complete", "run")
    except BaseException as e:
        cause = e
        if isinstance(e, PlatformViolation):
            ctx.audit.log("ERROR", e.policy, "platform", total=e.total, description=str(e))
        ctx.audit.log("ERROR", "pipeline_failure", "run", description=f"{type(cause).__name__}: {cause}"[:4000])
        raise
    finally:
        ctx.audit.flush()
    return ctx


def parse_argv(argv: list[str]) -> dict[str, str]:
    """Settings from ``--key=value`` arguments; whatever else a launcher passes is not ours."""
    pairs = (a.removeprefix("--").partition("=") for a in argv if a.startswith("--"))
    return {key: value for key, eq, value in pairs if eq and key}


def main() -> None:
    flat = parse_argv(sys.argv[1:])
    warehouse = flat.pop("warehouse")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run_task(spark, warehouse, flat, echo=True)


if __name__ == "__main__":
    main()
