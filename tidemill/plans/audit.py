"""The audit log: one append-only table of events, and the questions it answers."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import types as T

from ..functions.columns import SOURCE
from ..sources.store import Store

VERSION = "0.1.0"
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("__uuid", "__workflow_id", "__workflow_run_id", "__task_key", "__task_run_id", "__engine_version")]
    + [T.StructField("time_stamp", T.TimestampType(), False), T.StructField("type", T.StringType(), False)]
    + [T.StructField(n, T.StringType()) for n in ("catalog", "schema", "table")]
    + [T.StructField("name", T.StringType(), False), T.StructField("source", T.StringType(), False), T.StructField("total", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("description", "metadata")]
)
KPIS = ("rows_appended", "rows_overwritten", "rows_upserted", "rows_historized", "rows_retired", "rows_exported")


@dataclass(frozen=True)
class Identity:
    workflow_id: str = "local"
    workflow_run_id: str = "local"
    task_key: str = "local"
    task_run_id: str = "local"


@dataclass
class Audit:
    """Buffers events and appends them on ``flush``. Every event is printed when it is logged."""

    store: Store
    env: str
    identity: Identity = Identity()
    target: tuple[str | None, str | None, str | None] = (None, None, None)
    echo: bool = False
    rows: list[tuple] = field(default_factory=list)

    @property
    def name(self) -> str:
        return f"monitoring_{self.env}.audit.ENGINE_LOGS"

    def log(self, level: str, name: str, source: str, *, total: int | None = None, description: str | None = None, metadata: dict | None = None) -> None:
        i = self.identity
        row = (uuid.uuid4().hex, i.workflow_id, i.workflow_run_id, i.task_key, i.task_run_id, VERSION, datetime.now(UTC), level, *self.target, name, source, total, description, json.dumps(metadata) if metadata is not None else None)
        self.rows.append(row)
        if self.echo:
            print(level, name, source, total, description)

    def kpi(self, name: str, total: int) -> None:
        self.log("KPI", name, "verb", total=total)

    def flush(self) -> None:
        if not self.rows:
            return
        rows, self.rows = self.rows, []
        df = self.store.spark.createDataFrame(rows, SCHEMA).coalesce(1)
        table = self.store.table(self.name)
        for attempt in range(20):
            try:
                table.write(df, "APPEND")
                return
            except Exception as e:
                if type(e).__name__ != "ConcurrentWrite" or attempt == 19:
                    self.rows = rows + self.rows
                    raise

    def step(self, batch, verb: str, mode: str, version: int, feed: str = "updates") -> None:
        """One record per source of a committed step, written at once."""
        for r in batch.select(SOURCE).distinct().orderBy(SOURCE).collect():
            self.log("INFO", "step_promoted", "verb", total=version, metadata={"verb": verb, "mode": mode, "feed": feed, "source": r[0], "version": version})
        self.flush()


def state_on_date_sql(log: str, catalog: str, schema: str, table: str, as_of: str) -> str:
    """The steps that built a target as it stood at a time, in the order to apply them: the latest REPLACE, then all after it."""
    return f"""
        with steps as (
            select cast(get_json_object(metadata, '$.version') as bigint) as version,
                   get_json_object(metadata, '$.mode') as mode,
                   get_json_object(metadata, '$.feed') as feed,
                   get_json_object(metadata, '$.source') as source,
                   time_stamp as processed_at
            from {log}
            where name = 'step_promoted' and catalog = '{catalog}' and `schema` = '{schema}' and `table` = '{table}'
              and time_stamp <= timestamp '{as_of}'
        )
        select * from steps
        where version >= (select coalesce(max(version), -1) from steps where mode = 'REPLACE')
        order by version, feed desc, source"""


def rollback_sql(log: str, catalog: str, schema: str, table: str, source: str) -> str:
    """The version to restore so that the target stands as before a source's first step; null if that run made the table."""
    return f"""
        with mine as (
            select __task_run_id as run, name, total, get_json_object(metadata, '$.source') as source
            from {log}
            where catalog = '{catalog}' and `schema` = '{schema}' and `table` = '{table}'
        ),
        first_step as (
            select min_by(run, total) as run, min(total) as version
            from mine where name = 'step_promoted' and source = '{source}'
        )
        select coalesce(
            max(case when mine.name = 'step_promoted' and mine.total < first_step.version then mine.total end),
            max(case when mine.name = 'promotion_start' then mine.total end)) as restore_version
        from mine join first_step on mine.run = first_step.run"""
