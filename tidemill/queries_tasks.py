"""Registered queries over whole tasks: what runs leave in tables, files and the audit log.

Each one runs tasks or operators on the given tables and returns what came of it;
the SQL computes the same from the tables alone.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.columns import ANCHOR, EXPORT_DATE, MODIFIED, RECORD_HASH, SOURCE
from .operators import batch as B
from .operators import merges as M
from .operators import shape as S
from .operators.errors import ConfigError, PlatformViolation, PolicyViolation
from .plans import audit, layout
from .plans import config as C
from .plans.export import listed, read_csv, run_export
from .plans.task import parse_argv
from .queries import DELETED_SQL, HALVES_SQL, REPLAY_SQL, TIME, _placed, _task, feed, halves, history, query, scratch, table
from .sources.files import READERS
from .sources.store import Files, Store
from .sources.tables import TableReader, delta_rows, kind_of, require_kind


def rows(spark, got: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(got, schema)


def values(rows_: list[tuple], names: str) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows_)}) t({names})"


def _sql(v) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def log(ctx) -> DataFrame:
    return ctx.store.table(ctx.audit.name).read()


def events(ctx, *names: str) -> DataFrame:
    return log(ctx).where(F.col("name").isin(*names)).select("name", F.col("total").cast("long").alias("total"))


def write_text(spark, path: str, text: str) -> str:
    Files(spark, path).fs.mkdirs(Files(spark, path).path(path.rsplit("/", 1)[0]))
    Files(spark, path).publish(path, text)
    return path


BRONZE = {"source__origin": "table", "source__schema_name": "bronze", "output__schema_name": "silver"}
SCD2 = {"output__verb": "scd2", "output__keys": "ID", "output__event_time__column": "CHANGED"}


def bronze(spark, root: str, df: DataFrame, name: str = "FEED", catalog: str = "demo_test"):
    t = Store(spark, f"{root}/warehouse").table(f"{catalog}.bronze.{name}")
    t.write(df.withColumn(MODIFIED, F.current_timestamp()), "APPEND")
    return t


# ---------------------------------------------------------------- sources
@query("""select cast(c_custkey as varchar) as C_CUSTKEY, c_name || chr(10) || '"quoted"; ' || c_mktsegment as NOTE,
    case when c_custkey % 2 = 0 then 'EVEN_20240115103000.txt' else 'ODD_20240116103000.TXT' end as file_name from customer""")
def csv_reader_options(spark, d):
    """Delimiter, quotes, line breaks in values, headers of another order, an extension in any case; the file of every row."""
    root = scratch(spark)
    note = F.expr("""concat(c_name, '\n', '"quoted"; ', c_mktsegment)""").alias("note")
    c = table(spark, d, "customer").select("c_custkey", note)
    for name, df in (("EVEN_20240115103000.txt", c.where("c_custkey % 2 = 0")), ("ODD_20240116103000.TXT", c.where("c_custkey % 2 = 1").select("note", "c_custkey"))):
        df.coalesce(1).write.options(header="true", sep=";", quote="'", escape="'", quoteAll="true").csv(f"{root}/raw/{name}")
        _placed(spark, f"{root}/raw/{name}", f"{root}/in/c/{name}")
    ctx = _task(spark, root, source__origin="csv", source__path=f"{root}/in", source__directory="c", source__file_extension=".txt", source__options__delimiter=";", source__options__quote="'", source__options__escape="'", output__verb="append", output__schema_name="bronze", output__table="C")
    return ctx.target.read().select("C_CUSTKEY", "NOTE", F.element_at(F.split(SOURCE, "/"), -1).alias("file_name"))


@query(values([("csv",), ("json",), ("sas",)], "reader"))
def reader_registry(spark, d):
    return rows(spark, [(n,) for n in READERS], "reader string")


@query(values([("NotImplementedError", 0)], "failure, tables_made"))
def sas_source_refused(spark, d):
    root = scratch(spark)
    write_text(spark, f"{root}/in/s/S_20240115103000.sas", "x")
    try:
        _task(spark, root, source__origin="sas", source__path=f"{root}/in", source__directory="s", output__verb="append", output__schema_name="bronze", output__table="S")
    except Exception:
        pass
    store = Store(spark, f"{root}/warehouse")
    failure = store.table("monitoring_test.audit.ENGINE_LOGS").read().where("name = 'pipeline_failure'").first()["description"]
    return rows(spark, [("NotImplementedError" if "NotImplementedError" in failure else failure, int(store.table("demo_test.bronze.S").exists()))], "failure string, tables_made int")


@query("select o_orderkey as ID, o_orderstatus as KIND, case when o_orderkey % 3 = 0 then 1 else 0 end as version from orders")
def checkpoint_read(spark, d):
    """Two appends to a source, a run after each: the second reads what is new."""
    root = scratch(spark)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_orderstatus").alias("KIND"), F.lit("FILE:o").alias(SOURCE), F.lit(datetime(2026, 1, 1)).alias(EXPORT_DATE))
    o = o.withColumn(RECORD_HASH, F.col("KIND"))
    made = []
    for part in ("ID % 3 <> 0", "ID % 3 = 0"):
        bronze(spark, root, o.where(part))
        ctx = _task(spark, root, **BRONZE, source__table="FEED", output__verb="append", output__table="COPY")
        made.append(ctx.target.commit_at().files[-1]["dir"])
    at = F.when(F.col("_metadata.file_path").contains(made[1]), 1).otherwise(0).alias("version")
    return spark.read.parquet(*[f"{ctx.target.path}/data/{m}" for m in made]).select("ID", "KIND", at)


@query(values([("FEED", "stamped"), ("HALF", "malformed"), ("PLAIN", "foreign")], "name, kind"))
def table_classification(spark, d):
    f = feed(spark, d)
    kinds = {"FEED": f.columns, "HALF": f.drop(RECORD_HASH).columns, "PLAIN": table(spark, d, "part").columns}
    return rows(spark, [(n, kind_of(c)) for n, c in kinds.items()], "name string, kind string")


@query(values([("FEED", "table"), ("OTHER", "table"), ("parts_view", "view")], "name, kind"))
def catalog_listing(spark, d):
    root = scratch(spark)
    schema = "listing_" + root.rsplit("/", 1)[1][:8]
    store = Store(spark, root)
    for name in ("FEED", "OTHER"):
        store.table(f"demo_test.{schema}.{name}").write(table(spark, d, "nation"), "APPEND")
    spark.sql(f"create database {schema}")
    spark.sql(f"create view {schema}.parts_view as select 1 as x")
    table(spark, d, "part").createOrReplaceTempView("temporary_parts")
    found = listed(spark, store, "demo_test", schema)
    spark.sql(f"drop database {schema} cascade")
    return rows(spark, sorted(found.items()), "name string, kind string")


# ---------------------------------------------------------------- shape
@query("""select c_custkey as ID, case when c_custkey % 5 <> 0 then timestamp '2024-02-01' + to_days(cast(c_custkey % 28 as integer)) end as anchor,
    (select count(*) from customer where c_custkey % 5 = 0) as missing from customer""")
def anchor_stamp(spark, d):
    text = F.expr("case c_custkey % 10 when 0 then null when 5 then ' ' else date_format(date_add(date'2024-02-01', int(c_custkey % 28)), 'dd.MM.yyyy') end")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ID"), text.alias("CHANGED"))
    out, missing = S.stamp_anchor(c, "CHANGED", "dd.MM.yyyy")
    return out.select("ID", F.col(ANCHOR).cast("timestamp_ntz").alias("anchor"), F.lit(missing).cast("long").alias("missing"))


@query("select s_suppkey as ID, 'kept' || s_suppkey as from_table, sha256(length(cast(s_suppkey as varchar)) || ':' || s_suppkey) as from_file from supplier")
def record_hash_travels(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ID")).withColumn(RECORD_HASH, F.concat(F.lit("kept"), F.col("ID").cast("string")))
    kept = S.stamp_record_hash(s, True).select("ID", F.col(RECORD_HASH).alias("from_table"))
    return kept.join(S.stamp_record_hash(s, False).select("ID", F.col(RECORD_HASH).alias("from_file")), "ID")


@query(values([("record_envelope",)], "preprocessor"))
def preprocessor_registry(spark, d):
    return rows(spark, [(n,) for n in S.PREPROCESSORS], "preprocessor string")


@query(f"""{HALVES_SQL}, bad as (select count(*) as n from events where event_id % 4 = 0)
    {" union all ".join(f"select '{p}' as policy, {t} as total" for p, t in (
        ("unstamped_file", "cast(null as bigint)"), ("anchor_column_missing", "null"), ("anchor_unparseable", "(select n from bad)"),
        ("anchor_not_stamped", "null"), ("anchor_wrong_type", "null"), ("cast_silent_null", "1"), ("empty_source_schema", "null"),
        ("unexpected_columns", "1"), ("event_time_invalid", "(select n from bad)"), ("malformed_table", "null"), ("unstamped_table", "null"),
        ("stamped_table", "null"), ("export_row_count_mismatch", "null")))}""")
def platform_policies(spark, d):
    """Every policy that is always fatal, raised by the operator that guards it."""
    from .plans import export as X

    e = table(spark, d, "events").select(F.col("event_id").alias("ID"), F.when(F.col("event_id") % 4 == 0, "x").otherwise("2024-01-01 00:00:00").alias("AT"), "value")
    f, root = feed(spark, d), scratch(spark)
    source = bronze(spark, root, f)
    target = Store(spark, root).table("demo_test.silver.NONE")
    target.write(table(spark, d, "nation"), "APPEND")
    site = Store(spark, f"{root}/warehouse").table("demo_test.gold.SITE")
    site.write(table(spark, d, "region"), "APPEND")

    def short_file():
        keep = X.digest_and_count
        X.digest_and_count = lambda *a: (keep(*a)[0], 0)
        try:
            run_export(spark, f"{root}/warehouse", {"catalog": "demo", "env": "test", "export.name": "S", "export.schema_name": "gold", "export.preparation_path": f"{root}/prep", "export.stamp_format": "%Y", "export.checksum": "md5", "export.package": "files"})
        except RuntimeError as x:
            if "export_row_count_mismatch" in str(x):
                raise PlatformViolation("export_row_count_mismatch", str(x)) from x
            raise
        finally:
            X.digest_and_count = keep

    raising = [
        lambda: S.reject_unstamped(f.withColumn(EXPORT_DATE, F.lit(None).cast("timestamp"))),
        lambda: S.stamp_anchor(e, "GONE"),
        lambda: S.stamp_anchor(e, "AT", "yyyy-MM-dd HH:mm:ss"),
        lambda: TableReader(source.store, "watermark", target, datetime(2026, 1, 1), by_anchor=True).read(source.name),
        lambda: delta_rows(e, "at", datetime(2026, 1, 1)),
        lambda: S.cast_columns(e, [S.Cast("AT", "timestamp", "yyyy-MM-dd HH:mm:ss"), S.Cast("value", "double")]),
        lambda: M.require_creatable(f.select(SOURCE)),
        lambda: M.require_no_new_columns(f, f.withColumn("NEW_ONE", F.lit(1)), False),
        lambda: B.require_valid_times(e, {"output.event_time": B.Time("AT", "yyyy-MM-dd HH:mm:ss")}),
        lambda: require_kind("T", f.drop(RECORD_HASH).columns, "checkpoint"),
        lambda: require_kind("T", e.columns, "watermark"),
        lambda: require_kind("T", f.columns, "full_read"),
        short_file,
    ]
    got = []
    for run in raising:
        try:
            run()
        except PlatformViolation as x:
            got.append((x.policy, x.total))
    return rows(spark, got, "policy string, total long")


@query(values([("cast_columns", "ValueError"), ("checkpoint after overwrite", "RuntimeError"), ("type of a column", "IncompatibleColumns"), ("two rows of a key", "AmbiguousMerge"), ("no table", "FileNotFoundError")], "what, failure"))
def refusals(spark, d):
    f, root = feed(spark, d), scratch(spark)
    t = Store(spark, root).table("c.s.T")
    t.write(f, "APPEND")
    t.write(f, "OVERWRITE")
    cases = {
        "cast_columns": lambda: S.cast_columns(f, [S.Cast("GONE")]),
        "checkpoint after overwrite": lambda: t.appended_since(0),
        "type of a column": lambda: t.write(f.withColumn("ID", F.lit("text")), "APPEND"),
        "two rows of a key": lambda: M.require_single_match(f.unionByName(f), ["ID", "CHANGED"]),
        "no table": lambda: Store(spark, root).table("c.s.NONE").read(),
    }
    got = []
    for what, run in cases.items():
        try:
            run()
        except Exception as x:
            got.append((what, type(x).__name__))
    return rows(spark, got, "what string, failure string")


# ---------------------------------------------------------------- gate
@query("""select 'LATE' as name, 'ERROR' as level, count(*) as total from customer where c_acctbal < 0
    union all select 'NAMED', 'WARNING', count(*) from customer where c_nationkey > 20
    union all select 'rows in the target', 'INFO', count(*) from customer where c_acctbal >= 0 and c_nationkey <= 20""")
def gate_refusal(spark, d):
    """A first batch passes; a second fails an error check, and the target stays as it was."""
    root = scratch(spark)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_acctbal").alias("BALANCE"), F.col("c_nationkey").alias("NATION"), F.lit("FILE:c").alias(SOURCE), F.lit(datetime(2026, 1, 1)).alias(EXPORT_DATE))
    c = c.withColumn(RECORD_HASH, F.col("ID").cast("string"))
    checks = [{"name": "LATE", "check": {"function": "sql_expression", "arguments": {"expression": "BALANCE >= 0"}}}, {"name": "NAMED", "criticality": "warn", "check": {"function": "is_not_greater_than", "arguments": {"column": "NATION", "limit": 20}}}]
    task = dict(**BRONZE, source__table="FEED", output__verb="append", output__table="GATED", policies__checks_file=write_text(spark, f"{root}/checks.yml", json.dumps(checks)))
    bronze(spark, root, c.where("BALANCE >= 0 and NATION <= 20"))
    ctx = _task(spark, root, **task)
    bronze(spark, root, c.where("not (BALANCE >= 0 and NATION <= 20)"))
    try:
        _task(spark, root, **task)
    except PolicyViolation:
        pass
    found = log(ctx).where("source = 'policies' and name <> 'policies_passed'").select("name", F.col("type").alias("level"), F.col("total").cast("long").alias("total"))
    return found.unionByName(rows(spark, [("rows in the target", "INFO", ctx.target.read().count())], "name string, level string, total long"))


RULE_CASES = {
    "is_not_null": ({"column": "note"}, "note is null"),
    "is_not_empty": ({"column": "note"}, "note = ''"),
    "is_not_null_and_not_empty": ({"column": "note", "trim_strings": True}, "note is null or trim(note) = ''"),
    "is_unique": ({"columns": ["c_nationkey", "c_mktsegment"]}, "n > 1"),
    "is_in_list": ({"column": "c_mktsegment", "allowed": ["BUILDING", "MACHINERY"]}, "c_mktsegment not in ('BUILDING', 'MACHINERY')"),
    "is_in_range": ({"column": "c_acctbal", "min_limit": 0, "max_limit": 5000}, "c_acctbal < 0 or c_acctbal > 5000"),
    "is_not_less_than": ({"column": "c_acctbal", "limit": 100}, "c_acctbal < 100"),
    "is_not_greater_than": ({"column": "c_acctbal", "limit": 100}, "c_acctbal > 100"),
    "regex_match": ({"column": "c_name", "regex": "[05]$"}, "not regexp_matches(c_name, '[05]$')"),
    "is_valid_date": ({"column": "day", "date_format": "yyyy-MM-dd"}, "try_strptime(day, '%Y-%m-%d') is null"),
    "is_valid_timestamp": ({"column": "day", "timestamp_format": "yyyy-MM-dd"}, "try_strptime(day, '%Y-%m-%d') is null"),
    "sql_expression": ({"expression": "c_nationkey < 20"}, "not c_nationkey < 20"),
}
_RULE_ROWS = """(select *, count(*) over (partition by c_nationkey, c_mktsegment) as n, case c_custkey % 4 when 0 then null when 1 then '' when 2 then ' ' else 'x' end as note,
    case when c_custkey % 3 = 0 then '2024-02-30' else '2024-02-28' end as day from customer)"""


@query(" union all ".join(f"select '{name}' as rule, count(*) as failed from {_RULE_ROWS} where {bad}" for name, (_, bad) in RULE_CASES.items()) + " union all select 'gone column', count(*) from customer")
def rule_vocabulary(spark, d):
    c = table(spark, d, "customer").withColumns({"note": F.expr("case c_custkey % 4 when 0 then null when 1 then '' when 2 then ' ' else 'x' end"), "day": F.expr("case when c_custkey % 3 = 0 then '2024-02-30' else '2024-02-28' end")})
    checks = [{"name": n, "check": {"function": n, "arguments": a}} for n, (a, _) in RULE_CASES.items()] + [{"name": "gone column", "check": {"function": "is_not_null", "arguments": {"column": "gone"}}}]
    found = B.evaluate(c, B.load_checks(checks)).select(F.col("name").alias("rule"), "failed")
    every = rows(spark, [(c["name"],) for c in checks], "rule string")
    return every.join(found, "rule", "left").select("rule", F.coalesce("failed", F.lit(0)).cast("long").alias("failed"))


# ---------------------------------------------------------------- verbs through tasks
def _deletes(f: DataFrame) -> DataFrame:
    gone = f.where("ID % 7 = 0").groupBy("ID").agg((F.max(EXPORT_DATE) + F.expr("interval 1 day")).alias("GONE"))
    return gone.select("*", F.lit("FILE:gone").alias(SOURCE), F.col("GONE").alias(EXPORT_DATE), F.lit("h").alias(RECORD_HASH))


def _replayed(spark, d):
    root, f = scratch(spark), feed(spark, d)
    bronze(spark, root, f, catalog="other_test")
    bronze(spark, root, _deletes(f), "GONE", "other_test")
    return _task(spark, root, **BRONZE, source__catalog="other", source__table="FEED", source__deletes_table="GONE", output__verb="complete_delta", output__keys="ID", output__event_time__column="CHANGED", output__deletes__keys="ID", output__deletes__event_time__column="GONE", output__table="FEED")


@query(DELETED_SQL)
def task_deletes_feed(spark, d):
    """Updates and deletes of another catalog, through a task."""
    return history(_replayed(spark, d).target.read())


@query(f"""{REPLAY_SQL}, keys as (select count(distinct ID) as n from feed where ID % 7 = 0)
    select 'rows_historized' as name, count(*) as total from versions union all select 'rows_retired', n from keys
    union all select 'step_promoted', 0 from (values (1), (2)) t(x) union all select 'promotion_start', null
    union all select 'snapshots_to_replay', count(distinct s) from (select x as s from feed union all select max(x) + interval 1 day from feed where ID % 7 = 0 group by ID)""")
def task_deletes_audit(spark, d):
    return events(_replayed(spark, d), "rows_historized", "rows_retired", "step_promoted", "promotion_start", "snapshots_to_replay")


@query(f"""{HALVES_SQL} select 'append' as verb, 'rows_appended' as kpi, 1 as run, count(*) as total from a union all select 'append', 'rows_appended', 2, count(*) from b
    union all select 'full', 'rows_overwritten', 1, count(*) from a where x = (select max(x) from a) union all select 'full', 'rows_overwritten', 2, count(*) from b where x = (select max(x) from b)
    union all select 'upsert', 'rows_upserted', 1, count(*) from a union all select 'upsert', 'rows_upserted', 2, count(*) from b left join a on a.ID = b.ID where a.ID is null or (a.h <> b.h and b.CHANGED > a.CHANGED)
    union all select 'scd2', 'rows_historized', 1, count(*) from a union all select 'scd2', 'rows_historized', 2, count(*) from b left join a on a.ID = b.ID where a.ID is null or (a.h <> b.h and b.CHANGED > a.CHANGED)""")
def task_kpis(spark, d):
    """What every verb says it wrote, for a first batch and a second."""
    root, got = scratch(spark), []
    keyed = {"output__keys": "ID", "output__event_time__column": "CHANGED"}
    verbs = {"append": {}, "full": {}, "upsert": keyed, "scd2": keyed}
    for run, part in enumerate(halves(spark, d), 1):
        bronze(spark, root, part)
        for verb, more in verbs.items():
            ctx = _task(spark, root, **BRONZE, source__table="FEED", output__verb=verb, output__table=verb.upper(), **more)
            kpi = log(ctx).where(f"type = 'KPI' and table = '{verb.upper()}'").orderBy(F.desc("time_stamp")).first()
            got.append((verb, kpi["name"], run, kpi["total"]))
    return rows(spark, got, "verb string, kpi string, run int, total long")


@query(f"{HALVES_SQL} select ID, KIND, cast(null as integer) as EXTRA, false as second_run from a union all select ID, KIND, 7, true from b")
def task_schema_evolution(spark, d):
    """A column that the second batch brings, a type that it widens; when each row was written."""
    root, runs = scratch(spark), []
    a, b = halves(spark, d)
    for part in (a.withColumn("ID", F.col("ID").cast("int")), b.withColumn("EXTRA", F.lit(7))):
        bronze(spark, root, part)
        ctx = _task(spark, root, **BRONZE, source__table="FEED", schema_evolution="add_new_columns_with_type_widening", output__verb="append", output__table="GROWN")
        runs.append(ctx.read_time)
    out = ctx.target.read()
    return out.select("ID", "KIND", "EXTRA", (F.col(MODIFIED) == F.lit(runs[1]).cast("timestamp")).alias("second_run"))


@query(f"{HALVES_SQL} select ID, KIND, CHANGED as valid_from, cast(null as timestamp) as valid_to, 'Y' as is_current, 'N' as is_deleted from a")
def task_rollback(spark, d):
    """Two promotions, then the version to restore for the second one's source, restored."""
    root = scratch(spark)
    for n, part in enumerate(halves(spark, d)):
        bronze(spark, root, part.withColumn(SOURCE, F.lit(f"FILE:half{n}")))
        ctx = _task(spark, root, **BRONZE, source__table="FEED", source__increment_strategy="watermark", output__table="BACK", **SCD2)
    log(ctx).createOrReplaceTempView("task_rollback_log")
    to = spark.sql(audit.rollback_sql("task_rollback_log", "demo_test", "silver", "BACK", "FILE:half1")).first()["restore_version"]
    ctx.target.restore(to)
    return history(ctx.target.read())


@query(values([("APPEND", "FILE:half0", "updates"), ("APPEND", "FILE:half1", "updates")], "mode, source, feed"))
def task_state_on_date(spark, d):
    root = scratch(spark)
    for n, part in enumerate(halves(spark, d)):
        bronze(spark, root, part.withColumn(SOURCE, F.lit(f"FILE:half{n}")))
        ctx = _task(spark, root, **BRONZE, source__table="FEED", output__verb="append", output__table="STATE")
    log(ctx).createOrReplaceTempView("task_state_log")
    return spark.sql(audit.state_on_date_sql("task_state_log", "demo_test", "silver", "STATE", "2999-01-01")).select("mode", "source", "feed")


@query(values([("ID int, KIND string", 0)], "columns, versions_with_rows"))
def task_empty_feed(spark, d):
    """A feed without rows makes an empty history."""
    root = scratch(spark)
    bronze(spark, root, feed(spark, d).limit(0).withColumn("ID", F.col("ID").cast("int")))
    ctx = _task(spark, root, **BRONZE, source__table="FEED", output__verb="complete_delta", output__keys="ID", output__event_time__column="CHANGED", output__table="EMPTY")
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ctx.target.read().schema if f.name in ("ID", "KIND"))
    return rows(spark, [(names, ctx.target.read().count())], "columns string, versions_with_rows int")


# ---------------------------------------------------------------- layout and metadata
@query(values([("comment", "", 'a "feed" isn\'t \\ plain'), ("column", "ID", "the key"), ("column", "__CURRENT_FLAG", "Y if this is the current version of the record, else N."), ("tag table", "pii", "no"), ("tag column KIND", "level", "2"), ("clustering", "", "ID, __CURRENT_FLAG"), ("stats", "", "11"), ("type", "CHANGED", "timestamp")], "kind, name, text"))
def task_table_metadata(spark, d):
    root = scratch(spark)
    bronze(spark, root, halves(spark, d)[0])
    config = {"comment": 'a "feed" isn\'t \\ plain', "tags": {"pii": "no"}, "columns": [{"name": "ID", "comment": "the key"}, {"name": "KIND", "tags": {"level": "2"}}, {"name": "CHANGED", "cast": {"target_type": "timestamp"}}]}
    ctx = _task(spark, root, **BRONZE, source__table="FEED", output__table="META", table_config=write_text(spark, f"{root}/table.yml", json.dumps(config)), **SCD2)
    c = ctx.target.commit_at()
    got = [("comment", "", c.comment), *[("column", n, c.comments[n]) for n in ("ID", "__CURRENT_FLAG")], *[(f"tag {t}", n, v) for t, tags in c.tags.items() for n, v in tags.items()]]
    got += [("clustering", "", ", ".join(c.properties["clustering"])), ("stats", "", str(len(c.properties["stats"]))), ("type", "CHANGED", c.struct["CHANGED"].dataType.simpleString())]
    return rows(spark, got, "kind string, name string, text string")


@query(values([("exports", "__EXPORT_DATE"), ("keys", "ID, __CURRENT_FLAG"), ("none", "")], "layout, columns"))
def layout_kinds(spark, d):
    schema = M.opened(feed(spark, d), TIME).schema
    return rows(spark, [(k, ", ".join(layout.clustering_columns(schema, k, ["id"]))) for k in ("exports", "keys", "none")], "layout string, columns string")


# ---------------------------------------------------------------- export
def _exported(spark, d, **more):
    root = scratch(spark)
    store = Store(spark, f"{root}/warehouse")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(20,10)").alias("PRICE"), F.col("o_orderdate").alias("DAY"), F.col("o_orderdate").cast("timestamp").alias("AT"), F.expr("""case o_orderkey % 3 when 0 then null when 1 then '' else concat('a "b",\n ', o_orderstatus, ' ') end""").alias("NOTE"), F.lit(1).alias("__OWN"))
    store.table("demo_test.gold.ORDERS").write(o, "APPEND")
    store.table("demo_test.gold.NATION").write(table(spark, d, "nation"), "APPEND")
    store.table("demo_test.gold.NOBODY").write(table(spark, d, "region").limit(0), "APPEND")
    flat = {"catalog": "demo", "env": "test", "export.name": "GOLD", "export.schema_name": "gold", "export.preparation_path": f"{root}/prep", "export.stamp_format": "%Y%m%d", "export.checksum": "sha256", "export.package": "files", "export.destination": f"{root}/out", "export.renames.orders.NOTE": "REMARK", "export.excludes.nation": "n_name"}
    out = run_export(spark, f"{root}/warehouse", flat | {k.replace("__", "."): v for k, v in more.items()})
    return root, out, store


@query("""select cast(o_orderkey as varchar) as ID, cast(cast(cast(o_totalprice as decimal(18,2)) as decimal(20,10)) as varchar) as PRICE,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as DAY, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' as AT,
    case o_orderkey % 3 when 0 then null when 1 then '' else 'a "b",' || chr(10) || ' ' || o_orderstatus || ' ' end as REMARK from orders""")
def export_files(spark, d):
    """The file of a table, read back as text."""
    root, _, _ = _exported(spark, d)
    text = read_csv(spark, f"{root}/out/ORDERS.csv", emptyValue="(empty)")
    return text.replace("(empty)", "", ["REMARK"])


@query("""select 'ORDERS' as object, 'table' as object_type, '0' as version, cast(count(*) as varchar) as row_count, 'ORDERS.csv' as export_file_name, true as checksum_matches from orders
    union all select 'NATION', 'table', '0', cast(count(*) as varchar), 'NATION.csv', true from nation""")
def export_manifest(spark, d):
    root, out, _ = _exported(spark, d)
    m = spark.read.option("header", "true").csv(f"{root}/out/{next(n for n in out if n.endswith('_manifest.csv'))}")
    io = Files(spark, root)
    sums = {n: io.digest(f"{root}/out/{n}", "sha256") for n in out if n.endswith(".csv")}
    right = F.col("checksum") == F.create_map(*[F.lit(x) for pair in sums.items() for x in pair])[F.col("export_file_name")]
    return m.select("object", "object_type", "version", "row_count", "export_file_name", right.alias("checksum_matches"))


@query("""select 1 as place, 'NATION.csv' as file, count(*) as row_count from nation union all select 2, 'NATION.csv.sha256', null
    union all select 3, 'ORDERS.csv', count(*) from orders union all select 4, 'ORDERS.csv.sha256', null
    union all select 5, 'manifest', null union all select 6, 'manifest.sha256', null""")
def export_delivery(spark, d):
    """What the audit log says was delivered, in order; an empty table is left out."""
    root, out, store = _exported(spark, d)
    found = store.table("monitoring_test.audit.ENGINE_LOGS").read().where("name = 'file_delivered'")
    got = {r["description"]: json.loads(r["metadata"]) for r in found.collect()}
    named = lambda n: "manifest" + n.split("_manifest.csv")[1] if "_manifest" in n else n
    return rows(spark, [(i, named(n), got[n].get("rows")) for i, n in enumerate(out, 1) if got[n]["location"] == f"{root}/out/{n}"], "place int, file string, row_count long")


@query("select 'GOLD.zip' as file, 2 as files_inside union all select 'GOLD.zip.sha256', null")
def export_zip(spark, d):
    import zipfile

    root, out, _ = _exported(spark, d, export__package="zip", export__with_ts_zip="false", export__with_manifest="false")
    with Files(spark, root).opened(f"{root}/out/GOLD.zip") as f:
        inside = zipfile.ZipFile(f).namelist()
    return rows(spark, [(n, len(inside) if n.endswith(".zip") else None) for n in out], "file string, files_inside int")


@query(values([("unknown column", 1), ("forbidden name", 1), ("no zone", 1), ("everything missing", 8)], "what, problems"))
def export_config_problems(spark, d):
    root = scratch(spark)
    Store(spark, f"{root}/w").table("demo_test.gold.NATION").write(table(spark, d, "nation"), "APPEND")
    good = {"catalog": "demo", "env": "test", "export.name": "GOLD", "export.schema_name": "gold", "export.preparation_path": f"{root}/prep", "export.stamp_format": "%Y", "export.checksum": "md5", "export.package": "files"}
    cases = {"unknown column": good | {"export.excludes.NATION": "gone"}, "forbidden name": good | {"export.name": "A/B"}, "no zone": good | {"export.timezone": "Moon"}, "everything missing": {}}
    got = []
    for what, flat in cases.items():
        try:
            run_export(spark, f"{root}/w", flat)
        except ConfigError as e:
            got.append((what, len(e.problems)))
    return rows(spark, got, "what string, problems int")


# ---------------------------------------------------------------- configuration and audit
FLAT = {
    "catalog": "c", "env": "dev", "metadata_path": "/m", "source.origin": " CSV ", "source.path": "/p", "source.directory": "d", "source.options.header": "False",
    "source.rename_patterns": "__v$=, ^A_=", "output.verb": "Upsert", "output.schema_name": "s", "output.table": "T", "output.keys": "A, B ,", "output.dedup.enabled": " FALSE", "__task_key": "k",
}


@query(values([("source.origin", "csv"), ("source.options.header", "false"), ("output.verb", "upsert"), ("output.keys", "A|B"), ("output.dedup.enabled", "false"), ("source.rename_patterns", "__v$>|^A_>"), ("task_key", "k"), ("absent", "workflow_id|workflow_run_id|task_run_id")], "setting, setting_value"))
def config_values(spark, d):
    c, ids, absent = C.load_config(FLAT)
    pairs = "|".join(f"{a}>{b}" for a, b in C.rename_pairs(c.source.rename_patterns))
    got = {"source.origin": c.source.origin, "source.options.header": str(c.source.options.header).lower(), "output.verb": c.output.verb, "output.keys": "|".join(c.output.keys), "output.dedup.enabled": str(c.output.dedup.enabled).lower(), "source.rename_patterns": pairs, "task_key": ids.task_key, "absent": "|".join(absent)}
    return rows(spark, list(got.items()), "setting string, setting_value string")


BAD = {
    "value and namespace": ({"source": "x"}, 1), "unknown": ({"sorce.path": "x", "output.kees": "y"}, 2), "no bool": ({"source.options.header": "maybe"}, 1),
    "no keys": ({"output.keys": ""}, 1), "no such verb": ({"output.verb": "merge"}, 1), "full scope": ({"output.snapshot_scope": "full"}, 1),
    "strategy": ({"source.increment_strategy": "watermark"}, 1), "envelope": ({"source.envelope_fields": "a"}, 1), "table settings": ({"source.table": "T", "source.schema_name": "s"}, 2),
    "hints": ({"source.options.schema_hints": "a int"}, 1), "case": ({"output.table": "t"}, 1), "deletes": ({"source.origin": "table", "source.deletes_table": "D"}, 5), "regex": ({"source.rename_patterns": "(=x"}, 1),
}


@query(values([(what, n) for what, (_, n) in BAD.items()], "what, problems"))
def config_problems(spark, d):
    """How many problems each configuration has, all told at once."""
    got = []
    for what, (change, _) in BAD.items():
        try:
            C.load_config(FLAT | change)
        except ConfigError as e:
            got.append((what, len(e.problems)))
    return rows(spark, got, "what string, problems int")


VERB_ROWS = [
    ("append", False, False, False, False, False, "checkpoint, full_read, delta_read", "exports"),
    ("full", False, False, False, False, False, "checkpoint, full_read", "none"),
    ("upsert", True, False, False, False, False, "checkpoint, full_read, delta_read", "keys"),
    ("scd2", True, True, False, False, False, "checkpoint, watermark, full_read, delta_read", "keys"),
    ("complete_delta", True, True, True, True, True, "watermark, full_read, delta_read", "keys"),
]


@query(values(VERB_ROWS, "verb, needs_keys, needs_time, deletes, full_scope, per_snapshot, strategies, layout"))
def verb_table(spark, d):
    got = [(v, n.keys, n.event_time, n.deletes, n.full_scope, n.per_snapshot, ", ".join(n.strategies), n.layout) for v, n in C.VERBS.items()]
    return rows(spark, got, "verb string, needs_keys boolean, needs_time boolean, deletes boolean, full_scope boolean, per_snapshot boolean, strategies string, layout string")


@query(values([("a.b", "1"), ("c", "d=e")], "setting, setting_value"))
def command_line(spark, d):
    return rows(spark, list(parse_argv(["--a.b=1", "notebook", "--verbose", "--c=d=e"]).items()), "setting string, setting_value string")


@query(values([("pipeline_start", "INFO"), ("promotion_start", "INFO"), ("run_identity_missing", "WARNING"), ("rows_appended", "KPI"), ("step_promoted", "INFO"), ("table_metadata_applied", "INFO"), ("pipeline_complete", "INFO")], "name, level"))
def audit_of_a_run(spark, d):
    root = scratch(spark)
    bronze(spark, root, feed(spark, d))
    ctx = _task(spark, root, **BRONZE, source__table="FEED", output__verb="append", output__table="LOGGED")
    return log(ctx).select("name", F.col("type").alias("level"))


@query(values([(i, n) for i, n in enumerate(["__uuid", "__workflow_id", "__workflow_run_id", "__task_key", "__task_run_id", "__engine_version", "time_stamp", "type", "catalog", "schema", "table", "name", "source", "total", "description", "metadata"], 1)], "place, name"))
def audit_columns(spark, d):
    root = scratch(spark)
    a = audit.Audit(Store(spark, root), "test")
    a.kpi("rows_appended", 1)
    a.flush()
    return rows(spark, list(enumerate(a.store.table(a.name).read().columns, 1)), "place int, name string")

