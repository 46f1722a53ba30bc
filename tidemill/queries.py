"""Registered queries over the engine's operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.columns import ANCHOR, CURRENT, DELETED, END, EXPORT_DATE, MODIFIED, RECORD_HASH, SOURCE, START
from .functions.values import export_stamp, export_text, record_hash
from .operators import batch as B
from .operators import merges as M
from .operators import shape as S
from .operators.errors import PlatformViolation
from .plans import audit, layout
from .sources.store import Store
from .sources.tables import after, delta_rows, stamp_table_read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors see: below the checkpoint folder, which only a session on one machine may lack."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tidemill-queries"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- feeds
TIME = B.Time("CHANGED")
#: One row per user and week: its latest event; the export follows the week's end, and is the event time too.
FEED_SQL = """
    select user_id as ID, event_type as KIND, stamp as CHANGED, stamp as exported from (
        select *, date_trunc('week', ts) + interval 7 day as stamp,
               row_number() over (partition by user_id, date_trunc('week', ts) order by ts desc, event_id desc) as rn
        from events) where rn = 1"""
HASH_SQL = "sha256(length(cast(ID as varchar)) || ':' || cast(ID as varchar) || case when KIND is null then 'N' else length(KIND) || ':' || KIND end)"
FULL_FEED_SQL = f"""feed as (select ID, KIND, CHANGED, exported as x, {HASH_SQL} as h from ({FEED_SQL}))"""


def feed(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stamped change feed; the hash covers ID and KIND only."""
    last = W.partitionBy("user_id", F.date_trunc("week", "ts")).orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, d, "events").withColumn("rn", F.row_number().over(last)).where("rn = 1")
    stamp = (F.date_trunc("week", "ts") + F.expr("interval 7 days")).cast("timestamp")
    rows = rows.select(F.col("user_id").alias("ID"), F.col("event_type").alias("KIND"), stamp.alias("CHANGED"))
    return rows.select("*", F.lit("FILE:events").alias(SOURCE), F.col("CHANGED").alias(EXPORT_DATE), record_hash(rows.drop("CHANGED")).alias(RECORD_HASH))


def history(df: DataFrame) -> DataFrame:
    """The part of a history that queries compare, with times as stored."""
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return df.select("ID", "KIND", ntz(START).alias("valid_from"), ntz(END).alias("valid_to"), F.col(CURRENT).alias("is_current"), F.col(DELETED).alias("is_deleted"))


# ---------------------------------------------------------------- provenance and shape
def _stamped_names(pattern: str) -> str:
    return f"""
        select o_orderkey, try_strptime(nullif(regexp_extract(name, '{pattern}', 1), ''), '%Y%m%d%H%M%S') as stamped from (
            select o_orderkey, case o_orderkey % 5
                when 0 then strftime(o_orderdate, '%Y%m%d') || '235959'
                when 1 then 'part-' || strftime(o_orderdate, '%Y%m%d') || '000000-v2.json'
                when 2 then 'no_leap_20010229000000.csv'
                when 3 then 'touched_9' || strftime(o_orderdate, '%Y%m%d') || '000000.csv'
                else 'ORDERS.csv' end as name from orders)"""


@query(_stamped_names("(?:^|[^0-9])([0-9]{14})(?:[^0-9]|$)"))
def export_stamp_datetime(spark, d):
    name = F.expr("""case o_orderkey % 5 when 0 then concat(date_format(o_orderdate, 'yyyyMMdd'), '235959')
        when 1 then concat('part-', date_format(o_orderdate, 'yyyyMMdd'), '000000-v2.json') when 2 then 'no_leap_20010229000000.csv'
        when 3 then concat('touched_9', date_format(o_orderdate, 'yyyyMMdd'), '000000.csv') else 'ORDERS.csv' end""")
    path = F.concat(F.lit("/in/20240101000000/"), name)
    return table(spark, d, "orders").select("o_orderkey", export_stamp(path).cast("timestamp_ntz").alias("stamped"))


@query("""
    select o_orderkey, case when o_orderkey % 2 = 0 then cast(date_trunc('day', o_orderdate) + interval '10:30:05' hour to second as timestamp) end as stamped
    from (select o_orderkey, o_orderdate from orders)""".replace("interval '10:30:05' hour to second", "interval 37805 second"))
def export_stamp_iso(spark, d):
    name = F.expr("case when o_orderkey % 2 = 0 then concat('ORDERS_', date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:30:05.csv') else 'ORDERS_20230704120000.csv' end")
    return table(spark, d, "orders").select("o_orderkey", export_stamp(name, "iso").cast("timestamp_ntz").alias("stamped"))


@query('select c_custkey as CUST_KEY_, c_name as CUST_NAME, c_mktsegment as A_B_C from customer')
def sanitize_names(spark, d):
    c = table(spark, d, "customer")
    return S.sanitize(c.select(F.col("c_custkey").alias("cust key "), F.col("c_name").alias("cust/name"), F.col("c_mktsegment").alias("a.b,c"), F.lit("x").alias("_rescued_data")))


@query("select p_partkey as ID, p_name as NAME, p_size as SIZE_NOW from part")
def rename_patterns(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("P_ID__v"), F.col("p_name").alias("P_NAME__V"), F.col("p_size").alias("P_SIZE"))
    return S.rename(p, [("__[vV]$", ""), ("^P_", ""), ("^SIZE$", "SIZE_NOW")])


@query("select s_nationkey, s_name, s_suppkey, s_acctbal from supplier")
def column_order(spark, d):
    return S.column_order(table(spark, d, "supplier"), ["s_nationkey", "s_name"])


def _part_hash(*columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(length({c}) || ':' || {c}, 'N')" for c in columns) + ")"


@query(f"""select o_orderkey, {_part_hash("k", "cust", "prio", "status", "price")} as record_hash from (
    select o_orderkey, cast(o_custkey as varchar) as k, o_orderpriority as cust, o_orderstatus as prio,
           cast(cast(o_totalprice as decimal(18,2)) as varchar) as status, cast(o_orderkey as varchar) as price from orders)""")
def record_hash_orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_orderstatus").alias("c"), F.col("o_totalprice").cast("decimal(18,2)").alias("d"), F.col("o_orderkey").alias("e"))
    return o.select(F.col("e").alias("o_orderkey"), record_hash(o).alias("record_hash"))


@query(f"""select c_custkey, {_part_hash("a", "k")} as record_hash from (select c_custkey, cast(c_custkey as varchar) as k,
    case c_custkey % 3 when 0 then null when 1 then '' else c_name end as a from customer)""")
def record_hash_null_vs_empty(spark, d):
    c = table(spark, d, "customer").select(F.expr("case c_custkey % 3 when 0 then null when 1 then '' else c_name end").alias("a"), F.col("c_custkey").alias("k"))
    return c.select(F.col("k").alias("c_custkey"), record_hash(c).alias("record_hash"))


@query(f"select event_id, {_part_hash('k', 't')} as record_hash from (select event_id, cast(event_id as varchar) as k, cast(epoch_us(ts) as varchar) as t from events)")
def record_hash_timestamp(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("ts").cast("timestamp").alias("t"))
    return e.select(F.col("k").alias("event_id"), record_hash(e).alias("record_hash"))


@query("""select cast(conv_id as varchar) as CONV, role as ROLE, timestamp '2024-01-15 10:30:00' as exported from conversations""")
def record_envelope(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("conv_id").alias("conv"), "role")).alias("items"))
    docs = c.select(F.to_json(F.struct(F.lit("2024-01-15T10:30:00Z").alias("export_date"))).alias("metadata"), F.to_json("items").alias("data"))
    return S.record_envelope(docs, ["conv", "role"]).select("CONV", "ROLE", F.col("EXPORT_DATE").cast("timestamp_ntz").alias("exported"))


# ---------------------------------------------------------------- typing
CASTS = [S.Cast("N", "int"), S.Cast("D", "date", "yyyy-MM-dd"), S.Cast("V", "decimal(10,2)")]


def _untyped(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.expr("case when event_id % 7 = 0 then 'abc' when event_id % 7 = 1 then '' else cast(user_id as string) end").alias("N"),
        F.expr("case when event_id % 11 = 0 then '2024-13-40' else date_format(ts, 'yyyy-MM-dd') end").alias("D"),
        F.col("value").cast("decimal(10,2)").cast("string").alias("V"),
    )


UNTYPED_SQL = """(select event_id, case when event_id % 7 = 0 then 'abc' when event_id % 7 = 1 then '' else cast(user_id as varchar) end as n,
    case when event_id % 11 = 0 then '2024-13-40' else strftime(ts, '%Y-%m-%d') end as dd, cast(cast(value as decimal(10,2)) as varchar) as v from events)"""


@query(f"select try_cast(n as integer) as N, cast(try_strptime(dd, '%Y-%m-%d') as date) as D, cast(v as decimal(10,2)) as V, event_id from {UNTYPED_SQL}")
def typed_cast(spark, d):
    return S.cast_columns(_untyped(spark, d), CASTS, validate=False)


@query(f"""select 'N' as column_name, any_value(n) as example, (select count(*) from (values (1), (2)) t(x)) as columns_lost from {UNTYPED_SQL} where trim(n) <> '' and try_cast(n as integer) is null
    union all select 'D', any_value(dd), 2 from {UNTYPED_SQL} where try_strptime(dd, '%Y-%m-%d') is null""")
def silent_null_report(spark, d):
    raw = _untyped(spark, d)
    try:
        S.cast_columns(raw, CASTS)
    except PlatformViolation as e:
        return spark.createDataFrame([(c, x, e.total) for c, x in S.silent_nulls(raw, CASTS).items()], "column_name string, example string, columns_lost long")


# ---------------------------------------------------------------- latest rows, exports, increments
@query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def dedup_latest(spark, d):
    e = table(spark, d, "events").withColumn(RECORD_HASH, F.lpad(F.col("event_id").cast("string"), 20, "0"))
    return B.latest_per_key(e, ["user_id"], B.Time("ts")).select("user_id", "event_id", "event_type")


@query("""select user_id, event_id, cast(date_trunc('week', ts) as timestamp) as week from (
    select *, row_number() over (partition by user_id, date_trunc('week', ts) order by ts desc, event_id desc) as rn from events) where rn = 1""")
def dedup_per_snapshot(spark, d):
    e = table(spark, d, "events").withColumns({RECORD_HASH: F.lpad(F.col("event_id").cast("string"), 20, "0"), EXPORT_DATE: F.date_trunc("week", "ts")})
    return B.latest_per_key(e, ["user_id"], B.Time("ts"), per_snapshot=True).select("user_id", "event_id", F.col(EXPORT_DATE).cast("timestamp_ntz").alias("week"))


LINE_HASH_SQL = "sha256(length(cast(l_partkey as varchar)) || ':' || l_partkey || length(cast(l_suppkey as varchar)) || ':' || l_suppkey)"


@query(f"""select distinct l_orderkey, l_linenumber, l_shipdate, h from (select l_orderkey, l_linenumber, l_shipdate, {LINE_HASH_SQL} as h,
    row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, {LINE_HASH_SQL} desc) as rn from lineitem) where rn = 1""")
def dedup_lineitem(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    rows = rows.withColumn(RECORD_HASH, record_hash(rows.select("l_partkey", "l_suppkey")))
    out = B.latest_per_key(rows, ["l_orderkey", "l_linenumber"], B.Time("l_shipdate"))
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", F.col(RECORD_HASH).alias("h"))


@query("""select * from (select 'blank' as kind, count(*) as rows_refused from events where event_id % 5 = 0
    union all select 'unparseable', count(*) from events where event_id % 5 = 1 union all select 'both', count(*) from events where event_id % 5 < 2)""")
def event_time_validity(spark, d):
    out = []
    for kind, text in {"blank": "case event_id % 5 when 0 then ' '", "unparseable": "case event_id % 5 when 1 then 'soon'", "both": "case event_id % 5 when 0 then null when 1 then 'soon'"}.items():
        e = table(spark, d, "events").select(F.expr(f"{text} else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end").alias("t"))
        try:
            B.require_valid_times(e, {"output.event_time": B.Time("t", "yyyy-MM-dd HH:mm:ss")})
        except PlatformViolation as x:
            out.append((kind, x.total))
    return spark.createDataFrame(out, "kind string, rows_refused long")


MARK = datetime(1997, 1, 1)


@query("select o_orderkey, o_orderdate from orders where o_orderdate > timestamp '1997-01-01'")
def watermark_read(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderdate", EXPORT_DATE)
    return after(o, EXPORT_DATE, MARK).select("o_orderkey", F.col(EXPORT_DATE).alias("o_orderdate"))


@query("select event_id, ts from events where ts > (select min(ts) + interval 20 day from events)")
def anchored_read(spark, d):
    e = table(spark, d, "events")
    mark = e.agg((F.min("ts") + F.expr("interval 20 days")).alias("m")).first()["m"]
    return after(e.withColumnRenamed("ts", ANCHOR), ANCHOR, mark).select("event_id", F.col(ANCHOR).alias("ts"))


@query("select o_orderkey, o_orderdate as anchor from orders where o_orderdate > timestamp '1997-01-01'")
def delta_read_ts(spark, d):
    return delta_rows(table(spark, d, "orders"), "O_ORDERDATE", MARK).select("o_orderkey", F.col(ANCHOR).cast("timestamp_ntz").alias("anchor"))


@query("select o_orderkey, cast(cast(o_orderdate as date) as timestamp) as anchor from orders where cast(o_orderdate as date) > date '1997-01-01'")
def delta_read_date(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return delta_rows(o, "day", datetime(1997, 1, 1, 15)).select("o_orderkey", F.col(ANCHOR).cast("timestamp_ntz").alias("anchor"))


@query("select s_suppkey, 'TABLE:c.s.t@2026-01-02T03:04:05' as source, timestamp '2026-01-02 03:04:05' as exported from supplier")
def full_read_stamp(spark, d):
    s = stamp_table_read(table(spark, d, "supplier"), "c.s.t", datetime(2026, 1, 2, 3, 4, 5))
    return s.select("s_suppkey", F.col(SOURCE).alias("source"), F.col(EXPORT_DATE).cast("timestamp_ntz").alias("exported"))


# ---------------------------------------------------------------- verbs
SPLIT = "(select min(x) + interval 14 day from feed)"


def halves(spark, d):
    """The feed's first exports and the later ones, one row per key in each."""
    f = feed(spark, d)
    low = f.agg(F.min(EXPORT_DATE).alias("m")).first()["m"]
    cut = F.lit(low) + F.expr("interval 14 days")
    latest = lambda df: B.latest_per_key(df, ["ID"], TIME)
    return latest(f.where(F.col(EXPORT_DATE) <= cut)), latest(f.where(F.col(EXPORT_DATE) > cut))


HALVES_SQL = f"""with {FULL_FEED_SQL},
    ranked as (select *, x <= {SPLIT} as early, row_number() over (partition by ID, x <= {SPLIT} order by CHANGED desc) as rn from feed),
    a as (select * from ranked where rn = 1 and early), b as (select * from ranked where rn = 1 and not early)"""


@query(f"{HALVES_SQL} select ID, KIND, CHANGED from b where not exists (select 1 from a where a.ID = b.ID and (a.h = b.h or a.CHANGED >= b.CHANGED))")
def anti_filter(spark, d):
    a, b = halves(spark, d)
    return M.news(M.opened(a, TIME), b, ["ID"], TIME).select("ID", "KIND", F.col("CHANGED").cast("timestamp_ntz").alias("CHANGED"))


@query(f"{HALVES_SQL} select ID, KIND from a union all select ID, KIND from b")
def append_two(spark, d):
    a, b = halves(spark, d)
    t = Store(spark, scratch(spark)).table("c.s.APPENDED")
    t.write(a, "APPEND")
    t.write(b, "APPEND")
    return t.read().select("ID", "KIND")


@query(f"with {FULL_FEED_SQL} select ID, KIND from feed where x = (select max(x) from feed)")
def full_newest(spark, d):
    return M.newest(feed(spark, d)).select("ID", "KIND")


@query(f"{HALVES_SQL} select ID, KIND from b where x = (select max(x) from b)")
def full_stale_skip(spark, d):
    a, b = halves(spark, d)
    t = Store(spark, scratch(spark)).table("c.s.FULL")
    for batch in (b, a):  # the older export comes late and is skipped
        newest = B.newest_export(batch)
        if not t.exists() or newest >= B.newest_export(t.read()):
            t.write(B.of_export(batch, newest), "OVERWRITE")
    return t.read().select("ID", "KIND")


@query(f"""{HALVES_SQL} select coalesce(a.ID, b.ID) as ID, case when b.ID is null or (a.ID is not null and (a.h = b.h or b.CHANGED <= a.CHANGED)) then a.KIND else b.KIND end as KIND,
    case when b.ID is null or (a.ID is not null and (a.h = b.h or b.CHANGED <= a.CHANGED)) then a.CHANGED else b.CHANGED end as CHANGED from a full join b on a.ID = b.ID""")
def upsert_newer_wins(spark, d):
    a, b = halves(spark, d)
    return M.upsert(a, b, ["ID"], TIME).select("ID", "KIND", F.col("CHANGED").cast("timestamp_ntz").alias("CHANGED"))


@query(f"{HALVES_SQL} select coalesce(a.ID, b.ID) as ID, case when a.ID is null or a.h <> b.h then b.KIND else a.KIND end as KIND, case when b.ID is null or a.h = b.h then a.CHANGED else b.CHANGED end as CHANGED from a full join b on a.ID = b.ID")
def upsert_last_wins(spark, d):
    a, b = halves(spark, d)
    return M.upsert(a, b, ["ID"]).select("ID", "KIND", F.col("CHANGED").cast("timestamp_ntz").alias("CHANGED"))


@query(f"{HALVES_SQL} select ID, KIND, CHANGED from a")
def upsert_unchanged(spark, d):
    a, _ = halves(spark, d)
    later = a.withColumn("CHANGED", F.col("CHANGED") + F.expr("interval 1 day"))
    return M.upsert(a, later, ["ID"], TIME).select("ID", "KIND", F.col("CHANGED").cast("timestamp_ntz").alias("CHANGED"))


@query(f"""{HALVES_SQL}, n as (select * from b where not exists (select 1 from a where a.ID = b.ID and (a.h = b.h or a.CHANGED >= b.CHANGED)))
    select a.ID, a.KIND, a.CHANGED as valid_from, n.CHANGED as valid_to, case when n.ID is null then 'Y' else 'N' end as is_current, 'N' as is_deleted from a left join n on a.ID = n.ID
    union all select ID, KIND, CHANGED, null, 'Y', 'N' from n""")
def scd2_two_batches(spark, d):
    a, b = halves(spark, d)
    return history(M.scd2(M.scd2(None, a, ["ID"], TIME), b, ["ID"], TIME))


@query(f"{HALVES_SQL} select ID, KIND, CHANGED as valid_from, cast(null as timestamp) as valid_to, 'Y' as is_current, 'N' as is_deleted from b union all select ID, KIND, CHANGED, null, 'Y', 'N' from a where ID not in (select ID from b)")
def scd2_late_row(spark, d):
    a, b = halves(spark, d)
    return history(M.scd2(M.scd2(None, b, ["ID"], TIME), a, ["ID"], TIME))


@query(f"{HALVES_SQL} select ID, KIND, CHANGED as valid_from, cast(null as timestamp) as valid_to, 'Y' as is_current, 'N' as is_deleted from a")
def scd2_unchanged(spark, d):
    a, _ = halves(spark, d)
    again = a.withColumn("CHANGED", F.col("CHANGED") + F.expr("interval 3 days"))
    return history(M.scd2(M.scd2(None, a, ["ID"], TIME), again, ["ID"], TIME))


REPLAY_SQL = f"""with {FULL_FEED_SQL}, changed as (select *, lag(h) over (partition by ID order by x) as before from feed),
    versions as (select ID, KIND, CHANGED as valid_from, lead(CHANGED) over (partition by ID order by x) as valid_to from changed where before is null or before <> h)"""


@query(f"{REPLAY_SQL} select *, case when valid_to is null then 'Y' else 'N' end as is_current, 'N' as is_deleted from versions")
def complete_delta_events(spark, d):
    return history(M.replayed(feed(spark, d), ["ID"], TIME))


@query(f"{REPLAY_SQL} select *, case when valid_to is null then 'Y' else 'N' end as is_current, 'N' as is_deleted from versions")
def complete_delta_loop(spark, d):
    f = feed(spark, d)
    out = None
    for i, stamp in enumerate(B.snapshots(f)):
        path = f"{scratch(spark)}/{i}"
        M.scd2(out, B.of_export(f, stamp), ["ID"], TIME).write.parquet(path)
        out = spark.read.parquet(path)
    return history(out)


DELETED_SQL = f"""{REPLAY_SQL}, gone as (select ID, max(x) + interval 1 day as at from feed where ID % 7 = 0 group by ID)
    select v.ID, v.KIND, v.valid_from, case when v.valid_to is null then g.at else v.valid_to end as valid_to,
           case when v.valid_to is null and g.ID is null then 'Y' else 'N' end as is_current, case when g.ID is null then 'N' else 'Y' end as is_deleted
    from versions v left join gone g on v.ID = g.ID"""


@query(DELETED_SQL)
def complete_delta_deletes(spark, d):
    f = feed(spark, d)
    gone = f.where("ID % 7 = 0").groupBy("ID").agg((F.max(EXPORT_DATE) + F.expr("interval 1 day")).alias("GONE")).withColumn(EXPORT_DATE, F.col("GONE"))
    return history(M.replayed(f, ["ID"], TIME, gone, B.Time("GONE")))


@query(DELETED_SQL)
def soft_deletes(spark, d):
    f = feed(spark, d)
    gone = f.where("ID % 7 = 0").groupBy("ID").agg((F.max(EXPORT_DATE) + F.expr("interval 1 day")).alias("GONE"))
    return history(M.soft_delete(M.replayed(f, ["ID"], TIME), gone, ["ID"], ["ID"], B.Time("GONE")))


def _snapshot(spark, d, k: int) -> DataFrame:
    """The customers at export k: a fifth is missing, a third has another balance."""
    at = F.lit(datetime(2024, 1, 1 + k))
    c = table(spark, d, "customer").where(f"c_custkey % 5 <> {k}")
    rows = c.select(F.col("c_custkey").alias("ID"), F.expr(f"cast(cast(c_acctbal as decimal(18,2)) + case when c_custkey % 3 = {k} then {k} else 0 end as string)").alias("KIND"))
    return rows.select("*", at.alias("CHANGED"), F.lit(f"FILE:{k}").alias(SOURCE), at.alias(EXPORT_DATE), record_hash(rows).alias(RECORD_HASH))


SNAPSHOT_SQL = "select c_custkey as ID, cast(cast(c_acctbal as decimal(18,2)) + case when c_custkey % 3 = {k} then {k} else 0 end as varchar) as KIND, {k} as k from customer where c_custkey % 5 <> {k}"


@query(f"""with s as ({" union all ".join(SNAPSHOT_SQL.format(k=k) for k in range(3))}),
    marked as (select *, lag(k) over w as pk, lag(KIND) over w as pkind from s window w as (partition by ID order by k)),
    starts as (select *, sum(case when pk = k - 1 and pkind = KIND then 0 else 1 end) over (partition by ID order by k) as run from marked),
    runs as (select ID, any_value(KIND) as KIND, min(k) as a, max(k) as b from starts group by ID, run)
    select ID, KIND, timestamp '2024-01-01' + to_days(cast(a as integer)) as valid_from, case when b = 2 then null else timestamp '2024-01-01' + to_days(cast(b + 1 as integer)) end as valid_to,
           case when b = 2 then 'Y' else 'N' end as is_current, 'N' as is_deleted from runs""")
def complete_delta_full_scope(spark, d):
    out = None
    for k in range(3):
        s = _snapshot(spark, d, k)
        path = f"{scratch(spark)}/{k}"
        M.scd2(out, s, ["ID"], TIME, datetime(2024, 1, 1 + k)).write.parquet(path)
        out = spark.read.parquet(path)
    return history(out)


@query(f"{REPLAY_SQL} select ID, KIND, valid_from as CHANGED from versions where valid_to is null")
def current_state_view(spark, d):
    return M.current_state(M.replayed(feed(spark, d), ["ID"], TIME)).select("ID", "KIND", F.col("CHANGED").cast("timestamp_ntz").alias("CHANGED"))


# ---------------------------------------------------------------- gate, lineage, layout, export
@query("""select 'error' as criticality, 'is_unique' as rule, count(*) as failed from (select count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) where n > 1
    union all select 'warn', 'is_in_range', count(*) from lineitem where l_quantity > 45
    union all select 'warn', 'is_in_list', count(*) from lineitem where l_returnflag not in ('A', 'N')""")
def gate_counts(spark, d):
    checks = B.load_checks(
        [
            {"criticality": "error", "name": "is_unique", "check": {"function": "is_unique", "arguments": {"columns": ["l_orderkey", "l_linenumber"]}}},
            {"criticality": "warn", "name": "is_in_range", "check": {"function": "is_in_range", "arguments": {"column": "l_quantity", "max_limit": 45}}},
            {"criticality": "warn", "name": "is_in_list", "check": {"function": "is_in_list", "arguments": {"column": "l_returnflag", "allowed": ["A", "N"]}}},
            {"criticality": "error", "name": "not_null", "check": {"function": "is_not_null", "arguments": {"column": "l_orderkey"}}},
        ]
    )
    return B.evaluate(table(spark, d, "lineitem"), checks).select("criticality", F.col("name").alias("rule"), "failed")


STEPS = [(1, "MERGE", "a"), (2, "MERGE", "b"), (4, "REPLACE", "c"), (6, "MERGE", "d"), (6, "MERGE", "e"), (9, "MERGE", "f")]


def _log(spark) -> str:
    rows = [("x",) * 5 + (audit.VERSION, datetime(2026, 1, v), "INFO", "c", "s", "T", "step_promoted", "verb", v, None, f'{{"version": {v}, "mode": "{m}", "feed": "updates", "source": "{s}"}}') for v, m, s in STEPS]
    rows.append(("x",) * 5 + (audit.VERSION, datetime(2026, 1, 1), "INFO", "c", "s", "T", "promotion_start", "run", 0, None, None))
    spark.createDataFrame(rows, audit.SCHEMA).createOrReplaceTempView("engine_log")
    return "engine_log"


@query("select * from (values (4, 'REPLACE', 'c'), (6, 'MERGE', 'd'), (6, 'MERGE', 'e')) t(version, mode, source)")
def steps_state_on_date(spark, d):
    return spark.sql(audit.state_on_date_sql(_log(spark), "c", "s", "T", "2026-01-07")).select(F.col("version").cast("int").alias("version"), "mode", "source")


@query("select 4 as restore_version, 'd' as source union all select 0, 'a'")
def rollback_version(spark, d):
    log = _log(spark)
    one = lambda s: spark.sql(audit.rollback_sql(log, "c", "s", "T", s)).select("restore_version", F.lit(s).alias("source"))
    return one("d").unionByName(one("a"))


@query("select * from (values (1, 'o_orderkey'), (2, 'o_custkey'), (3, '__EXPORT_DATE')) t(place, name)")
def stats_columns(spark, d):
    schema = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.array("o_orderstatus").alias("list"), F.col("o_orderdate").alias(EXPORT_DATE)).schema
    return spark.createDataFrame(list(enumerate(layout.stats_columns(schema, [], 2), 1)), "place int, name string")


@query("select * from (values (1, 'A'), (2, 'B'), (3, 'C'), (4, '__CURRENT_FLAG')) t(place, name)")
def clustering_columns(spark, d):
    schema = spark.createDataFrame([], "A int, B int, C int, D int, __CURRENT_FLAG string").schema
    return spark.createDataFrame(list(enumerate(layout.clustering_columns(schema, "keys", ["a", "b", "c", "d"]), 1)), "place int, name string")


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' as zoned, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as local,
    cast(cast(cast(o_totalprice as decimal(18,2)) as decimal(20,10)) as varchar) as price from orders""")
def export_text_exact(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("zoned"), F.col("o_orderdate").alias("local"), F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(20,10)").alias("price"))
    return o.select(*[export_text(F.col(c), o.schema[c].dataType).alias(c) for c in o.columns])


# ---------------------------------------------------------------- whole tasks
def _task(spark, root: str, **settings):
    from .plans.task import run_task

    return run_task(spark, f"{root}/warehouse", {"catalog": "demo", "env": "test", "metadata_path": f"{root}/warehouse/demo_test/meta"} | {k.replace("__", "."): v for k, v in settings.items()})


@query("select cast(c_custkey as varchar) as C_CUSTKEY, c_name as C_NAME, cast(c_nationkey as varchar) as C_NATIONKEY, timestamp '2024-01-15 10:30:00' as exported from customer")
def stream_csv_to_bronze(spark, d):
    root = scratch(spark)
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").coalesce(1).write.option("header", "true").csv(f"{root}/raw")
    _placed(spark, f"{root}/raw", f"{root}/inbound/customer/CUSTOMER_20240115103000Z.CSV")
    ctx = _task(spark, root, source__origin="csv", source__path=f"{root}/inbound", source__directory="customer", output__verb="append", output__schema_name="bronze", output__table="CUSTOMER")
    return ctx.target.read().select("C_CUSTKEY", "C_NAME", "C_NATIONKEY", F.col(EXPORT_DATE).cast("timestamp_ntz").alias("exported"))


@query("select cast(conv_id as varchar) as CONV_ID, cast(turn as varchar) as TURN, role as ROLE from conversations")
def stream_json_envelope(spark, d):
    root = scratch(spark)
    c = table(spark, d, "conversations").repartition(4 * spark.sparkContext.defaultParallelism, "conv_id")
    items = c.groupBy("conv_id").agg(F.collect_list(F.struct("conv_id", "turn", "role")).alias("data"))
    # a file of one document for each conversation, named and committed by the task that writes it
    named = {"maxRecordsPerFile": 1, "mapreduce.output.basename": "CONV_20240115103000", "mapreduce.fileoutputcommitter.algorithm.version": 2}
    items.select(F.struct(F.lit("20240115103000").alias("export_date")).alias("metadata"), "data").write.options(**named).json(f"{root}/inbound/conv")
    ctx = _task(spark, root, source__origin="json", source__path=f"{root}/inbound", source__directory="conv", source__preprocessors="record_envelope", source__envelope_fields="conv_id, turn, role", output__verb="append", output__schema_name="bronze", output__table="CONV")
    return ctx.target.read().select("CONV_ID", "TURN", "ROLE")


@query(f"{REPLAY_SQL} select *, case when valid_to is null then 'Y' else 'N' end as is_current, 'N' as is_deleted from versions")
def promote_complete_delta(spark, d):
    root = scratch(spark)
    Store(spark, f"{root}/warehouse").table("demo_test.bronze.FEED").write(feed(spark, d).withColumn(MODIFIED, F.current_timestamp()), "APPEND")
    ctx = _task(spark, root, source__origin="table", source__schema_name="bronze", source__table="FEED", output__verb="complete_delta", output__schema_name="silver", output__table="FEED", output__keys="ID", output__event_time__column="CHANGED")
    return history(ctx.target.read())


def _placed(spark, folder: str, goal: str) -> None:
    """Move a folder's one part file to a name."""
    from .sources.store import Files

    fs = Files(spark, folder)
    part = next(n for n in fs.names(folder) if n.startswith("part-"))
    fs.fs.mkdirs(fs.path(goal.rsplit("/", 1)[0]))
    fs.fs.rename(fs.path(f"{folder}/{part}"), fs.path(goal))
