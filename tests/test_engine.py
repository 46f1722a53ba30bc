"""Histories, store, sources, gate, configuration and export, on small fixtures."""

import hashlib
import os
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill import registry
from tidemill.functions.columns import CURRENT, DELETED, END, EXPORT_DATE, RECORD_HASH, SOURCE, START
from tidemill.functions.values import export_stamp, export_text, record_hash
from tidemill.operators import batch as B
from tidemill.operators import merges as M
from tidemill.operators import shape as S
from tidemill.operators.errors import AmbiguousMerge, ConfigError, IncompatibleColumns, PlatformViolation, PolicyViolation
from tidemill.plans import config as C
from tidemill.plans.export import digest_and_count, joined, read_csv, run_export, write_csv
from tidemill.plans.task import parse_argv, run_task
from tidemill.sources.files import by_header, read_json
from tidemill.sources.store import ConcurrentWrite, Files, Store
from tidemill.sources.tables import after, kind_of

TIME = B.Time("UPDATEDTIME", "yyyy-MM-dd HH:mm:ss")


def day(n, hour=0):
    return datetime(2026, 1, n, hour)


def subjects(spark, rows):
    """(id, payload, event day, export day)"""
    df = spark.createDataFrame([(i, p, f"2026-01-{e:02d} 00:00:00", f"FILE:{x}", day(x)) for i, p, e, x in rows], f"ID string, PAYLOAD string, UPDATEDTIME string, {SOURCE} string, {EXPORT_DATE} timestamp")
    return df.withColumn(RECORD_HASH, record_hash(df.select("ID", "PAYLOAD")))


def versions(df):
    d = lambda t: (t.day, t.hour) if t else None
    return sorted((r["ID"], r["PAYLOAD"], d(r[START]), d(r[END]), r[CURRENT], r[DELETED]) for r in df.collect())


DELTA = [("A", "v1", 1, 1), ("B", "v1", 1, 1), ("A", "v2", 2, 2), ("A", "v3", 3, 3)]
DELTA_HISTORY = [
    ("A", "v1", (1, 0), (2, 0), "N", "N"),
    ("A", "v2", (2, 0), (3, 0), "N", "N"),
    ("A", "v3", (3, 0), None, "Y", "N"),
    ("B", "v1", (1, 0), None, "Y", "N"),
]


def loop(df, deletes=None):
    out = None
    for s in B.snapshots(df, deletes):
        out = M.scd2(out, B.of_export(df, s), ["ID"], TIME)
        if deletes is not None:
            out = M.soft_delete(out, B.of_export(deletes, s), ["ID"], ["ID"], B.Time("AT"))
        out = out.checkpoint()
    return out


def test_replay_loop_and_fold(spark):
    df = subjects(spark, DELTA)
    assert versions(loop(df)) == DELTA_HISTORY
    assert versions(M.replayed(df, ["ID"], TIME)) == DELTA_HISTORY


def test_full_scope(spark):
    first = M.scd2(None, subjects(spark, [("A", "v1", 1, 1), ("B", "v1", 1, 1), ("C", "v1", 1, 1)]), ["ID"], TIME, day(1))
    second = M.scd2(first, subjects(spark, [("A", "v1", 1, 2), ("B", "v2", 2, 2)]), ["ID"], TIME, day(2, 12))
    assert versions(second) == [
        ("A", "v1", (1, 0), None, "Y", "N"),
        ("B", "v1", (1, 0), (2, 12), "N", "N"),
        ("B", "v2", (2, 0), None, "Y", "N"),
        ("C", "v1", (1, 0), (2, 12), "N", "N"),
    ]


def test_deletes(spark):
    df = subjects(spark, [("A", "v1", 1, 1), ("B", "v1", 1, 1), ("A", "v2", 2, 2)])
    gone = spark.createDataFrame([("B", day(2), day(2))], f"ID string, AT timestamp, {EXPORT_DATE} timestamp")
    want = [("A", "v1", (1, 0), (2, 0), "N", "N"), ("A", "v2", (2, 0), None, "Y", "N"), ("B", "v1", (1, 0), (2, 0), "N", "Y")]
    assert versions(loop(df, gone)) == want
    assert versions(M.replayed(df, ["ID"], TIME, gone, B.Time("AT"))) == want


def test_fold_equals_loop_on_random_feeds(spark):
    rng = random.Random(4)
    rows = {(f"k{rng.randrange(3)}", x): (f"v{rng.randrange(3)}", rng.randrange(1, 9)) for x in range(1, 5) for _ in range(3)}
    df = subjects(spark, [(k, p, e, x) for (k, x), (p, e) in rows.items()])
    assert versions(M.replayed(df, ["ID"], TIME)) == versions(loop(df))


def test_late_unchanged_and_returning_rows(spark):
    base = M.scd2(None, subjects(spark, [("A", "v1", 5, 5)]), ["ID"], TIME)
    assert versions(M.scd2(base, subjects(spark, [("A", "v0", 3, 6)]), ["ID"], TIME)) == versions(base)
    assert versions(M.scd2(base, subjects(spark, [("A", "v1", 8, 8)]), ["ID"], TIME)) == versions(base)


def test_null_keys_are_added_again(spark):
    row = subjects(spark, [(None, "x", 1, 1)])
    assert M.upsert(row, row, ["ID"]).count() == 2


def test_upsert_and_ambiguity(spark):
    t = subjects(spark, [("A", "v1", 2, 1), ("B", "v1", 2, 1)])
    s = subjects(spark, [("A", "v0", 1, 2), ("B", "v2", 3, 2), ("C", "v1", 1, 2)])
    assert sorted((r.ID, r.PAYLOAD) for r in M.upsert(t, s, ["ID"], TIME).collect()) == [("A", "v1"), ("B", "v2"), ("C", "v1")]
    with pytest.raises(AmbiguousMerge):
        M.require_single_match(s.union(s), ["ID"])


def test_hash_rules(spark):
    df = spark.createDataFrame([(None, "a", 1), ("", "a", 1), ("ab", "c", 1), ("a", "bc", 1)], "x string, y string, n int")
    hashes = [r[0] for r in df.select(record_hash(df)).collect()]
    assert len(set(hashes)) == 4
    same = df.withColumn("n", F.col("n").cast("bigint")).select("n", "y", "x", F.lit(1).alias("__own"))
    assert [r[0] for r in same.select(record_hash(same)).collect()] == hashes


STAMP_CASES = {
    # a stamp of 14 digits counts wherever it stands in the file name, if no digit touches it
    ("datetime", "19991231235959", datetime(1999, 12, 31, 23, 59, 59)): ("{}", "{}.txt", "x{}y", "a-{}-b.json", "v2_{}"),
    ("datetime", "20000229000000", datetime(2000, 2, 29)): ("leap_{}.csv",),
    ("datetime", "20010229000000", None): ("no_leap_{}.csv",),
    ("datetime", "20250101240000", None): ("hour_{}.csv",),
    ("datetime", "20250101", None): ("day_only_{}.csv", "{}_{}.csv"),
    ("datetime", "120250101000000", None): ("touched_{}.csv",),
    ("datetime", "20250101000000", None): ("{}/plain.csv", "deep/{}/er/plain.csv"),
    # the other pattern wants separators
    ("iso", "2023-11-05T01:30:00", datetime(2023, 11, 5, 1, 30)): ("{}", "feed.{}.json"),
    ("iso", "2023-11-31T01:30:00", None): ("feed.{}.json",),
    ("iso", "2023-11-05 01:30:00", None): ("feed.{}.json",),
    ("iso", "20231105013000", None): ("feed.{}.json",),
    ("datetime", "2023-11-05T01:30:00", None): ("feed.{}.json",),
}


def test_export_stamp(spark):
    cases = [(f"s3://in/{name.format(stamp, stamp)}", pattern, want) for (pattern, stamp, want), names in STAMP_CASES.items() for name in names]
    for kind in ("datetime", "iso"):
        own = [(path, want) for path, pattern, want in cases if pattern == kind]
        df = spark.createDataFrame([(p,) for p, _ in own], "path string").coalesce(1)
        assert [r[0] for r in df.select(export_stamp(F.col("path"), kind)).collect()] == [want for _, want in own]


def test_cast_that_loses_a_value_stops(spark):
    df = spark.createDataFrame([("1",), ("x",), (" ",), (None,)], "n string")
    with pytest.raises(PlatformViolation, match="cast_silent_null"):
        S.cast_columns(df, [S.Cast("n", "int")])
    assert [r[0] for r in S.cast_columns(df, [S.Cast("n", "int")], validate=False).collect()] == [1, None, None, None]
    with pytest.raises(ValueError, match="gone"):
        S.cast_columns(df, [S.Cast("gone", "int")])


def test_times_must_be_valid(spark):
    df = subjects(spark, [("A", "v1", 1, 1)]).withColumn("UPDATEDTIME", F.lit("soon"))
    with pytest.raises(PlatformViolation, match="event_time_invalid"):
        B.require_valid_times(df, {"output.event_time": TIME})


def test_gate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, None), (3, "d")], "ID int, NAME string")
    checks = B.load_checks([{"criticality": "error", "check": {"function": f, "arguments": a}} for f, a in (("is_not_null", {"column": "ID"}), ("is_unique", {"columns": ["ID"]}), ("is_not_null", {"column": "GONE"}))])
    assert {r["name"]: r["failed"] for r in B.evaluate(df, checks).collect()} == {"ID_is_not_null": 1, "ID_is_unique": 2, "GONE_is_not_null": 5}
    assert B.load_checks(None) == []
    with pytest.raises(ValueError, match="unknown function"):
        B.load_checks([{"check": {"function": "nope"}}])


def test_store_versions_restore_and_conflict(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}").table("c.s.T")
    a = spark.createDataFrame([(1, "a")], "id int, v string")
    t.write(a, "APPEND")
    t.write(spark.createDataFrame([(2, "b", 1.0)], "id bigint, v string, extra double"), "APPEND")
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a", None), (2, "b", 1.0)]
    assert t.read(0).columns == ["id", "v"] and t.version == 1
    t.restore(0)
    assert t.read().count() == 1
    stale = t._next("APPEND")
    t.write(a, "APPEND")
    with pytest.raises(ConcurrentWrite):
        t._publish(stale)
    t.write(a, "OVERWRITE")
    with pytest.raises(RuntimeError, match="appends only"):
        t.appended_since(0)


def test_watermark_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(datetime(2026, 1, 1),)], "t timestamp_ntz").write.parquet(f"{tmp_path}/x")
    df = after(spark.read.parquet(f"{tmp_path}/x"), "t", datetime(2025, 1, 1))
    assert "GreaterThan(t," in df._jdf.queryExecution().toString()
    assert kind_of(["__source", "x"]) == "malformed" and kind_of(["x"]) == "foreign"


TABLE = {
    "source.origin": "table", "source.schema_name": "b", "source.table": "T", "source.path": "", "source.directory": "",
    "output.verb": "complete_delta", "output.keys": "ID", "output.event_time.column": "AT",
}
GOOD = {"catalog": "c", "env": "dev", "metadata_path": "/m", "source.origin": "csv", "source.path": "/p", "source.directory": "d", "output.verb": "append", "output.schema_name": "s", "output.table": "T"}


@pytest.mark.parametrize(
    "change, problem",
    [
        ({"output.verb": "scd2"}, "cannot do without output.keys"),
        ({"output.keys": "ID"}, "output.keys has no meaning"),
        ({"output.verb": "complete_delta", "output.keys": "ID", "output.event_time.column": "T"}, "takes no csv source"),
        ({"source.increment_strategy": "watermark"}, "increment_strategy=watermark"),
        ({"sorce.path": "x"}, "unknown setting"),
        ({"output.verb": "upsert", "output.keys": "ID"}, "name its order"),
        ({"source.envelope_fields": "a"}, "need each other"),
        ({"output.table": "lower"}, "upper case"),
        ({"output.snapshot_scope": "full"}, "snapshot_scope=full"),
        ({"source.rename_patterns": "["}, "rename_patterns"),
        ({"source": "x"}, "namespace"),
        (TABLE | {"source.increment_strategy": "delta_read"}, "needs anchor column"),
        (TABLE | {"source.increment_strategy": "delta_read", "source.anchor_dt.column": "A", "output.snapshot_scope": "full"}, "exclude each other"),
        (TABLE | {"source.increment_strategy": "full_read", "source.increment_anchor": "true"}, "record mark needs watermark"),
        (TABLE | {"source.deletes_table": "D"}, "lacks output.deletes.keys"),
    ],
)
def test_config_problems(change, problem):
    with pytest.raises(ConfigError, match=problem):
        C.load_config(GOOD | change)


def test_config_coercion():
    c, ids, absent = C.load_config(GOOD | {"source.options.header": "FALSE", "output.verb": "UPSERT", "output.keys": "A, B", "output.dedup.enabled": "false", "__task_key": "t"})
    assert (c.source.options.header, c.output.verb, c.output.keys, ids.task_key) == (False, "upsert", ["A", "B"], "t")
    assert absent == ["workflow_id", "workflow_run_id", "task_run_id"]


def test_table_config():
    good = C.load_table_config('comment: "x"\ncolumns:\n- {name: A, cast: {target_type: date, format: yyyy}}\n- {name: B, tags: {PII: "no"}}')
    assert good.casts[0] == S.Cast("A", "date", "yyyy") and good.column_tags == {"B": {"PII": "no"}}
    for bad in ("", "columns: [{name: A}]", "tags: {a: 1}", "x: 1\ncomment: y", "columns: [{name: __A, comment: x}]"):
        with pytest.raises(ConfigError):
            C.load_table_config(bad)


def csv_task(root, **more):
    return {"catalog": "c", "env": "dev", "metadata_path": f"file://{root}/w/c_dev/meta", "source.origin": "csv", "source.path": f"file://{root}/in", "source.directory": "d", "output.verb": "append", "output.schema_name": "bronze", "output.table": "T"} | more


def test_csv_task_runs_once_per_file_and_refuses_unstamped(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/d/T_20260101000000.CSV").write_text("agent id,Name\n1,a\n2,b\n")
    (tmp_path / "in/d/T_20260102000000.csv").write_text("Name,agent id\nc,3\n")
    w = f"file://{tmp_path}/w"
    ctx = run_task(spark, w, csv_task(tmp_path))
    assert sorted((r["AGENT_ID"], r["NAME"]) for r in ctx.target.read().collect()) == [("1", "a"), ("2", "b"), ("3", "c")]
    version = ctx.target.version
    assert run_task(spark, w, csv_task(tmp_path)).target.version == version
    (tmp_path / "in/d/nodate.csv").write_text("agent id,Name\n9,z\n")
    with pytest.raises(Exception, match="unstamped_file"):
        run_task(spark, w, csv_task(tmp_path))
    assert ctx.target.version == version
    names = {r["name"] for r in ctx.store.table("monitoring_dev.audit.ENGINE_LOGS").read().collect()}
    assert {"pipeline_start", "promotion_start", "rows_appended", "step_promoted", "pipeline_complete", "pipeline_failure"} <= names


def test_promotion_gate_and_checkpoint(spark, tmp_path):
    w = f"file://{tmp_path}/w"
    source = Store(spark, w).table("c_dev.bronze.F")
    source.write(subjects(spark, DELTA[:2]), "APPEND")
    checks = tmp_path / "checks.yml"
    checks.write_text("- criticality: error\n  check: {function: is_not_null, arguments: {column: PAYLOAD}}\n")
    task = {"catalog": "c", "env": "dev", "metadata_path": f"file://{tmp_path}/w/c_dev/meta", "source.origin": "table", "source.schema_name": "bronze", "source.table": "F", "output.verb": "scd2", "output.schema_name": "silver", "output.table": "F", "output.keys": "ID", "output.event_time.column": "UPDATEDTIME", "output.event_time.format": TIME.layout, "policies.checks_file": f"file://{checks}"}
    ctx = run_task(spark, w, task)
    assert ctx.target.read().count() == 2
    source.write(subjects(spark, [("A", "v2", 2, 2)]), "APPEND")
    assert run_task(spark, w, task).target.read().count() == 3
    source.write(subjects(spark, [("A", None, 3, 3)]), "APPEND")
    with pytest.raises(PolicyViolation):
        run_task(spark, w, task)
    assert ctx.target.read().count() == 3
    assert ctx.target.commit_at().properties["clustering"] == ["ID", CURRENT]


def test_export(spark, tmp_path):
    w = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(1, 'a "q"\nb', None, datetime(2026, 1, 1, 1, 2, 3, 120000)), (2, "", "x,y", None)], "ID int, A string, B string, T timestamp")
    Store(spark, w).table("c_dev.gold.SITE").write(df.withColumn("__OWN", F.lit(1)), "APPEND")
    flat = {"catalog": "c", "env": "dev", "export.name": "SITES", "export.schema_name": "gold", "export.preparation_path": f"file://{tmp_path}/prep", "export.stamp_format": "%Y", "export.checksum": "sha256", "export.package": "files", "export.destination": f"file://{tmp_path}/out", "export.renames.SITE.A": "TEXT"}
    out = run_export(spark, w, flat)
    assert out[0] == "SITE.csv" and len(out) == 4
    text = (tmp_path / "out/SITE.csv").read_text()
    assert '1,"a ""q""\nb",,2026-01-01T01:02:03.12Z\n' in text and '2,"","x,y",\n' in text
    with open(tmp_path / "out/SITE.csv", "rb") as f:
        assert digest_and_count(f, "md5")[1] == 2
    with pytest.raises(ConfigError):
        run_export(spark, w, flat | {"export.excludes.SITE": "NOPE"})


def random_feed(rng, keys=3, exports=5, late=False):
    """(id, payload, event day, export day): one row of a key in an export, mostly in order."""
    out = []
    for x in range(1, exports + 1):
        for k in range(keys):
            if rng.random() < 0.7:
                out.append((f"k{k}", f"v{rng.randrange(3)}", rng.randrange(1, 9) if late else x, x))
    return out


@pytest.mark.parametrize("seed, late", [(1, False), (2, False), (3, True), (4, True)])
def test_replay_onto_a_history_equals_the_loop(spark, seed, late):
    """Updates and deletes, on stored versions, in one shuffle or one snapshot after another."""
    rng = random.Random(seed)
    first, then = (subjects(spark, random_feed(rng, 5, late=late)) for _ in range(2))
    then = then.withColumn(EXPORT_DATE, F.col(EXPORT_DATE) + F.expr("interval 10 days")).withColumn("UPDATEDTIME", F.concat(F.lit("2026-01-"), F.substring("UPDATEDTIME", 9, 2).cast("int") + (0 if late else 10), F.lit(" 00:00:00")))
    then = then.withColumn("UPDATEDTIME", F.date_format(F.to_timestamp("UPDATEDTIME", "yyyy-MM-d HH:mm:ss"), "yyyy-MM-dd HH:mm:ss"))
    gone = [(f"k{k}", day(20 + x), day(10 + x)) for x in (2, 4) for k in range(4) if rng.random() < 0.5]
    deletes = spark.createDataFrame(gone, f"GONE string, AT timestamp, {EXPORT_DATE} timestamp")
    base = loop(first)
    want = base
    for s in B.snapshots(then, deletes):
        want = M.scd2(want, B.of_export(then, s), ["ID"], TIME)
        want = M.soft_delete(want, B.of_export(deletes, s), ["ID"], ["GONE"], B.Time("AT")).checkpoint()
    got = M.replayed(then, ["ID"], TIME, deletes, B.Time("AT"), base, ["GONE"], marks=True)
    assert versions(got) == versions(want)
    assert got.where(M.NEW).count() == want.count() - base.count()


def test_replay_keeps_columns_that_the_batch_lacks(spark):
    base = M.scd2(None, subjects(spark, DELTA[:2]), ["ID"], TIME).withColumn("EXTRA", F.lit(7))
    got = M.replayed(subjects(spark, [("A", "v2", 2, 2), (None, "x", 2, 2)]), ["ID"], TIME, stored=base).collect()
    assert sorted((str(r["ID"]), r["PAYLOAD"], r["EXTRA"]) for r in got if r["EXTRA"]) == [("A", "v1", 7), ("B", "v1", 7)] and len(got) == 4


def test_one_key_with_very_many_changes_is_not_gathered(spark):
    df = spark.range(20000).select(F.lit("A").alias("ID"), F.col("id").cast("string").alias("PAYLOAD"), (F.col("id") * 60).cast("timestamp").alias("AT"), F.lit("x").alias(SOURCE))
    df = df.withColumns({EXPORT_DATE: F.col("AT"), RECORD_HASH: F.col("PAYLOAD")})
    got = M.replayed(df, ["ID"], B.Time("AT"))
    assert got.count() == 20000 and got.where(F.col(CURRENT) == "Y").count() == 1


def history_task(root, **more):
    return {
        "catalog": "c", "env": "dev", "metadata_path": f"file://{root}/w/c_dev/meta", "source.origin": "table", "source.schema_name": "bronze", "source.table": "F",
        "output.verb": "complete_delta", "output.schema_name": "silver", "output.table": "F", "output.keys": "ID",
        "output.event_time.column": "UPDATEDTIME", "output.event_time.format": TIME.layout,
    } | more


def test_step_records_follow_the_commit(spark, tmp_path, monkeypatch):
    """A run that dies between its writes has recorded no step of what it did not finish."""
    w = f"file://{tmp_path}/w"
    store = Store(spark, w)
    store.table("c_dev.bronze.F").write(subjects(spark, DELTA), "APPEND")
    gone = spark.createDataFrame([("B", day(3), "FILE:d", day(3))], f"ID string, AT timestamp, {SOURCE} string, {EXPORT_DATE} timestamp").withColumn(RECORD_HASH, F.lit("h"))
    store.table("c_dev.bronze.G").write(gone, "APPEND")
    task = history_task(tmp_path, **{"source.deletes_table": "G", "output.deletes.keys": "ID", "output.deletes.event_time.column": "AT"})
    steps = lambda: store.table("monitoring_dev.audit.ENGINE_LOGS").read().where("name = 'step_promoted'")
    keep = M.replayed
    with monkeypatch.context() as m:
        m.setattr(M, "replayed", lambda *a, **k: keep(*a, **k).withColumn(M.NEW, F.raise_error(F.lit("lost")).cast("boolean")))
        with pytest.raises(Exception, match="lost"):
            run_task(spark, w, task)
    assert steps().count() == 0 and not store.table("c_dev.silver.F").exists()
    ctx = run_task(spark, w, task)
    assert ctx.target.version <= 2 and ctx.target.commit_at(0).metrics == {"rows_written": 4, "new": 4, "retired": 1}
    assert sorted(r["metadata"].split('"feed": "')[1].split('"')[0] for r in steps().collect()) == ["deletes", "updates", "updates", "updates"]
    assert versions(ctx.target.read()) == DELTA_HISTORY[:3] + [("B", "v1", (1, 0), (3, 0), "N", "Y")]


def test_gate_judges_snapshots_apart(spark):
    df = subjects(spark, [("A", "v1", 1, 1), ("A", "v1", 1, 1), ("A", "v2", 2, 2), ("B", None, 2, 2)])
    checks = B.load_checks([{"check": {"function": "is_unique", "arguments": {"columns": ["ID"]}}}, {"check": {"function": "is_not_null", "arguments": {"column": "PAYLOAD"}}}])
    got = {(r[EXPORT_DATE].day, r["name"]): r["failed"] for r in B.evaluate(df, checks, EXPORT_DATE).collect()}
    assert got == {(1, "ID_is_unique"): 2, (2, "PAYLOAD_is_not_null"): 1}


def test_a_lost_checkpoint_loses_no_file(spark, tmp_path):
    """Batch numbers of a new checkpoint are not those of the one before."""
    import shutil

    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/d/T_20260101000000.csv").write_text("id\n1\n")
    w = f"file://{tmp_path}/w"
    run_task(spark, w, csv_task(tmp_path))
    shutil.rmtree(tmp_path / "w/c_dev/meta")
    (tmp_path / "in/d/T_20260101000000.csv").unlink()
    (tmp_path / "in/d/T_20260102000000.csv").write_text("id\n2\n")
    ctx = run_task(spark, w, csv_task(tmp_path))
    assert sorted(r["ID"] for r in ctx.target.read().collect()) == ["1", "2"]


def test_a_committed_batch_is_not_written_twice(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}").table("c.s.T")
    df = spark.createDataFrame([(1,)], "id int")
    t.write(df, "APPEND", batch=("s", 0))
    t.write(df, "APPEND", batch=("u", 4))
    assert t.has_batch(("s", 0)) and t.has_batch(("u", 3)) and not t.has_batch(("s", 1)) and not t.has_batch(("x", 0))


def test_types_that_do_not_fit_are_refused(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}").table("c.s.T")
    t.write(spark.createDataFrame([(1, 2)], "a int, b bigint"), "APPEND")
    for row, schema in ((("abc", 2), "a string, b bigint"), ((1, 2.5), "a int, b double"), ((True, 2), "a boolean, b bigint")):
        with pytest.raises(IncompatibleColumns):
            t.write(spark.createDataFrame([row], schema), "APPEND")
    t.write(spark.createDataFrame([(3, 4)], "a bigint, b int"), "APPEND")
    assert t.version == 1 and sorted(tuple(r) for r in t.read().collect()) == [(1, 2), (3, 4)]


def test_publishing_is_exclusive(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    io = Files(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: io.publish(f"file://{tmp_path}/name", f"writer {i}"), range(24)))
    assert sum(won) == 1 and (tmp_path / "name").read_text() == f"writer {won.index(True)}"
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["name"]


def test_entries_of_appends_name_what_they_add(spark, tmp_path):
    import json

    t = Store(spark, f"file://{tmp_path}").table("c.s.T")
    for i in range(5):
        t.write(spark.createDataFrame([(i,)], "id int"), "APPEND")
    t.alter(comment="x")
    entry = json.loads((tmp_path / f"c/s/T/_log/{4:020d}.json").read_text())
    assert "files" not in entry and len(entry["added"]) == 1
    assert sorted(r[0] for r in t.read().collect()) == [0, 1, 2, 3, 4] and t.read(2).count() == 3 and len(t.appended_since(2)[0]) == 2


def test_merge_rewrites_only_files_that_hold_its_keys(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}").table("c.s.T")
    for i in range(12):
        t.write(subjects(spark, [(f"k{i}", "v1", 1, 1), (f"m{i}", "v1", 1, 1)]).coalesce(1), "APPEND")
    batch = subjects(spark, [("k3", "v2", 2, 2), ("new", "v1", 2, 2)])
    met, keep = t.touched(batch, ["ID"])
    assert sorted(r["ID"] for r in met.collect()) == ["k3", "m3"] and len(keep) == 11
    t.write(M.upsert(met, batch, ["ID"], TIME), "MERGE", keep=keep)
    got = {r["ID"]: r["PAYLOAD"] for r in t.read().collect()}
    assert got == {f"{c}{i}": "v1" for c in "km" for i in range(12)} | {"k3": "v2", "new": "v1"}
    big = Store(spark, f"file://{tmp_path}").table("c.s.BIG")
    big.write(subjects(spark, [(f"k{i}", "v1", 1, 1) for i in range(40)]).repartition(10, "ID"), "APPEND")
    met, keep = big.touched(batch, ["ID"])
    assert 0 < met.count() < 40 and met.count() + big.read_files(keep, big.commit_at().struct).count() == 40


def test_files_with_one_header_need_one_look(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.csv").write_text("a,b\n1,2\n" if i % 2 else '"b\nc",a\n3,4\n')
    paths = [f"file://{tmp_path}/{i}.csv" for i in range(30)]
    opts = {"sep": ",", "quote": '"', "escape": "\\", "multiLine": "true"}
    got = by_header(spark, paths, opts)
    assert {k: len(v) for k, v in got.items()} == {("a", "b"): 15, ("b\nc", "a"): 15}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu", "UTC"])
def test_exported_times_do_not_depend_on_the_zone(spark, zone):
    """In the hour that a clock skips, in the one it repeats, and before the epoch."""
    micros = [1710037800000000, 1730610000000000, 1730613600000001, -1, 120000, 253402300799999999]
    want = ["2024-03-10T02:30:00Z", "2024-11-03T05:00:00Z", "2024-11-03T06:00:00.000001Z", "1969-12-31T23:59:59.999999Z", "1970-01-01T00:00:00.12Z", "9999-12-31T23:59:59.999999Z"]
    keep = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(m,) for m in micros], "m long").coalesce(1).select(F.timestamp_micros("m").alias("t"), F.expr("timestamp_ntz'2024-03-10 02:30:00'").alias("n"))
        got = df.select(*[export_text(F.col(c), df.schema[c].dataType) for c in df.columns]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", keep)
    assert [r[0] for r in got] == want and {r[1] for r in got} == {"2024-03-10T02:30:00"}


def test_export_names_settings_and_audit(spark, tmp_path):
    import hashlib
    import json

    w = f"file://{tmp_path}/w"
    Store(spark, w).table("c_dev.gold.SITE").write(spark.createDataFrame([(1, "a"), (2, "b")], "ID int, A string"), "APPEND")
    spark.createDataFrame([(5,)], "x int").createOrReplaceTempView("temporary_one")
    spark.sql("create database if not exists gold")
    spark.sql("create or replace view gold.plain_view as select 7 as n")
    try:
        flat = {"catalog": "c", "env": "dev", "export.name": "SITES", "export.schema_name": "gold", "export.preparation_path": f"file://{tmp_path}/prep", "export.stamp_format": "%Y", "export.checksum": "sha256", "export.package": "files", "export.destination": f"file://{tmp_path}/out", "export.excludes.site": "A", "export.renames.OTHER.a": "b"}
        out = run_export(spark, w, flat)
        assert out[:4] == ["SITE.csv", "SITE.csv.sha256", "plain_view.csv", "plain_view.csv.sha256"]
        assert (tmp_path / "out/SITE.csv").read_text().splitlines()[0] == "ID"
        log = Store(spark, w).table("monitoring_dev.audit.ENGINE_LOGS").read()
        assert log.where("name = 'export_setting_unused' and type = 'WARNING'").count() == 1
        site = json.loads(log.where("name = 'file_delivered' and description = 'SITE.csv'").first()["metadata"])
        assert site == {"object": "SITE", "version": 0, "rows": 2, "algorithm": "sha256", "location": f"file://{tmp_path}/out/SITE.csv", "checksum": hashlib.sha256((tmp_path / "out/SITE.csv").read_bytes()).hexdigest()}
        with pytest.raises(ConfigError, match="no table or view temporary_one"):
            run_export(spark, w, flat | {"export.tables": "temporary_one"})
        assert run_export(spark, w, flat | {"export.tables": "site"})[0] == "SITE.csv"
    finally:
        spark.sql("drop view gold.plain_view")
        spark.sql("drop database gold")


def test_command_line_and_metadata_path(spark, tmp_path):
    assert parse_argv(["--a.b=1", "x", "--flag", "--c=d=e", "--=z", "-q"]) == {"a.b": "1", "c": "d=e"}
    with pytest.raises(ConfigError, match="metadata_path must lie below"):
        run_task(spark, f"file://{tmp_path}/w", csv_task(tmp_path, metadata_path=f"file://{tmp_path}/elsewhere"))


def test_checksums_of_delivered_files_are_streamed(spark, tmp_path, monkeypatch):
    text = "a\u00e9\n" * 5000
    (tmp_path / "x").write_text(text)
    io = Files(spark, f"file://{tmp_path}")
    for name in ("md5", "sha256", "sha512"):
        assert io.digest(f"file://{tmp_path}/x", name) == hashlib.new(name, text.encode()).hexdigest()
    read = Files.read

    def small(self, p):
        assert not p.endswith(".csv"), f"{p} is held by the driver"
        return read(self, p)

    monkeypatch.setattr(Files, "read", small)
    got = registry.queries()["export_manifest"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 2 and all(r["checksum_matches"] for r in got)


ODD_DOCUMENTS = {
    "plain": ['{"a": 1, "b": {"c": [1, 2]}}', '{"a": 1.5,\n "d": "x\u00e9"}', '[{"a": null}, {"e": true}]', "", '{"b": {"z": "t"}}'],
    "malformed": ['{"a": 1}', '{"a": '],
    "not UTF-8": ['{"a": 1}'.encode("utf-16-le"), '{"b": "\u00e9"}'.encode("utf-8-sig"), b'{"c": 2}'],
    "bad bytes": [b'{"a": "\xff"}', b'{"c": 2}'],
}


@pytest.mark.parametrize("kind", ODD_DOCUMENTS)
def test_schema_of_documents_is_that_of_spark(spark, tmp_path, kind):
    for i, text in enumerate(ODD_DOCUMENTS[kind]):
        (tmp_path / f"T{i}_20260101000000.json").write_bytes(text if isinstance(text, bytes) else text.encode())
    paths = [f"file://{p}" for p in sorted(tmp_path.glob("*.json"))]
    want = spark.read.option("multiLine", "true").json(paths)
    got = read_json(spark, paths, {}, "datetime").drop(SOURCE, EXPORT_DATE)
    assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_many_small_documents_are_dealt_over_few_tasks(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"T{i}_20260101000000.json").write_text(f'{{"a": {i}}}')
    sc, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    sc.setJobGroup("documents", "")
    try:
        df = read_json(spark, [f"file://{p}" for p in tmp_path.glob("*.json")], {}, "datetime")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("documents")]
    tasks = [sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and 1 < min(tasks) and max(tasks) <= 4 * sc.defaultParallelism, "one task for each path, or one for all"
    assert df.count() == 150 and spark.conf.get(name) == before


def test_no_task_of_an_export_writes_a_whole_table(spark, tmp_path):
    w = f"file://{tmp_path}/w"
    Store(spark, w).table("c_dev.gold.SITE").write(spark.range(0, 1000, numPartitions=4).selectExpr("cast(id as string) as ID", "concat('a\n\"', id) as A"), "APPEND")
    flat = {"catalog": "c", "env": "dev", "export.name": "SITES", "export.schema_name": "gold", "export.preparation_path": f"file://{tmp_path}/prep", "export.stamp_format": "%Y", "export.checksum": "sha256", "export.package": "files", "export.destination": f"file://{tmp_path}/out"}
    run_export(spark, w, flat)
    parts = list((tmp_path / "prep/exports_temp/SITES/SITE").rglob("part-*"))
    sizes, out = [p.stat().st_size for p in parts], (tmp_path / "out/SITE.csv").read_bytes()
    assert len(parts) > 2 and max(sizes) < len(out) / 2 and sum(sizes) == len(out)
    assert out.startswith(b"ID,A\n") and sorted(out[5:].decode().split('"\n')) == sorted([f'{i},"a\n""{i}' for i in range(1000)] + [""])


@pytest.mark.parametrize("block", [47, 1000, 1 << 27])
def test_exported_files_are_written_and_read_in_parts(spark, tmp_path, block):
    rng = random.Random(block)
    texts = [None, "", 'a "b",\n c', "\n\n", '"', '\r\n"x"\n', " pad ", "long " * 30 + "\n" + "é" * 40, "k,l", "\\"]
    rows = [(str(i), rng.choice(texts), rng.choice(texts)) for i in range(200)]
    df = spark.createDataFrame(rows, "`i d` string, `a \"q\"\nb` string, c string").repartition(5)
    write_csv(df, f"file://{tmp_path}/t")
    joined(Files(spark, f"file://{tmp_path}"), f"file://{tmp_path}/t", f"{tmp_path}/t.csv")
    assert len([n for n in os.listdir(tmp_path / "t/rows") if n.startswith("part-")]) > 1
    with open(tmp_path / "t.csv", "rb") as f:
        assert digest_and_count(f, "md5")[1] == 200
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for n in before:
            spark.conf.set(n, block)
        got = read_csv(spark, f"file://{tmp_path}/t.csv", emptyValue="(empty)").replace("(empty)", "")
        assert got.columns == df.columns
        assert got.rdd.getNumPartitions() > 1 or block > 1000
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_an_archive_is_looked_into_and_not_loaded(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", os.urandom(3 << 20))
        z.writestr("y", b"yes")
    with Files(spark, f"file://{tmp_path}").opened(f"file://{tmp_path}/a.zip") as f:
        z = zipfile.ZipFile(f)
        assert z.namelist() == ["x", "y"] and z.read("y") == b"yes" and f.taken < 100_000
        assert z.testzip() is None

    def loaded(self, name):
        raise AssertionError("a whole archive in a row")

    monkeypatch.setattr(type(spark.read), "format", loaded)
    assert [r["files_inside"] for r in registry.queries()["export_zip"](spark, "/root/testdata/sf0.001").collect()] == [2, None]
