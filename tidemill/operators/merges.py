"""Write verbs as plans: functions from a target frame and a batch to the new target frame.

None of them writes. A history row has a validity window and two flags; a merge is a
left join of target and batch with a conditional projection, united with the rows
that are new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import CURRENT, DELETED, END, EXPORT_DATE, HISTORY, RECORD_HASH, START, is_own
from ..functions.values import as_timestamp
from .batch import Time
from .errors import AmbiguousMerge, PlatformViolation
from .shape import q


#: What a replay tells of its versions beside them; counted when a table is written, not stored.
NEW, RETIRED = "__mark_new", "__mark_retired"


def require_no_new_columns(target: DataFrame, batch: DataFrame, evolve: bool) -> None:
    new = [c for c in batch.columns if c not in target.columns]
    if new and not evolve:
        raise PlatformViolation("unexpected_columns", f"the target has no {', '.join(new)}", len(new))


def require_creatable(batch: DataFrame) -> None:
    if not [c for c in batch.columns if not is_own(c)]:
        raise PlatformViolation("empty_source_schema", "a batch without columns cannot create a table")


def union(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Rows of both; what one lacks is null there."""
    return batch if target is None else target.unionByName(batch, allowMissingColumns=True)


def match(left: str, right: str, keys: list[str], right_keys: list[str] | None = None) -> Column:
    cond = F.lit(True)
    for a, b in zip(keys, right_keys or keys, strict=True):
        cond = cond & (F.col(f"{left}.`{a}`") == F.col(f"{right}.`{b}`"))
    return cond


def require_single_match(batch: DataFrame, keys: list[str]) -> None:
    row = batch.where(F.expr(" and ".join(f"`{k}` is not null" for k in keys))).groupBy(*[q(k) for k in keys]).count().where("count > 1").first()
    if row:
        raise AmbiguousMerge(f"several rows of one batch have the key {row.asDict()}")


def newest(batch: DataFrame) -> DataFrame:
    """Rows of the batch's newest export (FULL keeps only those)."""
    top = batch.agg(F.max(EXPORT_DATE).alias("__top"))
    return batch.join(F.broadcast(top), F.col(EXPORT_DATE) == F.col("__top")).drop("__top")  # top is one row


def upsert(target: DataFrame | None, batch: DataFrame, keys: list[str], time: Time | None = None) -> DataFrame:
    """One row per key. A known key takes the new row if its content differs (and, with ``time``, if it is newer); a new key is added.

    Equal times do not update. Null keys match nothing and are added. Columns that the batch lacks keep the target's value.
    """
    if target is None:
        return batch
    s = batch.alias("s")
    t = target.alias("t")
    change = F.col(f"s.{RECORD_HASH}").isNotNull() & ~F.col(f"t.{RECORD_HASH}").eqNullSafe(F.col(f"s.{RECORD_HASH}"))
    if time:
        change = change & (_time("s", batch, time) > _time("t", target, time))
    columns = [*target.columns, *[c for c in batch.columns if c not in target.columns]]

    def value(c: str) -> Column:
        old = F.col(f"t.`{c}`") if c in target.columns else F.lit(None)
        return (F.when(change, F.col(f"s.`{c}`")).otherwise(old) if c in batch.columns else old).alias(c)

    kept = t.join(s, match("t", "s", keys), "left").select(*[value(c) for c in columns])
    fresh = s.join(t, match("s", "t", keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def _time(alias: str, df: DataFrame, time: Time) -> Column:
    return as_timestamp(F.col(f"{alias}.`{time.column}`"), df.schema[time.column].dataType, time.layout)


def opened(batch: DataFrame, time: Time) -> DataFrame:
    """Rows as open versions, valid from their event time."""
    return batch.withColumns({START: time.of(batch), END: F.lit(None).cast("timestamp"), CURRENT: F.lit("Y"), DELETED: F.lit("N")})


def news(target: DataFrame, batch: DataFrame, keys: list[str], time: Time) -> DataFrame:
    """Incoming rows that say something: their key's current version has another hash and an older event time, or there is none."""
    t = target.where(F.col(CURRENT) == "Y").alias("t")
    s = batch.alias("s")
    old = (F.col(f"t.{RECORD_HASH}") == F.col(f"s.{RECORD_HASH}")) | (F.col(f"t.{START}") >= _time("s", batch, time))
    return s.join(t, match("s", "t", keys) & old, "left_anti")


def close_superseded(target: DataFrame, incoming: DataFrame, keys: list[str], time: Time) -> DataFrame:
    """End current, not deleted versions at the event time of the newer row for their key."""
    s = incoming.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], time.of(incoming).alias("__at")).alias("s")
    cond = match("t", "s", keys, [f"__k{i}" for i in range(len(keys))])
    cond = cond & (F.col(f"t.{CURRENT}") == "Y") & (F.col(f"t.{DELETED}") == "N") & (F.col(f"t.{START}") < F.col("s.__at"))
    hit = F.col("s.__at").isNotNull()
    new = {END: F.when(hit, F.col("s.__at")).otherwise(F.col(f"t.{END}")), CURRENT: F.when(hit, F.lit("N")).otherwise(F.col(f"t.{CURRENT}"))}
    return target.alias("t").join(s, cond, "left").select(*[new[c].alias(c) if c in new else F.col(f"t.`{c}`") for c in target.columns])


def expire_absent(target: DataFrame, snapshot: DataFrame, keys: list[str], at) -> DataFrame:
    """Full scope: end current versions whose key the snapshot omits, or carries with another content."""
    s = snapshot.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(RECORD_HASH).alias("__h")).alias("s")
    gone = (F.col(f"t.{CURRENT}") == "Y") & (F.col("s.__h").isNull() | (F.col("s.__h") != F.col(f"t.{RECORD_HASH}")))
    when = F.lit(at).cast("timestamp")
    new = {END: F.when(gone, when).otherwise(F.col(f"t.{END}")), CURRENT: F.when(gone, F.lit("N")).otherwise(F.col(f"t.{CURRENT}"))}
    joined = target.alias("t").join(s, match("t", "s", keys, [f"__k{i}" for i in range(len(keys))]), "left")
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"t.`{c}`") for c in target.columns])


def scd2(target: DataFrame | None, batch: DataFrame, keys: list[str], time: Time, expire_at=None) -> DataFrame:
    """History by key: close what is superseded, open what is new; with ``expire_at`` the batch is a full snapshot of that time."""
    if target is None:
        return opened(batch, time)
    if expire_at is not None:
        target = expire_absent(target, batch, keys, expire_at)
    incoming = news(target, batch, keys, time)
    return close_superseded(target, incoming, keys, time).unionByName(opened(incoming, time), allowMissingColumns=True)


def soft_delete(target: DataFrame, deletes: DataFrame, keys: list[str], delete_keys: list[str], time: Time) -> DataFrame:
    """Flag all versions of deleted keys; the current one ends at the delete time. No row goes."""
    s = deletes.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(delete_keys)], time.of(deletes).alias("__at")).alias("s")
    hit = F.col("s.__at").isNotNull()
    open_ = hit & (F.col(f"t.{CURRENT}") == "Y") & F.col(f"t.{END}").isNull()
    new = {
        END: F.when(open_, F.col("s.__at")).otherwise(F.col(f"t.{END}")),
        CURRENT: F.when(hit, F.lit("N")).otherwise(F.col(f"t.{CURRENT}")),
        DELETED: F.when(hit, F.lit("Y")).otherwise(F.col(f"t.{DELETED}")),
    }
    joined = target.alias("t").join(s, match("t", "s", keys, [f"__k{i}" for i in range(len(keys))]), "left")
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"t.`{c}`") for c in target.columns])


def current_state(target: DataFrame) -> DataFrame:
    """Current rows without the engine's columns."""
    return target.where(F.col(CURRENT) == "Y").drop(*[c for c in target.columns if is_own(c)])


def replayed(
    batch: DataFrame, keys: list[str], time: Time, deletes: DataFrame | None = None, delete_time: Time | None = None, stored: DataFrame | None = None, delete_keys: list[str] | None = None, marks: bool = False
) -> DataFrame:
    """All snapshots of a feed in the history ``stored``, with one shuffle of both.

    Per key the events of all exports come in order, updates before deletes, and go
    through the rules of the snapshot-by-snapshot loop: a row is skipped if a current
    version has its hash, its event time or a newer one; else the current,
    undeleted, older version ends at its event time and it opens a version. A
    delete flags all versions and ends the current one.

    Where the event times of a key grow from export to export (the usual case)
    windows over its events say all that: a row opens a version if the event before
    it is a delete or has another hash, and a version ends at the next event that
    counts. A key of any number of events is sorted, never gathered. Only keys with
    late rows are folded event by event; their events must fit a row.

    The batch must be deduplicated per snapshot. Null keys match nothing, so each of
    their rows is a version of its own. With ``marks`` two more columns tell new
    versions and ones that a delete has ended.
    """
    if stored is not None:
        more = [f for f in stored.schema if f.name not in batch.columns and f.name not in HISTORY]
        batch = batch.withColumns({f.name: F.lit(None).cast(f.dataType) for f in more})
    columns = [c for c in batch.columns if c not in keys and c not in HISTORY]
    no_key = lambda names: F.expr(" or ".join(f"`{k}` is null" for k in names))
    no_time, no = F.lit(None).cast("timestamp"), F.lit(False)

    def events(df, own_keys, x, order, at, end=no_time, cur="Y", gone="N", filled=True):
        flag = lambda v: F.lit(v) if isinstance(v, str) else v
        named = [q(k).cast(batch.schema[t].dataType).alias(t) for k, t in zip(own_keys, keys, strict=True)]
        body = [(q(c) if filled and c in df.columns else F.lit(None)).cast(batch.schema[c].dataType).alias(c) for c in columns]
        own = [x.cast("timestamp").alias("__x"), order.cast("int").alias("__o"), at.alias("__at"), end.alias("__e"), flag(cur).alias("__cur"), flag(gone).alias("__del")]
        return df.where(~no_key(own_keys)).select(*named, *body, *own)

    every = events(batch, keys, F.col(EXPORT_DATE), F.lit(0), time.of(batch))
    if deletes is not None:
        every = every.unionByName(events(deletes, delete_keys or keys, F.col(EXPORT_DATE), F.lit(1), delete_time.of(deletes), filled=False))
    if stored is not None:
        order = F.when(F.col(CURRENT) == "Y", -1).otherwise(-2)
        every = every.unionByName(events(stored, keys, no_time, order, F.col(START), F.col(END), F.col(CURRENT), F.col(DELETED)))

    x, o, at, h = F.col("__x"), F.col("__o"), F.col("__at"), F.col(RECORD_HASH)
    key = W.partitionBy(*[q(k) for k in keys])
    in_order = key.orderBy("__x", "__o")
    newest_so_far = F.max(F.when(o.isin(-1, 0), at)).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    late = (o == 0) & (at.isNull() | F.coalesce(at <= newest_so_far, no))
    odd = (o == -1) & ((F.col("__del") != "N") | F.col("__e").isNotNull())
    before = F.lag(o).over(in_order)
    says = (o != 0) | before.isNull() | before.isin(1, -2) | (F.lag(h).over(in_order) != h)
    marked = every.withColumns({"__late": late | odd, "__says": says})
    marked = marked.withColumn("__late", F.max("__late").over(key) | (F.count(F.when(o == -1, 1)).over(key) > 1))

    counts = marked.where("not __late and __says")
    counts = counts.withColumns({"__next": F.lead(o).over(in_order), "__until": F.lead(at).over(in_order), "__gone": F.max(F.when(o == 1, x)).over(key)}).where("__o <> 1")
    ended = (o >= -1) & F.col("__next").isNotNull()
    plain = counts.select(
        *[q(c) for c in [*keys, *columns]],
        at.alias(START),
        F.when(ended, F.col("__until")).otherwise(F.col("__e")).alias(END),
        F.when(ended, F.lit("N")).otherwise(F.col("__cur")).alias(CURRENT),
        F.when(F.col("__gone").isNotNull() & ((o < 0) | (x <= F.col("__gone"))), F.lit("Y")).otherwise(F.col("__del")).alias(DELETED),
        (o == 0).alias(NEW),
        F.coalesce(ended & (F.col("__next") == 1), no).alias(RETIRED),
    )
    folded = _folded(marked.where("__late"), keys, columns)
    out = plain.unionByName(folded)
    out = out.unionByName(opened(batch.where(no_key(keys)), time).withColumns({NEW: F.lit(True), RETIRED: no}))
    if stored is not None:
        out = out.unionByName(stored.where(no_key(keys)).withColumns({NEW: no, RETIRED: no}), allowMissingColumns=True)
    return out.select(*batch.columns, *HISTORY, *[NEW, RETIRED] * marks)


def _folded(events: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Versions of keys with late rows: their events applied one after another."""
    events = events.select(*[q(k) for k in keys], "__x", "__o", "__at", "__e", "__cur", "__del", F.struct(*[q(c) for c in columns]).alias("row"))
    kind = events.schema["row"].dataType.simpleString()
    version = f"struct<row:{kind},start:timestamp,`end`:timestamp,cur:string,del:string,new:boolean,retired:boolean>"
    event = F.struct(F.col("__x").alias("x"), F.col("__o").alias("o"), F.col("__at").alias("at"), "row")
    known = F.struct("row", F.col("__at").alias("start"), F.col("__e").alias("end"), F.col("__cur").alias("cur"), F.col("__del").alias("del"), F.lit(False).alias("new"), F.lit(False).alias("retired")).cast(version)
    grouped = events.groupBy(*[q(k) for k in keys]).agg(
        F.array_sort(F.collect_list(F.when(F.col("__o") >= 0, event)), lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(a["o"] - b["o"])).alias("es"),
        F.collect_list(F.when(F.col("__o") < 0, known)).cast(f"array<{version}>").alias("vs"),
    )
    h = RECORD_HASH

    def make(row, start, end, cur, gone, new, retired):
        return F.struct(row.alias("row"), start.alias("start"), end.alias("end"), cur.alias("cur"), gone.alias("del"), new.alias("new"), retired.alias("retired"))

    def step(acc, e):
        known = F.exists(acc, lambda v: (v["cur"] == "Y") & ((v["row"][h] == e["row"][h]) | (v["start"] >= e["at"])))

        def closed(v):
            old = (v["cur"] == "Y") & (v["del"] == "N") & (v["start"] < e["at"])
            return make(v["row"], v["start"], F.when(old, e["at"]).otherwise(v["end"]), F.when(old, F.lit("N")).otherwise(v["cur"]), v["del"], v["new"], v["retired"])

        fresh = F.array(make(e["row"], e["at"], F.lit(None).cast("timestamp"), F.lit("Y"), F.lit("N"), F.lit(True), F.lit(False)))
        updated = F.when(known, acc).otherwise(F.concat(F.transform(acc, closed), fresh))

        def deleted(v):
            open_ = (v["cur"] == "Y") & v["end"].isNull()
            return make(v["row"], v["start"], F.when(open_, e["at"]).otherwise(v["end"]), F.lit("N"), F.lit("Y"), v["new"], v["retired"] | (v["cur"] == "Y"))

        return F.when(e["o"] == 0, updated).otherwise(F.transform(acc, deleted))

    exploded = grouped.select(*[q(k) for k in keys], F.explode(F.aggregate("es", F.col("vs"), step)).alias("v"))
    return exploded.select(
        *[q(k) for k in keys],
        *[F.col(f"v.row.`{c}`").alias(c) for c in columns],
        F.col("v.start").alias(START), F.col("v.end").alias(END), F.col("v.cur").alias(CURRENT), F.col("v.del").alias(DELETED), F.col("v.new").alias(NEW), F.col("v.retired").alias(RETIRED),
    )
