"""Export a schema: one exact CSV per table or view, with checksums, a manifest and an all-or-nothing delivery."""

from __future__ import annotations

import csv
import hashlib
import io
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_own
from ..functions.values import export_text
from ..operators.errors import ConfigError, PlatformViolation
from ..operators.shape import q
from ..sources.files import first_record
from ..sources.store import Files, Store
from .audit import Audit, Identity
from .config import coerced, nested

FORBIDDEN = set('/\\:*?"<>|')
CHUNK = 8 << 20


@dataclass
class ExportConfig:
    name: str = ""
    schema_name: str = ""
    tables: list[str] = field(default_factory=list)
    preparation_path: str = ""
    stamp_format: str = ""
    checksum: str = ""
    package: str = ""
    destination: str | None = None
    timezone: str = "UTC"
    with_ts_object_names: bool = False
    with_ts_zip: bool = True
    with_zip_checksum: bool = True
    with_manifest: bool = True
    skip_empty: bool = True
    exclude_metadata: bool = True
    excludes: dict = field(default_factory=dict)
    renames: dict = field(default_factory=dict)
    catalog: str = ""
    env: str = ""


def load_export_config(flat: dict) -> tuple[ExportConfig, Identity]:
    """Settings ``catalog``, ``env`` and ``export.*``; raises ConfigError with every problem."""
    problems: list[str] = []
    ids = Identity(**{n: flat.get(f"__{n}") or "local" for n in ("workflow_id", "workflow_run_id", "task_key", "task_run_id")})
    tree = nested({k: v for k, v in flat.items() if not k.startswith("__")}, problems)
    c = ExportConfig(catalog=tree.pop("catalog", ""), env=tree.pop("env", ""))
    given = tree.pop("export", {})
    problems += [f"unknown setting {k}" for k in tree]
    kinds = {n: str(f.type) for n, f in ExportConfig.__dataclass_fields__.items()}
    for k, v in given.items():
        if k not in kinds or k in ("catalog", "env"):
            problems.append(f"unknown setting export.{k}")
        elif k == "excludes":
            c.excludes = {t: coerced("list", x, k, problems) for t, x in v.items()}
        elif k == "renames":
            c.renames = {t: dict(x) for t, x in v.items()}
        else:
            setattr(c, k, coerced(kinds[k], v, f"export.{k}", problems))
    for n in ("catalog", "env", "name", "schema_name", "preparation_path", "stamp_format", "checksum", "package"):
        if not getattr(c, n):
            problems.append(f"{n if n in ('catalog', 'env') else 'export.' + n} is required")
    if c.name != c.name.upper() or set(c.name) & FORBIDDEN:
        problems.append("export.name must be upper case and fit a file name")
    if c.timezone not in available_timezones():
        problems.append(f"export.timezone is no time zone: {c.timezone}")
    if c.checksum and c.checksum not in ("md5", "sha256", "sha512"):
        problems.append("export.checksum must be md5, sha256 or sha512")
    if c.package and c.package not in ("zip", "files"):
        problems.append("export.package must be zip or files")
    if c.package == "files":
        problems += [f"export.{n} does nothing with export.package=files" for n in ("with_ts_zip", "with_zip_checksum") if n in given]
    if c.stamp_format and ("%" not in c.stamp_format or set(datetime(2026, 1, 2, 3, 4, 5).strftime(c.stamp_format)) & FORBIDDEN):
        problems.append("export.stamp_format needs a % directive and must fit a file name")
    if c.destination and c.preparation_path and f"{c.destination.rstrip('/')}/".startswith(f"{c.preparation_path.rstrip('/')}/exports_temp/"):
        problems.append("export.destination must not lie in the folder that every run clears")
    for t, names in c.renames.items():
        for old, new in names.items():
            if not str(new or "").strip():
                problems.append(f"export.renames.{t}.{old}: empty name")
            if old in c.excludes.get(t, []) or (c.exclude_metadata and is_own(old)):
                problems.append(f"export.renames.{t}.{old}: the column is left out")
    if problems:
        raise ConfigError(problems)
    return c, ids


def shaped(df: DataFrame, c: ExportConfig, name: str) -> DataFrame:
    """The columns of an object's file: framework columns and excludes go, renames apply, values become exact text."""
    names = [n for n in df.columns if not (c.exclude_metadata and is_own(n)) and n not in c.excludes.get(name, [])]
    new = [c.renames.get(name, {}).get(n, n) for n in names]
    return df.select(*[export_text(q(n), df.schema[n].dataType).alias(a) for n, a in zip(names, new, strict=True)])


def column_problems(df: DataFrame, c: ExportConfig, name: str) -> list[str]:
    named = [*c.excludes.get(name, []), *c.renames.get(name, {})]
    out = [f"{name} has no column {n}" for n in named if n not in df.columns]
    left = shaped(df, c, name).columns if not out else ["?"]
    if not left:
        out.append(f"{name} has no columns left")
    if len({x.lower() for x in left}) < len(left):
        out.append(f"{name} has two columns of one name")
    return out


def write_csv(df: DataFrame, folder: str) -> None:
    """RFC 4180: quotes doubled, nothing trimmed, null empty and the empty string quoted. Rows are written by as many tasks as read them, the header apart."""
    exact = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": '""', "lineSep": "\n", "encoding": "UTF-8"}
    df.limit(0).coalesce(1).write.mode("overwrite").options(header="true", **exact).csv(f"{folder}/header")
    df.write.mode("overwrite").options(header="false", **exact).csv(f"{folder}/rows")


def joined(fs: Files, folder: str, local: str) -> None:
    """The header and the parts of the rows, one after the other, as one local file; streamed."""
    out = fs.jvm.java.io.FileOutputStream(local)
    try:
        for sub in ("header", "rows"):
            parts = [n for n in fs.names(f"{folder}/{sub}") if n.startswith("part-")]
            for n in sorted(parts, key=lambda n: (len(n), n)):
                stream = fs.fs.open(fs.path(f"{folder}/{sub}/{n}"))
                try:
                    fs.jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out)
                finally:
                    stream.close()
    finally:
        out.close()


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A file that an export wrote, as text, read by a task for each of its blocks though quoted values hold line feeds.

    A line starts a record if the quotes before it are even in number. A first pass
    counts them by block; records that blocks cut in two are put together at the end.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("size"))
    quotes = F.length("value") - F.length(F.call_function("replace", F.col("value"), F.lit('"')))
    odd, sums = {}, 0
    for block, size, n in sorted(lines.groupBy("block", "size").agg(F.sum(quotes)).collect()):
        odd[block, size], sums = sums % 2, sums + n
    of = lambda cut: lines.mapInArrow(records(odd, cut), "value string, block long, tail boolean, top boolean")
    pieces = of(True).select("*", F.count(F.when(F.col("tail"), 1)).over(W.orderBy("block", "tail")).alias("record"))
    glued = pieces.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("block", "tail", "value")))["value"].alias("parts"), F.max("top").alias("top"))
    rows = of(False).where("not top").select("value").unionAll(glued.where("not top").select(F.array_join("parts", "\n")))
    head = first_record(Files(spark, path), path, '"').decode()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in next(csv.reader(io.StringIO(head, newline="")), [])])
    exact = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "", "mode": "FAILFAST"}
    fields = F.from_csv("value", schema.toDDL(), exact | options)
    return rows.where("value <> ''").select(fields.alias("r")).select("r.*")


def digest_and_count(stream, algorithm: str) -> tuple[str, int]:
    """Checksum of a CSV file and its records (line feeds outside quotes, less the header), in one read."""
    h, feeds, inside = hashlib.new(algorithm), 0, False
    while chunk := stream.read(CHUNK):
        h.update(chunk)
        parts = chunk.split(b'"')
        for i, p in enumerate(parts):
            if i:
                inside = not inside
            if not inside:
                feeds += p.count(b"\n")
    return h.hexdigest(), max(feeds - 1, 0)


def records(odd: dict[tuple[int, int], int], cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from the lines of blocks to their whole records or, with ``cut``, to the pieces of records that a block's end cuts.

    ``odd`` tells of every block, by its begin and size, whether it begins inside quotes; other blocks fail. A record's first piece
    is its ``tail``, the tail of a block; ``top`` marks the file's first record.
    """

    def rows(texts: pa.Array, block: int, tail: bool, top: np.ndarray) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([texts, pa.array(np.full(n, block)), pa.array(np.full(n, tail)), pa.array(top)], ["value", "block", "tail", "top"])

    def run(batches):
        block, inside, fresh, tail, top = None, 0, False, False, False
        held: list[str] = []  # lines of a record that is open

        def closed(complete: bool):
            if held:
                text = pa.array(["\n".join(held)])
                held.clear()
                if cut != (tail and complete):
                    yield rows(text, block, tail, np.array([top]))

        for batch in batches:
            values, blocks = batch.column(0), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if at == end:
                    continue
                if blocks[at] != block:
                    yield from closed(False)
                    block = int(blocks[at])
                    inside, fresh, tail, top = odd[block, batch.column(2)[at].as_py()], block == 0, False, False
                part = values.slice(at, end - at)
                seen = inside + np.cumsum(pc.count_substring(part, '"').to_numpy())
                begins = np.flatnonzero(np.concatenate([[inside], seen[:-1]]) % 2 == 0)
                inside = int(seen[-1] % 2)
                n = int(begins[0]) if len(begins) else len(part)
                held.extend(part.slice(0, n).to_pylist())
                if len(begins) or not inside:
                    yield from closed(True)
                if not len(begins):
                    continue
                last = len(begins) - inside  # of the records that begin here, the last may be open
                if last and not cut:
                    stop = int(begins[last]) if inside else len(part)
                    texts = part.slice(n, stop - n)
                    if last < stop - n:
                        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begins[:last], stop) - n, pa.int32()), texts), "\n")
                    yield rows(texts, block, True, fresh & (np.arange(last) == 0))
                if inside:
                    held.extend(part.slice(int(begins[-1])).to_pylist())
                    tail, top = True, fresh and not last
                fresh = False
        yield from closed(False)

    return run


def listed(spark: SparkSession, store: Store, catalog: str, schema: str) -> dict[str, str]:
    """What a schema holds: the store's tables, and views of the session's catalog; a temporary view belongs to no schema."""
    views = spark.catalog.listTables(schema) if spark.catalog.databaseExists(schema) else []
    return {t.name: "view" for t in views if not t.isTemporary} | dict.fromkeys(store.tables(catalog, schema), "table")


def run_export(spark: SparkSession, warehouse: str, flat: dict) -> list[str]:
    """Export every object, or deliver nothing; returns the names of the delivered files."""
    c, ids = load_export_config(flat)
    store = Store(spark, warehouse)
    catalog = f"{c.catalog}_{c.env}"
    audit = Audit(store, c.env, ids, (catalog, c.schema_name, None))
    stamp = datetime.now(ZoneInfo(c.timezone)).strftime(c.stamp_format)
    problems, plan = [], []
    found = listed(spark, store, catalog, c.schema_name)
    spelled = {n.lower(): n for n in found}
    named = lambda settings: {spelled.get(n.lower(), n): v for n, v in settings.items()}
    c.excludes, c.renames = named(c.excludes), named(c.renames)
    objects = [spelled.get(n.lower(), n) for n in c.tables] or sorted(found)
    for name in dict.fromkeys(objects):
        if name not in found:
            problems.append(f"no table or view {name}")
            continue
        if found[name] == "table":
            table = store.table(f"{catalog}.{c.schema_name}.{name}")
            df, version = table.read(v := table.version), v
        else:
            df, version = spark.table(f"`{c.schema_name}`.`{name}`"), None
        problems += column_problems(df, c, name)
        plan.append((name, df, version))
    for n in sorted({*c.excludes, *c.renames} - set(objects)):
        audit.log("WARNING", "export_setting_unused", "export", description=f"settings name {n}, which is not exported")
    if problems:
        audit.flush()
        raise ConfigError(problems)
    temp = f"{c.preparation_path.rstrip('/')}/exports_temp/{c.name}"
    fs = Files(spark, c.preparation_path)
    if fs.exists(temp):
        fs.delete(temp)
    work = tempfile.mkdtemp(prefix="export-")  # the driver's own files, gone when the run ends
    failed, manifest, files = [], [], []
    try:
        for name, df, version in plan:
            try:
                write_csv(shaped(df, c, name), f"{temp}/{name}")
                file = f"{name}_{stamp}.csv" if c.with_ts_object_names else f"{name}.csv"
                joined(fs, f"{temp}/{name}", f"{work}/{file}")
                with open(f"{work}/{file}", "rb") as f:
                    checksum, rows = digest_and_count(f, c.checksum)
                if version is not None and (there := df.count()) != rows:
                    raise PlatformViolation("export_row_count_mismatch", f"{name}: {rows} records in the file, {there} rows in version {version}")
                audit.kpi("rows_exported", rows)
                if rows or not c.skip_empty:
                    manifest.append([name, "table" if version is not None else "view", "" if version is None else version, rows, file, checksum])
                    files.append(file)
                else:
                    os.remove(f"{work}/{file}")
            except Exception as e:
                failed.append(f"{name}: {e}")
                audit.log("ERROR", "export_object_failed", "export", description=f"{name}: {e}"[:4000])
        if failed:
            audit.log("ERROR", "export_failure", "export", description="; ".join(failed)[:4000])
            raise RuntimeError("nothing was delivered; " + "; ".join(failed))
        out = package(c, stamp, work, files, manifest)
        goal = c.destination or f"{c.preparation_path.rstrip('/')}/deliveries/{c.name}"
        target = Files(spark, goal)
        target.fs.mkdirs(target.path(goal))
        facts = {file: {"object": name, "version": version, "rows": rows} for name, _, version, rows, file, _ in manifest}
        for file in out:  # what marks the delivery as complete comes last
            with open(f"{work}/{file}", "rb") as f:
                checksum = hashlib.file_digest(f, c.checksum).hexdigest()
            place = f"{goal.rstrip('/')}/{file}"
            target.fs.copyFromLocalFile(False, True, target.path(f"file://{work}/{file}"), target.path(place))
            audit.log("INFO", "file_delivered", "export", description=file, metadata=facts.get(file, {}) | {"checksum": checksum, "algorithm": c.checksum, "location": place})
        return out
    finally:
        audit.flush()
        shutil.rmtree(work, ignore_errors=True)


def package(c: ExportConfig, stamp: str, work: str, files: list[str], manifest: list[list]) -> list[str]:
    """The files to deliver, in order: data, then the manifest and its checksum."""

    def sums(name: str) -> str:
        with open(f"{work}/{name}", "rb") as f:
            text = f"{hashlib.file_digest(f, c.checksum).hexdigest()}  {name}\n"
        with open(f"{work}/{name}.{c.checksum}", "w") as f:
            f.write(text)
        return f"{name}.{c.checksum}"

    if c.package == "zip":
        name = f"{c.name}_{stamp}.zip" if c.with_ts_zip else f"{c.name}.zip"
        with zipfile.ZipFile(f"{work}/{name}", "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f"{work}/{f}", f)
        out = [name] + ([sums(name)] if c.with_zip_checksum else [])
    else:
        out = [x for f in files for x in (f, sums(f))]
    if c.with_manifest:
        text = io.StringIO()
        w = csv.writer(text, lineterminator="\n")
        w.writerow(["object", "object_type", "version", "row_count", "export_file_name", "checksum"])
        w.writerows(manifest)
        name = f"{c.name}_{stamp}_manifest.csv"
        with open(f"{work}/{name}", "w") as f:
            f.write(text.getvalue())
        out += [name, sums(name)]
    return out
