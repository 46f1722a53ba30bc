"""Sources of files: discovery as a stream, CSV and JSON readers, schema evolution."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.errors import PlatformViolation
from ..operators.shape import add_provenance
from .store import Files, wider


def inbound_glob(path: str, directory: str, extension: str) -> str:
    """All files of the extension in any case; a leading dot does not count."""
    letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension.lstrip("."))
    return f"{path.rstrip('/')}/{directory.strip('/')}/*.{letters}"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark looks at paths that it is given by a task each, up to 10,000 tasks; here a few tasks look at many each."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class KnownColumns:
    """The columns a source has had so far, kept in the task's schema location, and what a new one means."""

    def __init__(self, spark: SparkSession, location: str, mode: str):
        self.io, self.location, self.mode = Files(spark, location), location, mode

    def load(self) -> T.StructType | None:
        names = [n for n in self.io.names(self.location) if n.endswith(".json")]
        return T.StructType.fromJson(json.loads(self.io.read(f"{self.location}/{names[-1]}"))) if names else None

    def save(self, schema: T.StructType) -> None:
        n = len([x for x in self.io.names(self.location) if x.endswith(".json")])
        self.io.publish(f"{self.location}/{n:010d}.json", schema.json())

    def apply(self, df: DataFrame) -> DataFrame:
        known = self.load()
        if known is None:
            self.save(df.schema)
            return df
        new = [f for f in df.schema if f.name not in known.names]
        if new and self.mode == "fail_on_new_columns":
            raise PlatformViolation("unexpected_columns", f"the source has new columns: {', '.join(f.name for f in new)}", len(new))
        if new and self.mode == "none":
            df, new = df.drop(*[f.name for f in new]), []
        fields = []
        for f in known:
            kind = f.dataType
            if self.mode == "add_new_columns_with_type_widening" and f.name in df.columns:
                kind = wider(kind, df.schema[f.name].dataType)
            fields.append(T.StructField(f.name, kind, True))
        merged = T.StructType(fields + list(new))
        if merged != known:
            self.save(merged)
        return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in merged])


HEADER_BYTES = 1 << 12


def first_record(io: Files, path: str, quote: str) -> bytes:
    """A file's first lines, up to a line break outside quotes."""
    size = HEADER_BYTES
    while True:
        stream = io.fs.open(io.path(path))
        try:
            got = bytes(io.jvm.org.apache.commons.io.IOUtils.toByteArray(io.jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
        finally:
            stream.close()
        at = got.find(b"\n")
        while at >= 0 and quote and got[:at].count(quote.encode()) % 2:
            at = got.find(b"\n", at + 1)
        if at >= 0:
            return got[: at + 1]
        if len(got) < size:
            return got
        size *= 8


def by_header(spark: SparkSession, paths: list[str], opts: dict) -> dict[tuple, list[str]]:
    """Files by their column names.

    Headers are read by threads of the driver, a few KB of each file, and Spark's
    parser sees one file of every distinct header: no job per file.
    """
    io = Files(spark, paths[0])
    with ThreadPoolExecutor(32) as pool:
        heads = list(pool.map(lambda p: first_record(io, p, opts["quote"]), paths))
    alike: dict[bytes, list[str]] = {}
    for head, path in zip(heads, paths, strict=True):
        alike.setdefault(head.rstrip(b"\r\n"), []).append(path)
    out: dict[tuple, list[str]] = {}
    for files in alike.values():
        out.setdefault(tuple(spark.read.options(header="true", **opts).csv(files[0]).columns), []).extend(files)
    return out


def read_csv(spark: SparkSession, paths: list[str], options: dict, pattern: str) -> DataFrame:
    """Delimited text with every column as string. Files are grouped by their header, for Spark maps columns by place."""
    opts = {"sep": options.get("delimiter", ","), "quote": options.get("quote") or '"', "escape": options.get("escape", "\\"), "multiLine": str(options.get("multiline", True)).lower(), "ignoreMissingFiles": "true"}
    with few_listing_tasks(spark):
        if not options.get("header", True):
            df = spark.read.options(header="false", inferSchema="false", **opts).csv(paths)
            return add_provenance(df, pattern)
        out = None
        for names, files in by_header(spark, paths, opts).items():
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            part = add_provenance(spark.read.options(header="true", **opts).schema(schema).csv(files), pattern)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out


def document_schema(spark: SparkSession, reader, paths: list[str]) -> T.StructType:
    """The schema that Spark infers from files of one document each.

    Spark's own inference of such files packs them by size, so thousands of small
    ones are opened by one task. As texts they are dealt over tasks by their number.
    Documents that are not plain UTF-8 (which the reader tells by their first bytes)
    or too large for a row are left to Spark.
    """
    texts = spark.read.option("ignoreMissingFiles", "true").text(paths, wholetext=True)
    first = F.hex(F.substring(F.col("value").cast("binary"), 1, 4))
    plain = F.call_function("is_valid_utf8", "value") & ~first.rlike("^EFBBBF|^(..){0,3}00")
    texts = texts.select(F.when(plain, F.col("value")).otherwise(F.raise_error(F.lit("not plain UTF-8"))).alias("value"))
    strings = getattr(texts._jdf, "as")(spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING())
    try:
        return T.StructType.fromJson(json.loads(reader._jreader.json(strings).schema().json()))
    except PySparkException:
        return reader.json(paths).schema


def read_json(spark: SparkSession, paths: list[str], options: dict, pattern: str) -> DataFrame:
    """JSON documents (one per file unless ``multiline`` is false); ``schema_hints`` fixes columns by DDL."""
    make = lambda: spark.read.options(multiLine=str(options.get("multiline", True)).lower(), ignoreMissingFiles="true", **({"escape": options["escape"]} if options.get("escape") else {}))
    with few_listing_tasks(spark):
        schema = document_schema(spark, make(), paths) if options.get("multiline", True) and len(paths) > 1 else make().json(paths).schema
        if hints := options.get("schema_hints"):
            fixed = T._parse_datatype_string(hints)
            schema = T.StructType([*fixed.fields, *[f for f in schema if f.name.lower() not in {x.name.lower() for x in fixed}]])
        return add_provenance(make().schema(schema).json(paths), pattern)


def read_sas(spark: SparkSession, paths: list[str], options: dict, pattern: str) -> DataFrame:
    raise NotImplementedError("SAS files are accepted in a configuration but cannot be read yet")


READERS = {"csv": read_csv, "json": read_json, "sas": read_sas}
