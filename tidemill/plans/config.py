"""Task configuration: flat dotted keys to validated settings, with all problems reported at once."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from typing import Any

try:
    import yaml
except ImportError:  # JSON is understood without it, and is YAML
    yaml = None

from ..functions.columns import is_own
from ..operators.batch import Check, Time, load_checks
from ..operators.errors import ConfigError
from ..operators.shape import PREPROCESSORS, Cast
from .audit import Identity


def parsed(text: str):
    if yaml is not None:
        return yaml.safe_load(text)
    return json.loads(text) if text.strip() else None


EVOLUTION = ("add_new_columns", "add_new_columns_with_type_widening", "fail_on_new_columns", "none")
STRATEGIES = ("checkpoint", "watermark", "full_read", "delta_read")
FILE_ORIGINS = ("csv", "json", "sas")
ORIGINS = (*FILE_ORIGINS, "table")
#: Strategies an origin can be read with.
READABLE = {o: ("checkpoint",) for o in FILE_ORIGINS} | {"table": STRATEGIES}


@dataclass(frozen=True)
class Needs:
    """What a verb needs and supports; the first strategy is its default."""

    keys: bool
    event_time: bool = False
    deletes: bool = False
    full_scope: bool = False
    origins: tuple[str, ...] = ORIGINS
    per_snapshot: bool = False
    strategies: tuple[str, ...] = ("checkpoint", "full_read", "delta_read")
    layout: str = "keys"  # exports | keys | none


VERBS = {
    "append": Needs(keys=False, layout="exports"),
    "full": Needs(keys=False, strategies=("checkpoint", "full_read"), layout="none"),
    "upsert": Needs(keys=True),
    "scd2": Needs(keys=True, event_time=True, strategies=("checkpoint", "watermark", "full_read", "delta_read")),
    "complete_delta": Needs(keys=True, event_time=True, deletes=True, full_scope=True, origins=("table",), per_snapshot=True, strategies=("watermark", "full_read", "delta_read")),
}


@dataclass
class TimeSetting:
    column: str | None = None
    format: str | None = None

    def time(self) -> Time:
        return Time(self.column, self.format)


@dataclass
class Options:
    header: bool = True
    delimiter: str = ","
    quote: str = ""
    escape: str = "\\"
    multiline: bool = True
    schema_hints: str | None = None


@dataclass
class Source:
    origin: str = ""
    path: str | None = None
    directory: str | None = None
    file_extension: str | None = None
    anchor_dt: TimeSetting = field(default_factory=TimeSetting)
    snapshot_time_pattern: str = "datetime"
    preprocessors: list[str] = field(default_factory=list)
    envelope_fields: list[str] = field(default_factory=list)
    rename_patterns: list[str] = field(default_factory=list)
    options: Options = field(default_factory=Options)
    catalog: str | None = None
    schema_name: str | None = None
    table: str | None = None
    deletes_table: str | None = None
    increment_strategy: str | None = None
    increment_anchor: bool = False


@dataclass
class Typing:
    validate_casts: bool = True


@dataclass
class Policies:
    checks_file: str | None = None


@dataclass
class Dedup:
    enabled: bool = True
    columns: list[str] = field(default_factory=list)
    order_by: str | None = None
    order_by_format: str | None = None


@dataclass
class Deletes:
    keys: list[str] = field(default_factory=list)
    event_time: TimeSetting = field(default_factory=TimeSetting)


@dataclass
class Output:
    verb: str = ""
    schema_name: str = ""
    table: str = ""
    keys: list[str] = field(default_factory=list)
    event_time: TimeSetting = field(default_factory=TimeSetting)
    snapshot_scope: str = "delta"
    dedup: Dedup = field(default_factory=Dedup)
    deletes: Deletes = field(default_factory=Deletes)


@dataclass
class TaskConfig:
    catalog: str = ""
    env: str = ""
    metadata_path: str = ""
    table_config: str | None = None
    schema_evolution: str = "fail_on_new_columns"
    source: Source = field(default_factory=Source)
    typing: Typing = field(default_factory=Typing)
    policies: Policies = field(default_factory=Policies)
    output: Output = field(default_factory=Output)


CHOICES = {
    "schema_evolution": EVOLUTION,
    "source.origin": ORIGINS,
    "source.snapshot_time_pattern": ("datetime", "iso"),
    "source.increment_strategy": STRATEGIES,
    "output.verb": tuple(VERBS),
    "output.snapshot_scope": ("delta", "full"),
}
REQUIRED = ("catalog", "env", "metadata_path", "source.origin", "output.verb", "output.schema_name", "output.table")


def nested(flat: dict[str, Any], problems: list[str]) -> dict:
    """Dotted keys as nested dicts; a key that is both a value and a namespace is a problem."""
    out: dict = {}
    for key, value in flat.items():
        *path, last = key.split(".")
        at = out
        for p in path:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                break
        if not isinstance(at, dict) or isinstance(at.get(last), dict):
            problems.append(f"{key} is used both as a value and as a namespace")
        else:
            at[last] = value
    return out


def coerced(kind: str, value: Any, name: str, problems: list[str]) -> Any:
    if kind == "bool":
        text = str(value).strip().lower()
        if text not in ("true", "false"):
            problems.append(f"{name} must be true or false, not {value!r}")
        return text == "true"
    if kind.startswith("list"):
        return [x.strip() for x in (value.split(",") if isinstance(value, str) else value) if str(x).strip()]
    text = None if value is None else str(value)
    if name in CHOICES and text is not None:
        text = text.strip().lower()
        if text and text not in CHOICES[name]:
            problems.append(f"{name} must be one of {', '.join(CHOICES[name])}, not {value!r}")
    return text if text != "" or name.endswith("quote") else None if "None" in kind else text


def filled(cls, data: dict, prefix: str, problems: list[str]):
    known = {f.name: f for f in fields(cls)}
    out = cls()
    for key, value in data.items():
        name = f"{prefix}{key}"
        if key not in known:
            problems.append(f"unknown setting {name}")
            continue
        current = getattr(out, key)
        if hasattr(current, "__dataclass_fields__"):
            if isinstance(value, dict):
                setattr(out, key, filled(type(current), value, f"{name}.", problems))
            else:
                problems.append(f"{name} is a namespace, not a value")
        elif isinstance(value, dict):
            problems += [f"unknown setting {name}.{k}" for k in value]
        else:
            setattr(out, key, coerced(str(known[key].type), value, name, problems))
    return out


def load_config(flat: dict[str, Any]) -> tuple[TaskConfig, Identity, list[str]]:
    """(settings, run identity, names of identity parameters that were absent); raises ConfigError with every problem."""
    flat, problems = dict(flat), []
    ids = {f.name: flat.pop(f"__{f.name}", None) for f in fields(Identity)}
    problems += [f"reserved parameter {k}" for k in flat if k.startswith("__")]
    config = filled(TaskConfig, nested({k: v for k, v in flat.items() if not k.startswith("__")}, problems), "", problems)
    for name in REQUIRED:
        at: Any = config
        for p in name.split("."):
            at = getattr(at, p)
        if not at:
            problems.append(f"{name} is required")
    problems += source_problems(config) + (matrix_problems(config) if config.output.verb in VERBS and config.source.origin in ORIGINS else [])
    if config.output.table and config.output.table != config.output.table.upper():
        problems.append("output.table must be upper case")
    if problems:
        raise ConfigError(problems)
    absent = [k for k, v in ids.items() if v is None]
    return config, Identity(**{k: v or "local" for k, v in ids.items()}), absent


def rename_pairs(patterns: list[str]) -> list[tuple[str, str]]:
    out = []
    for p in patterns:
        regex, eq, to = p.rpartition("=")
        if not eq or not regex:
            raise ValueError(f"not a regex=replacement pair: {p!r}")
        re.compile(regex)
        out.append((regex, to))
    return out


def source_problems(c: TaskConfig) -> list[str]:
    s, out = c.source, []
    files = s.origin in FILE_ORIGINS
    if files:
        out += [f"source.{n} is required for files" for n in ("path", "directory") if not getattr(s, n)]
        out += [f"source.{n} applies to tables only" for n in ("catalog", "schema_name", "table", "deletes_table") if getattr(s, n)]
    elif s.origin == "table":
        out += [f"source.{n} is required for tables" for n in ("schema_name", "table") if not getattr(s, n)]
        out += [f"source.{n} applies to files only" for n in ("path", "directory", "file_extension") if getattr(s, n)]
        if s.anchor_dt.column and s.increment_strategy != "delta_read":
            out.append("source.anchor_dt of a table needs source.increment_strategy=delta_read")
    if s.options.schema_hints and s.origin != "json":
        out.append("source.options.schema_hints applies to json only")
    if s.anchor_dt.format and not s.anchor_dt.column:
        out.append("source.anchor_dt.format needs source.anchor_dt.column")
    try:
        rename_pairs(s.rename_patterns)
    except (ValueError, re.error) as e:
        out.append(f"source.rename_patterns: {e}")
    out += [f"source.preprocessors: {n} is not registered (registered: {', '.join(sorted(PREPROCESSORS))})" for n in s.preprocessors if n not in PREPROCESSORS]
    if bool(s.envelope_fields) != ("record_envelope" in s.preprocessors):
        out.append("source.envelope_fields and source.preprocessors=record_envelope need each other")
    return out


#: What a task may make use of, and the setting that says so. A verb supports some of it.
FEATURES = {
    "keys": "output.keys",
    "deletes": "a deletes feed",
    "full scope": "output.snapshot_scope=full",
}
#: Features that exclude each other: what would go wrong.
CONFLICTS = {
    ("delta_read", "full scope"): "records that did not change would be taken for gone",
    ("delta_read", "deletes"): "a mark of changed records says nothing about deletes; read the feed by a task of its own",
    ("delta_read", "anchor layout"): "a mark can only be compared with a date or timestamp column",
    ("record mark", "full scope"): "records that did not change would be taken for gone",
}
#: Features that need another one.
DEPENDS = {
    "delta_read": ("anchor column", "source.anchor_dt.column tells when a row last changed"),
    "record mark": ("watermark", "source.increment_anchor says which column a watermark follows"),
}


def features(c: TaskConfig, strategy: str) -> set[str]:
    """What a configuration makes use of."""
    s, o = c.source, c.output
    feed = {"deletes table": s.deletes_table, "delete keys": o.deletes.keys, "delete time": o.deletes.event_time.column}
    used = {
        strategy: True,
        "keys": o.keys,
        "event time": o.event_time.column,
        "order": not o.dedup.enabled or o.dedup.order_by or o.event_time.column,
        "deletes": any(feed.values()),
        "full scope": o.snapshot_scope == "full",
        "anchor column": s.anchor_dt.column,
        "anchor layout": s.anchor_dt.format,
        "record mark": s.increment_anchor,
        **feed,
    }
    return {name for name, on in used.items() if on}


def matrix_problems(c: TaskConfig) -> list[str]:
    """What a verb lacks, cannot use, or cannot combine."""
    verb, origin = c.output.verb, c.source.origin
    need = VERBS[verb]
    strategy = c.source.increment_strategy or need.strategies[0]
    have = features(c, strategy)
    supported = {"keys": need.keys, "deletes": need.deletes, "full scope": need.full_scope}
    out = [f"{text} has no meaning for the verb {verb}" for f, text in FEATURES.items() if f in have and not supported[f]]
    missing = {"output.keys": need.keys and "keys" not in have, "output.event_time.column": need.event_time and "event time" not in have}
    out += [f"the verb {verb} cannot do without {name}" for name, gap in missing.items() if gap]
    if need.keys and not need.event_time and "order" not in have:
        out.append(f"the verb {verb} keeps the latest row of a key: name its order (output.event_time.column, output.dedup.order_by) or switch output.dedup.enabled off")
    parts = {"deletes table": "source.deletes_table", "delete keys": "output.deletes.keys", "delete time": "output.deletes.event_time.column"}
    if need.deletes and "deletes" in have:
        out += [f"the deletes feed lacks {name}" for part, name in parts.items() if part not in have]
    if origin not in need.origins:
        out.append(f"the verb {verb} takes no {origin} source, only {', '.join(need.origins)}")
    elif strategy not in need.strategies or strategy not in READABLE[origin]:
        fit = [x for x in need.strategies if x in READABLE[origin]]
        return [*out, f"source.increment_strategy={strategy} does not go with {origin} and {verb}; {', '.join(fit)} would"]
    out += [f"{a} and {b} exclude each other: {why}" for (a, b), why in CONFLICTS.items() if {a, b} <= have]
    return out + [f"{f} needs {other}: {why}" for f, (other, why) in DEPENDS.items() if f in have and other not in have]


# ---------------------------------------------------------------- detached files
@dataclass(frozen=True)
class TableConfig:
    comment: str | None = None
    tags: dict = field(default_factory=dict)
    casts: list[Cast] = field(default_factory=list)
    comments: dict = field(default_factory=dict)
    column_tags: dict = field(default_factory=dict)


def load_table_config(text: str) -> TableConfig:
    """A table's comment, tags, column types and column comments from YAML; raises ConfigError."""
    data, wrong = parsed(text), []
    if not isinstance(data, dict) or not any(data.get(k) for k in ("comment", "tags", "columns")):
        raise ConfigError(["a table config must set comment, tags or columns"])

    def extra(d: dict, allowed: set, where: str):
        wrong.extend(f"{where}: unknown key {k}" for k in d if k not in allowed)

    def tags_of(d: dict, where: str) -> dict:
        tags = d.get("tags") or {}
        wrong.extend(f"{where}: tag {k}: {v!r} is not text; quote it" for k, v in tags.items() if not isinstance(k, str) or not isinstance(v, str))
        return tags

    def comment_of(d: dict, where: str) -> str | None:
        if "comment" in d and not str(d["comment"] or "").strip():
            wrong.append(f"{where}: blank comment")
        return d.get("comment")

    extra(data, {"comment", "tags", "columns"}, "table")
    casts, comments, column_tags, seen = [], {}, {}, set()
    for c in data.get("columns") or []:
        name = c.get("name")
        where = f"column {name}"
        extra(c, {"name", "cast", "comment", "tags"}, where)
        if not name or name in seen or is_own(name):
            wrong.append(f"{where}: a name that is missing, listed twice or the engine's own")
        seen.add(name)
        if set(c) <= {"name"}:
            wrong.append(f"{where}: sets nothing")
        cast = c.get("cast") or {}
        extra(cast, {"target_type", "format"}, where)
        if cast and not cast.get("target_type"):
            wrong.append(f"{where}: cast without target_type")
        if cast.get("format") and str(cast.get("target_type")).lower() not in ("date", "timestamp"):
            wrong.append(f"{where}: format applies to date and timestamp")
        casts.append(Cast(name, cast.get("target_type"), cast.get("format")))
        if comment := comment_of(c, where):
            comments[name] = comment
        if t := tags_of(c, where):
            column_tags[name] = t
    out = TableConfig(comment_of(data, "table"), tags_of(data, "table"), casts, comments, column_tags)
    if wrong:
        raise ConfigError(wrong)
    return out


def load_ruleset(text: str) -> list[Check]:
    return load_checks(parsed(text))
