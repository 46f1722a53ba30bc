"""Physical layout and metadata of a target table."""

from __future__ import annotations

from pyspark.sql import types as T

from ..functions.columns import ANCHOR, COMMENTS, CURRENT, EXPORT_DATE
from ..sources.store import Commit, Table
from .config import TableConfig


def leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    """Leaf columns in order, structs dotted; arrays and maps are no leaves."""
    out = []
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, f"{prefix}{f.name}.")
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(prefix + f.name)
    return out


def stats_columns(schema: T.StructType, clustering: list[str], count: int = 32) -> list[str]:
    """The first leaves, then those that readers filter by."""
    have = leaves(schema)
    out = have[:count]
    return out + [c for c in dict.fromkeys([EXPORT_DATE, ANCHOR, *clustering]) if c in have and c not in out]


def clustering_columns(schema: T.StructType, layout: str, keys: list[str], most: int = 4) -> list[str]:
    """By exports, or by keys with the current flag keeping its seat; the table's own spelling counts."""
    spelled = {f.name.lower(): f.name for f in schema}
    own = lambda names: [spelled[n.lower()] for n in names if n.lower() in spelled]
    if layout == "exports":
        return own([EXPORT_DATE, ANCHOR])
    if layout == "keys":
        flag = own([CURRENT])
        return own(keys)[: most - len(flag)] + flag
    return []


def apply_layout(table: Table, layout: str, keys: list[str]) -> Commit | None:
    schema = table.commit_at().struct
    clustering = clustering_columns(schema, layout, keys)
    return table.alter(properties={"clustering": clustering, "stats": stats_columns(schema, clustering)})


def apply_metadata(table: Table, config: TableConfig | None) -> Commit | None:
    """Comments and tags where they differ; the engine's columns keep its own comments."""
    names = table.commit_at().struct.names
    comments = {c: t for c, t in COMMENTS.items() if c in names}
    if config is None:
        return table.alter(comments=comments)
    tags = {"table": config.tags} if config.tags else {}
    return table.alter(comment=config.comment, comments=comments | config.comments, tags=tags | {f"column {c}": t for c, t in config.column_tags.items()})
