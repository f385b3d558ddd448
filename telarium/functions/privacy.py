"""Field classes: redaction and stripping of nested columns, canonical hashes.

Struct columns are rewritten when the plan is made, from their schema, so the
work stays in generated code. Only payloads without a schema (JSON text) are
walked in Python, in Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"

#: Fields that may be shown, and fields that may not. All others are unknown.
PUBLIC = (
    "pid", "parent_pid", "tid", "exit_code", "level", "source_port", "destination_port", "bytes_sent",
    "bytes_received", "size", "bytes_written", "started_at", "exited_at", "initiated_at", "ended_at", "created_at",
    "written_at", "deleted_at", "renamed_at", "set_at", "queried_at", "loaded_at", "image_hash", "signed",
    "signer", "integrity_level", "protocol", "query_type", "response_code", "id", "event_id", "schema_version",
    "source", "rule_id", "alert_id", "severity", "status", "kind", "mitre_techniques", "enabled",
    "message_number", "message_total", "recorded_at",
)
INTERNAL = (
    "source_ip", "destination_ip", "provider", "hostname", "os", "labels", "first_seen", "last_seen",
    "script_block_id",
)
SENSITIVE = (
    "command_line", "user", "executable", "image_path", "path", "old_path", "new_path", "working_directory",
    "key_path", "value_name", "value_data", "query_name", "answers", "title", "description", "host",
    "host_id", "events", "text",
)

#: Days for which a class is kept.
RETENTION_DAYS = {"public": 365, "internal": 365, "sensitive": 90}
#: The oldest row of a tier, in days.
TIER_DAYS = {"hot": 30, "warm": 90, "cold": 365}

SHOWN, HIDDEN = frozenset(PUBLIC) | frozenset(INTERNAL), frozenset(SENSITIVE)


def field_class(name: Column) -> Column:
    """public, internal or sensitive; an unknown field counts as sensitive."""
    return F.when(name.isin(*PUBLIC), "public").when(name.isin(*INTERNAL), "internal").otherwise("sensitive")


def retention_days(name: Column) -> Column:
    out = F.lit(RETENTION_DAYS["sensitive"])
    for field, days in RETENTION_DAYS.items():
        out = F.when(field_class(name) == field, days).otherwise(out)
    return out


def retained(rows: DataFrame, age_days: Column, keys: tuple[str, ...] = ("id", "host", "us", "kind")) -> DataFrame:
    """``rows`` with ``tier``; each column goes when its class's days are over, and a row when the last tier's are.

    ``keys`` are kept as long as the row.
    """
    tier = F
    for name, days in TIER_DAYS.items():
        tier = tier.when(age_days <= days, name)
    days_of = lambda c: RETENTION_DAYS["sensitive" if c not in SHOWN else "internal"]
    columns = [F.col(c) if c in keys else F.when(age_days <= days_of(c), F.col(c)).alias(c) for c in rows.columns]
    return rows.where(age_days <= TIER_DAYS["cold"]).select(*columns, tier.alias("tier"))


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType | T.ArrayType | T.MapType)


def _whole(value: Column, fields: list[Column]) -> Column:
    return F.when(value.isNotNull(), F.struct(*fields))


def redact(value: Column, kind: T.DataType) -> Column:
    """Same shape; sensitive fields and unknown scalars become ``REDACTED``.

    A map's keys are data: its scalar values become text. Where its values are
    nested, a sensitive key has null, as one map has one type of value. Null
    containers stay null.
    """
    if isinstance(kind, T.StructType):
        hide = lambda f: f.name in HIDDEN or (f.name not in SHOWN and not _nested(f.dataType))
        return _whole(value, [(F.lit(REDACTED) if hide(f) else redact(value.getField(f.name), f.dataType)).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact(x, kind.elementType)) if _nested(kind.elementType) else value
    if isinstance(kind, T.MapType):
        if _nested(kind.valueType):
            return F.transform_values(value, lambda k, v: F.when(~k.isin(*SENSITIVE), redact(v, kind.valueType)))
        return F.transform_values(value, lambda k, v: F.when(k.isin(sorted(SHOWN)), v.cast("string")).otherwise(REDACTED))
    return value


def strip(value: Column, kind: T.DataType) -> Column:
    """Without sensitive and unknown fields. A struct of which nothing stays is null."""
    if isinstance(kind, T.StructType):
        fields = [strip(value.getField(f.name), f.dataType).alias(f.name) for f in kind if f.name in SHOWN]
        return _whole(value, fields) if fields else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: strip(x, kind.elementType)) if _nested(kind.elementType) else value
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda k, v: k.isin(sorted(SHOWN)))
        return F.transform_values(kept, lambda k, v: strip(v, kind.valueType)) if _nested(kind.valueType) else kept
    return value


def _hide(value: object) -> object:
    if isinstance(value, list):
        return [_hide(x) for x in value]
    if isinstance(value, dict):
        return {k: _hide(v) if k in SHOWN or (k not in HIDDEN and isinstance(v, dict | list)) else REDACTED for k, v in value.items()}
    return value


def redact_json(payload: Column) -> Column:
    """``redact`` for JSON text of unknown shape; text that is no JSON is hidden whole."""

    @F.pandas_udf("string")
    def walk(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(_hide(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return REDACTED

        return texts.map(one)

    return walk(payload)


def _sorted_fields(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return _whole(value, [_sorted_fields(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType) and _nested(kind.elementType):
        return F.transform(value, lambda x: _sorted_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        inner = F.transform_values(value, lambda k, v: _sorted_fields(v, kind.valueType)) if _nested(kind.valueType) else value
        return F.map_from_entries(F.array_sort(F.map_entries(inner), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    return value


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON with sorted keys at every depth; nulls are written."""
    return F.to_json(_sorted_fields(value, kind), {"ignoreNullFields": "false"})


def canonical_hash(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical_json(value, kind), 256)
