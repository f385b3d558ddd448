"""Raw events to typed telemetry: a shape by provider and id, fields by their spellings, failures with a reason.

A projection for each shape over the rows of its provider and id, a filter
that reaches the scan; nothing is shuffled but for the optional look-ups (registry keys by handle, device mounts and image metadata by path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.functions import decoding as dec
from telarium.functions.scalars import filetime
from telarium.sources.shapes import CHAINS, REQUIRED, SHAPES

SCRIPT_BYTES = 8192


def shape_table(spark) -> DataFrame:
    return spark.createDataFrame(list(SHAPES), "provider string, event_id int, shape string, kernel boolean")


def text(chain: str) -> Column:
    """The first spelling that is there and not empty."""
    return F.coalesce(*(F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in CHAINS[chain]))


def number(chain: str, kind: str = "bigint") -> Column:
    """The first spelling that is a number."""
    return F.coalesce(*(F.try_element_at("fields", F.lit(n)).try_cast(kind) for n in CHAINS[chain]))


def address(chain: str) -> Column:
    """The first spelling that is an address: a number, or bytes written as 0x and hex."""
    fits = lambda raw: F.when(raw.rlike("^(?:[0-9]+|0x(?:[0-9A-Fa-f]{8}|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{56}))$"), raw)
    raw = F.coalesce(*(fits(F.try_element_at("fields", F.lit(n))) for n in CHAINS[chain]))
    return F.when(raw.startswith("0x"), dec.ip_of_bytes(F.unhex(F.substring(raw, 3, 56)))).when(raw.isNotNull(), dec.ip4_of_number(raw.try_cast("bigint")))


def dos_path(path: Column, mounts: Column) -> Column:
    """The path with its longest matching device replaced by that device's root.

    ``mounts``: array of (device, root); null or no match leaves the path as it is.
    """
    fits = F.filter(mounts, lambda m: path.startswith(m["device"]))
    best = F.array_max(F.transform(fits, lambda m: F.struct(F.length(m["device"]).alias("n"), m["root"].alias("root"))))
    return F.when(best.isNull(), path).otherwise(F.concat(best["root"], F.right(path, F.length(path) - best["n"])))


def registry_path(path: Column) -> Column:
    """HKLM, HKU and HKWC for the kernel's roots, only where a component ends."""
    for prefix, root in (("MACHINE", "HKLM"), ("USER", "HKU"), ("WC", "HKWC")):
        path = F.regexp_replace(path, rf"(?i)^\\REGISTRY\\{prefix}(?=\\|$)", root)
    return path


def capped_text(value: Column, most: int = SCRIPT_BYTES) -> Column:
    """At most ``most`` bytes, cut at a character's border."""
    raw = F.substring(F.encode(value, "UTF-8"), 1, most)
    whole = lambda n: F.when(F.is_valid_utf8(F.substring(raw, 1, most - n)), F.decode(F.substring(raw, 1, most - n), "UTF-8"))
    return F.when(F.octet_length(value) <= most, value).otherwise(F.coalesce(*(whole(n) for n in range(4))))


def with_mounts(rows: DataFrame, mounts: DataFrame) -> DataFrame:
    """``rows`` with ``mounts``, those of its host (a few rows each)."""
    each = mounts.groupBy("host").agg(F.collect_list(F.struct("device", "root")).alias("mounts"))
    return rows.join(each, "host", "left")


#: What a shape may carry beside ``kind`` and ``pid``.
TYPED = {
    "parent_pid": "bigint", "image": "string", "command_line": "string", "user_name": "string", "reported_parent": "string", "integrity": "string", "exit_code": "bigint",
    "path": "string", "new_path": "string", "old_path": "string", "key_path": "string", "value_name": "string", "value_data": "string", "query_name": "string", "query_type": "string",
    "script_text": "string", "script_block_id": "string", "script_path": "string", "source_ip": "string", "source_port": "int", "destination_ip": "string", "destination_port": "int",
    "bytes_sent": "bigint", "client_machine": "string", "is_local": "boolean", "namespace": "string", "event_filter": "string", "consumer": "string", "task_name": "string",
}


#: The typed column of each required field.
_COLUMNS_OF = {
    "process_start": ("image",), "process_start_audit": ("image",), "process_exit": (), "image_load": ("path",), "registry_set": ("key_path",), "dns_query": ("query_name",), "script_block": ("script_text",),
    "file_create": ("path",), "file_rename": ("new_path",), "file_delete": ("path",), "network_connect": ("source_ip", "destination_ip"), "network_disconnect": ("source_ip", "destination_ip"),
    "wmi_process": ("command_line",), "wmi_subscription": ("namespace", "event_filter"), "task_registered": ("task_name",),
}


def _fields(shape: str, learned: Column, dos) -> dict[str, Column]:
    """The typed columns of a shape; ``pid`` only where the event names its process."""
    start = {"pid": number("process_id"), "parent_pid": number("parent_process_id")}
    new_name = F.coalesce(text("file_new_name"), text("file_old_name"))
    match shape:
        case "process_start":
            return start | {"image": dos(text("image_name"))}
        case "process_start_audit":
            return start | {"image": dos(text("new_process_name")), "command_line": text("command_line"), "user_name": text("subject_user_name"), "reported_parent": dos(text("parent_process_name")), "integrity": dec.integrity_level(text("mandatory_label"))}
        case "process_exit":
            return {"pid": number("process_id"), "exit_code": number("exit_code").bitwiseAND(0xFFFFFFFF)}
        case "image_load":
            return {"pid": number("process_id"), "path": dos(text("image_name"))}
        case "registry_set":
            return {"key_path": registry_path(F.coalesce(text("key_name"), learned)), "value_name": text("value_name"), "value_data": text("captured_data")}
        case "dns_query":
            return {"query_name": text("query_name"), "query_type": F.coalesce(dec.query_type(number("query_type")), F.lit("A"))}
        case "script_block":
            return {"script_text": capped_text(text("script_text")), "script_block_id": text("script_block_id"), "script_path": dos(text("script_path"))}
        case "file_create" | "file_delete":
            return {"path": dos(text("file_name"))}
        case "file_rename":
            return {"new_path": dos(new_name), "old_path": dos(F.coalesce(text("file_old_name"), new_name))}
        case "network_connect" | "network_disconnect":
            network = {"pid": number("net_pid"), "source_ip": address("saddr"), "source_port": F.coalesce(number("sport", "int"), F.lit(0)), "destination_ip": address("daddr"), "destination_port": F.coalesce(number("dport", "int"), F.lit(0))}
            return network if shape == "network_connect" else network | {"bytes_sent": number("size")}
        case "wmi_process":
            return {"pid": number("wmi_created_pid"), "command_line": text("wmi_command_line"), "user_name": text("wmi_user"), "client_machine": text("wmi_client_machine"), "is_local": number("wmi_is_local") != 0}
        case "wmi_subscription":
            return {"namespace": text("wmi_namespace"), "event_filter": text("wmi_event_filter"), "consumer": text("wmi_consumer")}
        case _:
            return {"task_name": text("task_name"), "user_name": text("user_context")}


def translated(raw: DataFrame) -> DataFrame:
    """``raw`` (host, ticks, provider, event_id, pid, fields) with shape, kernel, kind, us, failure and typed columns.

    Optional columns: ``mounts`` (see ``dos_path``) and ``learned_key``, the
    path known for the event's registry handle. A row of no shape has null in
    ``shape``; a row with a reason in ``failure`` is undecodable.
    """
    mounts = F.col("mounts") if "mounts" in raw.columns else F.lit(None).cast("array<struct<device:string,root:string>>")
    learned = F.col("learned_key") if "learned_key" in raw.columns else F.lit(None).cast("string")
    us = filetime(F.col("ticks"))
    keep = [c for c in raw.columns if c not in ("fields", "mounts", "learned_key", "pid", "us", "shape", "kernel", "kind", "failure", *TYPED)]
    none = lambda of: F.lit(None).cast(of)
    empty = {name: none(of).alias(name) for name, of in TYPED.items()}
    any_shape, out = F.lit(False), None
    for provider, event_id, shape, kernel in SHAPES:
        mine = (F.col("provider") == provider) & (F.col("event_id") == event_id)
        any_shape = any_shape | mine
        made = _fields(shape, learned, lambda c: dos_path(c, mounts))
        kind = "process_start" if shape == "process_start_audit" else shape
        typed = [made[name].cast(of).alias(name) if name in made else empty[name] for name, of in TYPED.items()]
        pid = F.coalesce(made["pid"], F.col("pid")) if "pid" in made else F.col("pid")
        part = raw.where(mine).select(*keep, us.alias("us"), pid.alias("pid"), *typed)
        failure = F.when(F.col("us").isNull(), "not a valid time")
        for alternatives, column in zip(REQUIRED[shape], _COLUMNS_OF[shape], strict=True):
            failure = failure.when(F.col(column).isNull(), f"no {CHAINS[alternatives[0]][0]}")
        part = part.select(*keep, "us", F.lit(shape).alias("shape"), F.lit(kernel).alias("kernel"), F.lit(kind).alias("kind"), failure.alias("failure"), "pid", *TYPED)
        out = part if out is None else out.unionAll(part)
    rest = raw.where(~F.coalesce(any_shape, F.lit(False))).select(*keep, us.alias("us"), none("string").alias("shape"), none("boolean").alias("kernel"), none("string").alias("kind"), none("string").alias("failure"), F.col("pid"), *empty.values())
    return out.unionAll(rest)


def with_image_metadata(loads: DataFrame, images: DataFrame) -> DataFrame:
    """Image loads with image_hash, signed and signer of the file as it was known by then.

    ``images``: path, us (when it was read), image_hash, signed, signer. The
    path is compared without regard to case; an unknown file has nulls.
    """
    from telarium.operators.facts import asof_last

    meta = ("image_hash", "signed", "signer")
    known = images.select(F.lower("path").alias("path_key"), "us", F.lit(0).cast("long").alias("id"), F.struct(*meta).alias("meta"))
    found = asof_last(known, loads.drop(*meta).withColumn("path_key", F.lower("path")), ["path_key"], "meta")
    return found.select("*", "meta.*").drop("meta", "path_key")
