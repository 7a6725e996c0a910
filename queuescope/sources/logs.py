"""Worker logs: discovery, JSON lines, typed event table, session catalog."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuescope import vocab
from queuescope.functions.fields import display_time, nanos, policy_name, trace_id
from queuescope.operators.scan import Limits, ScanPlan, position

CORRUPT = "_corrupt_record"
#: Why a line is rejected.
NOT_JSON, NO_TIME = "no JSON record", "no readable time"

#: Log files that are numbered in one task.
CATALOG_LIMITS = Limits(group_rows=50_000, slice_rows=25_000)

# A log lies at <duration>/<a>/<b>/<workload>/<repetition>/<policy>/<x>/<y>/.
_PATH = "/".join(["([^/]+)"] * 8) + f"/(?:{vocab.PRECLEANUP}/)?{vocab.LOG_FILE.replace('.', '[.]')}$"
_PATH_PARTS = {"duration": 1, "workload": 4, "repetition": 5, "policy": 6}


def path_attributes(path: Column) -> dict[str, Column]:
    """What a log's path says about its session, counted from the file name upwards."""
    parts = {
        name: F.nullif(F.regexp_extract(path, _PATH, group), F.lit(""))
        for name, group in _PATH_PARTS.items()
    }
    parts["is_precleanup"] = F.contains(F.lower(path), F.lit(vocab.PRECLEANUP))
    return parts


def is_session_of(path: Column, policy: str | None) -> Column:
    """Does the path hold a real session (no start-up chatter) of ``policy`` (any if None)?"""
    return _wanted(path, policy, include_precleanup=False)


def _wanted(path: Column, policy: str | None, include_precleanup: bool) -> Column:
    wanted = F.lit(True)
    if not include_precleanup:
        wanted = ~F.contains(F.lower(path), F.lit(vocab.PRECLEANUP))
    if policy is not None:
        named = policy_name(F.regexp_extract(path, _PATH, _PATH_PARTS["policy"]))
        wanted = wanted & (F.lower(named) == policy.lower())
    return wanted


def _row_order(spark: SparkSession) -> Column:
    """Number that follows the order of lines within a file, also when the file is split.

    The row id of a fresh scan grows within one split; splits of a file are told apart by their
    start, which differs by at least the smallest split size.
    """

    def size_of(name):
        number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", spark.conf.get(name).lower()).groups()
        return int(number) << (10 * " kmgtp".index(unit or " "))

    smallest = min(
        size_of("spark.sql.files.maxPartitionBytes"), size_of("spark.sql.files.openCostInBytes")
    )
    split = F.call_function("div", F.col("_metadata.file_block_start"), F.lit(max(1, smallest)))
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(split.cast("bigint"), 33).bitwiseOR(in_task)


def read_worker_logs(
    spark: SparkSession,
    root: str,
    policy: str | None = None,
    mode: str = "FAILFAST",
    include_precleanup: bool = False,
) -> DataFrame:
    """All session logs below ``root`` in one scan, with a fixed schema.

    ``mode="PERMISSIVE"`` keeps a line that is not JSON in ``_corrupt_record`` instead of failing.
    Give the root folder, not single paths: folder names may contain ``*``.
    """
    schema = T.StructType(vocab.RAW_RECORD.fields)
    if mode == "PERMISSIVE":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    path = F.col("_metadata.file_path")
    scan = (
        spark.read.schema(schema)
        .option("mode", mode)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", vocab.LOG_FILE)
        .json(root)
    )
    # The filter stands on the file's metadata alone, so other files are not even opened.
    kept = scan.filter(_wanted(path, policy, include_precleanup))
    rows = kept.select("*", path.alias("path"), _row_order(spark).alias("seq"))
    return rows.withColumn("session_key", session_key(F.col("path")))


def read_log_lines(
    spark: SparkSession, root: str, policy: str | None = None, include_precleanup: bool = False
) -> DataFrame:
    """(path, session_key, seq, line): the lines of all session logs below ``root``, in one scan.

    Blank lines are left out, as JSON readers do. ``seq`` follows the order of lines within a file.
    """
    path = F.col("_metadata.file_path")
    scan = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", vocab.LOG_FILE)
        .text(root)
    )
    kept = scan.filter(_wanted(path, policy, include_precleanup))
    lines = kept.select(path.alias("path"), _row_order(spark).alias("seq"), F.col("value").alias("line"))
    return lines.filter("trim(line) <> ''").withColumn("session_key", session_key(F.col("path")))


def judged_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """JSON lines parsed into the raw record columns, and ``reason``: why a line is no event, else NULL.

    A line is rejected if it is no JSON object of the record's form, or if its time cannot be read. A
    rejected line has NULL in all record columns, and keeps its text; of the others the text is dropped.
    """
    schema = T.StructType([*vocab.RAW_RECORD.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    kept = [c for c in lines.columns if c != text]
    parsed = lines.withColumn("__record", F.from_json(F.col(text), schema, options))
    record = F.col("__record")
    no_json = record.isNull() | record[CORRUPT].isNotNull() | ~F.trim(text).startswith("{")
    reason = F.when(no_json, NOT_JSON).when(nanos(record["timestamp"]).isNull(), NO_TIME)
    judged = parsed.withColumn("reason", reason)
    fields = [F.when(F.col("reason").isNull(), record[f]).alias(f) for f in vocab.RAW_RECORD.fieldNames()]
    return judged.select(*kept, "reason", F.when(F.col("reason").isNotNull(), F.col(text)).alias(text), *fields)


def list_logs(
    spark: SparkSession, root: str, policy: str | None = None, include_precleanup: bool = False
) -> DataFrame:
    """Paths of all session logs below ``root``, empty ones too. No file is opened."""
    scan = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", vocab.LOG_FILE)
        .load(root)
    )
    # The names that the scan holds in any case; a scan itself would leave out empty files.
    names = [(re.sub(r"^(\w+):///", r"\1:/", name),) for name in scan.inputFiles()]
    paths = spark.createDataFrame(names, "path string")
    return paths.filter(_wanted(F.col("path"), policy, include_precleanup))


def session_key(path: Column) -> Column:
    """Folder of the log."""
    return F.regexp_replace(path, f"/{vocab.LOG_FILE.replace('.', '[.]')}$", "")


def parse_lines(lines: DataFrame, text: str, mode: str = "FAILFAST") -> DataFrame:
    """Parse a column of JSON lines into the raw record columns; other columns are kept."""
    kept = [c for c in lines.columns if c != text]
    record = F.from_json(F.col(text), vocab.RAW_RECORD, {"mode": mode})
    return lines.select(*kept, record.alias("__record")).select(*kept, "__record.*")


def flatten_fields(records: DataFrame, keys: Iterable[str], nested: str = "fields") -> DataFrame:
    """One column per asked key of the nested map; an absent key is NULL.

    The map stays, so keys nobody asked for are not lost.
    """
    return records.select(
        "*", *[F.col(nested)[k].alias(k) for k in keys if k not in records.columns]
    )


def coerce_fields(df: DataFrame, types: dict[str, str] | None = None, strict=False) -> DataFrame:
    """Cast text fields to their types. Text that is no number gives NULL, or fails if ``strict``."""
    types = types or vocab.FIELD_TYPES
    casts = {
        name: F.col(name).cast(kind) if strict else F.col(name).try_cast(kind)
        for name, kind in types.items()
        if name in df.columns
    }
    return df.withColumns(casts)


def typed_events(records: DataFrame, strict: bool = False, keep: Iterable[str] = ()) -> DataFrame:
    """Typed event table from raw records (see ``vocab.FIELD_TYPES``), and the columns ``keep`` that there are.

    Records of lines that could not be parsed (see ``CORRUPT``) are no events and are left out.
    """
    if CORRUPT in records.columns:
        records = records.filter(F.col(CORRUPT).isNull())
    flat = flatten_fields(records, vocab.FIELD_TYPES)
    flat = flat.withColumn("tid", trace_id(F.col("fields")["tid"], F.col("span")["tid"]))
    typed = coerce_fields(flat, strict=strict)
    ns = nanos(F.col("timestamp"))
    session = [c for c in ("session_id", "session_key", "policy", "workload") if c in records.columns]
    return typed.select(
        *session,
        "seq",
        ns.alias("ts_ns"),
        display_time(ns).alias("ts"),
        "level",
        "target",
        "tid",
        *vocab.FIELD_TYPES,
        *[c for c in keep if c in records.columns],
    )


def session_catalog(paths: DataFrame) -> DataFrame:
    """Session number per distinct ``path``: 0, 1, ... in order of the sorted session keys.

    Numbers depend on the set of sessions only, not on the order a file system lists them.
    """
    keys = paths.select("path").distinct().withColumn("session_key", session_key(F.col("path")))
    # A position over all rows is a window in one task, so only few rows may go that way.
    plan = ScanPlan.measure(keys, limits=CATALOG_LIMITS)
    numbered = plan.compute(keys, [], ["session_key"], session_id=position())
    parts = path_attributes(F.col("path"))
    return numbered.select(
        (F.col("session_id") - 1).alias("session_id"),
        "session_key",
        *[parts[c].alias(c) for c in ("duration", "workload", "repetition", "policy")],
    )


def logs_of(records: DataFrame) -> DataFrame:
    """The distinct paths of records or lines, found by the tasks that read them."""
    return records.select("path").distinct()


def extended_catalog(known: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows that ``paths`` add to a catalog of the form of ``session_catalog``.

    Known sessions are left out by an anti-join on their keys. New ones are numbered from the largest
    known number on, in the order of their keys, so no session's number ever changes, however the new
    keys sort among the old ones.
    """
    # One number; a catalog with no row begins at 0.
    after = known.agg(F.coalesce(F.max("session_id") + 1, F.lit(0))).first()[0]
    keyed = paths.select("path").distinct().withColumn("session_key", session_key(F.col("path")))
    new = keyed.join(known.select("session_key"), "session_key", "left_anti")
    added = session_catalog(new.select("path"))
    return added.withColumn("session_id", F.col("session_id") + F.lit(after))


def update_catalog(spark: SparkSession, stored: str, paths: DataFrame) -> DataFrame:
    """Add the sessions of ``paths`` to the catalog stored at ``stored``, made if it is not there.

    New rows are appended as files of their own. One job at a time may update a catalog. The result is
    the whole catalog.
    """
    kinds = "session_id bigint, session_key string, duration string, workload string, repetition string, policy string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(stored)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.schema(kinds).parquet(stored) if there else spark.createDataFrame([], kinds)
    added = extended_catalog(known, paths).select(*[c.split(" ")[0] for c in kinds.split(", ")])
    added.write.mode("append").parquet(stored)
    return spark.read.schema(kinds).parquet(stored)


def number_sessions(records: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Records of several logs with the number, policy and workload of their session.

    ``records`` have ``path``. ``catalog`` has one row per log (see ``list_logs``); without it the
    logs are those that have a record. It is joined back by session key; adaptive execution sends a
    small catalog to the records, or splits the records of a hot session.
    """
    catalog = session_catalog(records) if catalog is None else catalog
    keyed = records.withColumn("session_key", session_key(F.col("path")))
    known = catalog.select("session_key", "session_id", "policy", "workload")
    return keyed.join(known, "session_key")
