"""Where leads go: the lead table, rejects, cache tables and job outcomes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from leadlake.operators.lookup import PART_CHARS, flag_new_leads
from leadlake.schemas import PLACE_CACHE, RESULT_ENTRY, RESULT_META
from leadlake.session import materialize
from leadlake.sources.manifests import CommitConflict, load, names_in, publish, remove

# Fixed value: longest error text of a job record.
ERROR_LENGTH = 400
# Deliveries of leads, or segments of them, that become one segment.
DELIVERIES_FOLDED = 64


def upsert_leads(
    batch: DataFrame, known: DataFrame, on: Sequence[str], order: str = "n"
) -> tuple[DataFrame, DataFrame]:
    """(leads with ``is_new``, ``sent`` and ``new_count`` per job and batch).

    A key that occurs several times in the batch is new once, at its first row.
    ``batch`` has (job_id, batch_id) besides the key columns. Where ``known`` has them too, rows of the
    batches written now do not count as known, so a replayed batch gives what it gave before.
    """
    own = ["job_id", "batch_id"]
    if set(own) <= set(known.columns):
        # Null-safe: rows without a job replace themselves too.
        mine = materialize(batch.select(*[F.col(c).alias(f"_own_{c}") for c in own]).distinct(), "upsert-batches")
        known = known.join(mine, [F.col(c).eqNullSafe(F.col(f"_own_{c}")) for c in own], "left_anti")
    first = batch.groupBy(*on).agg(F.min(F.struct("job_id", order)).alias("_first"))
    # Written, so that the rows and the totals take one scan of ``known`` together.
    new = materialize(flag_new_leads(first, known, on).where("is_new").select(
        F.col("_first.job_id").alias("_job_id"), F.col(f"_first.{order}").alias("_order")), "upsert-new")
    same = F.col("job_id").eqNullSafe(F.col("_job_id")) & F.col(order).eqNullSafe(F.col("_order"))
    rows = batch.join(new.withColumn("is_new", F.lit(True)), same, "left").withColumn(
        "is_new", F.coalesce("is_new", F.lit(False))).drop("_job_id", "_order")
    totals = rows.groupBy("job_id", "batch_id").agg(
        F.count(F.lit(1)).alias("sent"), F.count_if("is_new").alias("new_count")
    )
    return rows, totals


def _segments(names: Sequence[str]) -> list[tuple[int, int, str]]:
    """(first delivery, last delivery, manifest) of the segments that count: those inside no longer one."""
    ranges = sorted((int(low), -int(high), n) for n in names for low, high in [n.removesuffix(".json").split("-")])
    live, end = [], -1
    for low, minus_high, name in ranges:
        if -minus_high > end:
            live.append((low, -minus_high, name))
            end = -minus_high
    return live


def _segment_name(low: int, high: int) -> str:
    return f"{low:019d}-{high:019d}.json"


def _write_segment(rows: DataFrame, path: str, low: int, high: int, keys: Sequence[str]) -> None:
    folder = uuid.uuid4().hex
    # Few files whatever the number of batches: partitions are cut and joined by size. Rows of a key lie together, so
    # that statistics and filters of the files spare most of them in a lookup of few keys.
    table = rows.hint("rebalance", *keys).sortWithinPartitions(*keys) if keys else rows.hint("rebalance")
    table.write.parquet(f"{path}/files/{folder}")
    publish(rows.sparkSession, f"{path}/log", _segment_name(low, high), {"folder": folder}, replace=True)


def store_leads(batch: DataFrame, path: str, delivery: int, keys: Sequence[str] = (), fold: int = DELIVERIES_FOLDED) -> None:
    """Commit one numbered delivery, such as an epoch of a stream.

    A repeated delivery replaces itself; until its manifest is in place, readers see what was before. One that is folded
    already is left as it is. After every ``fold`` deliveries (a power of it in turn) those are folded into one segment, so a row is
    rewritten once per level and the manifests that count stay below ``fold`` per level. ``keys`` orders the rows of a segment.
    """
    spark = batch.sparkSession
    live = _segments(names_in(spark, f"{path}/log"))
    if not any(low <= delivery <= high and low < high for low, high, _ in live):
        _write_segment(batch, path, delivery, delivery, keys)
    span = fold
    while (delivery + 1) % span == 0:
        low, high = delivery + 1 - span, delivery
        live = _segments(names_in(spark, f"{path}/log"))
        parts = [s for s in live if low <= s[0] and s[1] <= high]
        if len(parts) > 1:
            _write_segment(_read_segments(spark, path, batch.schema, parts), path, low, high, keys)
        span *= fold


def _read_segments(spark: SparkSession, path: str, schema: StructType, segments: Sequence[tuple[int, int, str]]) -> DataFrame:
    folders = [load(spark, f"{path}/log", name)["folder"] for _, _, name in segments]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/files/{f}" for f in folders])


def read_leads(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All committed leads; an empty table before the first delivery."""
    return _read_segments(spark, path, schema, _segments(names_in(spark, f"{path}/log")))


def clear_folded(spark: SparkSession, path: str) -> None:
    """Delete segments that a longer one replaced, and folders no manifest names. Only while nobody writes or reads an older state."""
    names = names_in(spark, f"{path}/log")
    live = {name for _, _, name in _segments(names)}
    kept = {load(spark, f"{path}/log", name)["folder"] for name in live}
    for name in set(names) - live:
        remove(spark, f"{path}/log/{name}")
    for folder in set(names_in(spark, f"{path}/files")) - kept:
        remove(spark, f"{path}/files/{folder}")


def append_leads(batch: DataFrame, path: str, epoch: int) -> None:
    """Write one delivery; a repeated delivery of the same epoch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def read_before(spark: SparkSession, path: str, schema: StructType, epoch: int) -> DataFrame:
    """What earlier deliveries wrote; an empty table before the first one."""
    try:
        table = spark.read.option("basePath", path).schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return table.where(F.col("epoch") < epoch)


def quarantine_rejects(batch: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted rows, refused rows, counters per job and batch).

    A batch with a refused row is delivered row by row: it no longer counts as a sent
    batch, accepted rows count as sent, each refused row is one error.
    """
    judged = batch.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    counters = judged.groupBy("job_id", "batch_id").agg(
        F.count_if("_ok").alias("sent"),
        F.count_if(~F.col("_ok")).alias("errors"),
        F.min(F.col("_ok").cast("int")).cast("bigint").alias("batches_sent"),
    )
    return judged.where("_ok").drop("_ok"), judged.where("not _ok").drop("_ok"), counters


def place_cache_to_json(cache: DataFrame) -> DataFrame:
    """(key, value) rows with the entry as JSON text."""
    return cache.select("key", F.to_json(F.struct("lead", "url", "cached_at", "ttl_s")).alias("value"))


def place_cache_from_json(rows: DataFrame, schema: StructType = PLACE_CACHE) -> DataFrame:
    """Entries of (key, value) rows; unreadable ones are dropped."""
    fields = [f for f in schema.fields if f.name != "key"]
    parsed = rows.select("key", F.from_json("value", StructType(fields)).alias("_v"))
    return parsed.where(F.col("_v.lead").isNotNull()).select("key", "_v.*").select(*schema.fieldNames())


def write_place_cache(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").parquet(path)


def read_place_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLACE_CACHE).parquet(path)


_CACHE_TABLES = ("meta", "entries")


def _cache_versions(spark: SparkSession, path: str) -> list[str]:
    return names_in(spark, f"{path}/versions")


def _cache_snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of ``version``, or of the newest one: for each table the folder of every part."""
    known = _cache_versions(spark, path)
    name = f"{version:019d}.json" if version is not None else known[-1] if known else None
    return load(spark, f"{path}/versions", name) if name else {"version": 0, "part_chars": None, "meta": {}, "entries": {}}


def write_result_cache(
    meta: DataFrame, entries: DataFrame, path: str, part_chars: int = PART_CHARS, changed_since: float | None = None, based_on: int | None = None
) -> int:
    """Commit both tables as one version, split by the first characters of the hash (16 parts per character); returns its number.

    Without ``changed_since`` the version holds just these tables, in a new folder. With it, they replace those parts of the
    version before that hold an entry written at or after that time, and parts that differ in which searches they hold; a
    refresh of few searches leaves most of a large cache alone. Readers see the old version of both tables until the new one is
    published. ``based_on`` is the version that the tables were worked out from; when another one came after it, the commit
    fails with :class:`CommitConflict` and nothing changes.
    """
    spark = meta.sparkSession
    before = _cache_snapshot(spark, path)
    if changed_since is None and before["version"]:
        raise CommitConflict(f"{path} holds a cache already")
    if based_on is not None and before["version"] != based_on:
        raise CommitConflict(f"{path} is at version {before['version']}, not {based_on}")
    if changed_since is not None and before["part_chars"] not in (None, part_chars):
        raise ValueError(f"{path} is split by {before['part_chars']} characters")
    part = F.left("hash", F.lit(part_chars))
    tables = {name: table.drop("part").withColumn("part", part) for name, table in (("meta", meta), ("entries", entries))}
    touched = None
    if changed_since is not None:
        # At most 16 ** part_chars rows, here and below.
        held = tables["meta"].groupBy("part").agg(
            F.max("cached_at").alias("latest"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hash").cast("decimal(38,0)")).alias("mark"))
        old = read_result_cache(spark, path, before["version"])[0] if before["version"] else spark.createDataFrame([], tables["meta"].schema)
        was = old.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hash").cast("decimal(38,0)")).alias("mark"))
        same = held.where(F.col("latest") < changed_since).join(was, ["part", "n", "mark"]).select("part")
        seen = held.select("part").union(was.select("part")).distinct()
        touched = {r.part for r in seen.join(same, "part", "left_anti").collect()}
        tables = {name: table.where(F.col("part").isin(sorted(touched))) for name, table in tables.items()}
    folder = uuid.uuid4().hex
    after = {"version": before["version"] + 1, "part_chars": part_chars}
    for name, table in tables.items():
        # Rebalancing gives each part few files and splits one that is very large.
        table.hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/{name}/version={folder}")
        written = [p.removeprefix("part=") for p in names_in(spark, f"{path}/{name}/version={folder}")]
        kept = {p: f for p, f in before[name].items() if touched is not None and p not in touched}
        after[name] = kept | {p: folder for p in written}
    publish(spark, f"{path}/versions", f"{after['version']:019d}.json", after)
    return after["version"]


def cache_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version; 0 where nothing is stored."""
    return _cache_snapshot(spark, path)["version"]


def read_result_cache(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(meta, entries) of one version, the newest unless another is named; ``part`` lets lookups read only the parts they ask for."""
    snapshot = _cache_snapshot(spark, path, version)

    def read(name: str, schema: StructType) -> DataFrame:
        parts = [f"{path}/{name}/version={folder}/part={part}" for part, folder in sorted(snapshot[name].items())]
        full = StructType([*schema.fields, StructField("part", StringType())])
        if not parts:
            return spark.createDataFrame([], full)
        wide = StructType([*schema.fields, StructField("version", StringType()), StructField("part", StringType())])
        return spark.read.option("basePath", f"{path}/{name}").schema(wide).parquet(*parts).drop("version")

    return read("meta", RESULT_META), read("entries", RESULT_ENTRY)


def clear_old_versions(spark: SparkSession, path: str) -> None:
    """Delete all versions but the newest and the folders they alone use. Only while nobody writes or reads an older one."""
    snapshot = _cache_snapshot(spark, path)
    for name in _cache_versions(spark, path)[:-1]:
        remove(spark, f"{path}/versions/{name}")
    for table in _CACHE_TABLES:
        used = {f"version={f}" for f in snapshot[table].values()}
        for folder in set(names_in(spark, f"{path}/{table}")) - used:
            remove(spark, f"{path}/{table}/{folder}")


def job_outcomes(jobs: DataFrame, deliveries: DataFrame, endings: DataFrame) -> DataFrame:
    """Terminal record per job.

    ``deliveries`` has (job_id, sent, new_count) per batch; ``endings`` has one row per
    finished job: (job_id, cancelled, error, region_exhausted). A failed job reports only
    its message, a cancelled one only counts; a complete one adds ``region_exhausted`` and
    ``requested`` when the region had fewer places than asked for.
    """
    counts = deliveries.groupBy("job_id").agg(F.sum("sent").alias("_sent"), F.sum("new_count").alias("_new"))
    joined = jobs.select("job_id", "max_results").join(endings, "job_id").join(counts, "job_id", "left")
    sent, new = F.coalesce("_sent", F.lit(0)), F.coalesce("_new", F.lit(0))
    outcome = (
        F.when(F.col("error").isNotNull(), "error").when(F.coalesce("cancelled", F.lit(False)), "cancelled").otherwise("complete")
    )
    short = (outcome == "complete") & F.coalesce("region_exhausted", F.lit(False)) & (sent < F.col("max_results"))
    return joined.select(
        "job_id",
        outcome.alias("outcome"),
        F.when(outcome != "error", sent).alias("count"),
        F.when(outcome != "error", new).alias("new_count"),
        F.when(short, True).alias("region_exhausted"),
        F.when(short, F.col("max_results")).alias("requested"),
        F.left("error", F.lit(ERROR_LENGTH)).alias("msg"),
    )
