"""Tables on shared storage: append-only logs, replaced slices, keyed uploads, novel rows, snapshots and freshness."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def workspace(spark: SparkSession) -> str:
    """A new folder in the one named by spark.checkpoint.dir. Where that is unset: in the warehouse of a cluster.

    A temporary folder is only used by a local master, whose tasks run on the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own:
            local = spark.sparkContext.master.startswith("local[")
            _own.append(tempfile.mkdtemp(prefix="pitpanel-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/pitpanel")
        base = _own[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """df written to a new folder and read back: its lineage ends there."""
    path = workspace(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def render(template: str, **names: str) -> str:
    """A template with ${name} placeholders filled; one that is left is an error."""
    out = re.sub(r"\$\{(\w+)\}", lambda m: names.get(m[1], m[0]), template)
    left = re.findall(r"\$\{(\w+)\}", out)
    if left:
        raise ValueError(f"unresolved placeholders: {sorted(set(left))}")
    return out


def write(df: DataFrame, path: str, mode: str, partition: Sequence[str] = (), cluster: Sequence[str] = ()) -> None:
    """Overwrite or append, partitioned by columns and sorted inside files by others; appended columns may be new."""
    if cluster:
        df = df.sortWithinPartitions(*partition, *cluster)
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns that any file has."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def replace_slices(df: DataFrame, path: str, slices: Sequence[str]) -> None:
    """Only the partitions that df has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*slices).parquet(path)


def upsert(df: DataFrame, path: str, keys: Sequence[str], slices: Sequence[str], manual: Mapping[str, object]) -> None:
    """Merge df (keys, slices, computed columns) into the table at path: computed columns are df's, manual ones stay.

    manual: the columns that others fill, with what a new key begins with. A key that the table has keeps its manual
    columns and takes df's computed ones, null included; keys that df lacks stay. slices, which must follow from the keys, are
    the table's partitions: only those that df has rows for are written, each as a whole, from a merge that is
    written first, so a second run with the same rows changes nothing. A key twice in df is an error, as is a null slice.
    """
    spark, on = df.sparkSession, [*keys, *[c for c in slices if c not in keys]]
    if df.groupBy(*on).count().where("count > 1").limit(1).count() or df.where(" or ".join(f"`{c}` is null" for c in slices)).limit(1).count():
        raise ConflictError("a key that comes twice, or a slice that is null")
    computed = [c for c in df.columns if c not in on and c not in manual]
    fresh = {c: F.lit(v) for c, v in manual.items()}
    old = found(spark, path)
    if old is None:
        merged = df.select(*on, *computed).withColumns(fresh)
    else:
        same = [F.col(c).cast(df.schema[c].dataType).alias(c) for c in on]
        here = old.select(*same, *[c for c in old.columns if c not in on]).join(df.select(*slices).distinct(), list(slices), "left_semi")
        a, b = here.withColumn("_old", F.lit(True)).alias("a"), df.withColumn("_new", F.lit(True)).alias("b")
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        pick = lambda c: F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) if c in old.columns else F.col(f"b.{c}").alias(c)
        kept = lambda c: F.when(F.col("_old"), F.col(f"a.{c}")).otherwise(fresh[c]).alias(c) if c in old.columns else fresh[c].alias(c)
        merged = a.join(b, cond, "full_outer").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in on], *[pick(c) for c in computed], *[kept(c) for c in manual])
    replace_slices(save(merged), path, slices)


def set_manual(df: DataFrame, path: str, keys: Sequence[str], slices: Sequence[str], columns: Sequence[str]) -> None:
    """Fill manual columns of rows that the table has: df (keys, slices, columns); all else stays as it is."""
    old = read(df.sparkSession, path)
    on = [*keys, *[c for c in slices if c not in keys]]
    new = df.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in on], *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_set"))
    here = old.join(new.select(*slices).distinct(), list(slices), "left_semi").join(new, on, "left")
    done = here.select(*[F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in old.columns])
    replace_slices(save(done), path, slices)


def stamp(df: DataFrame, observed_at, capture: str) -> DataFrame:
    """df with the collector's time, a capture id and a hash of each row's content."""
    content = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return df.withColumns({"content_hash": content, "observed_at": observed_at, "capture_id": F.lit(capture)})


class ConflictError(ValueError):
    """A known key came with another value."""


def novel(rows: DataFrame, existing: DataFrame, keys: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with new keys, rows whose key exists with other values); equal repeats are in neither."""
    rows = rows.dropDuplicates([*keys, *values])
    old = existing.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    clash = rows.join(old, list(keys)).where(~same).select(*rows.columns)
    return rows.join(existing, list(keys), "left_anti"), clash


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Write a batch once: a repeat with the same rows is a no-op (False), one with other rows an error.

    A batch is a folder of its own, so that a repeat adds nothing; its rows are told by their number and the sum of
    their hashes, whatever their order.
    """
    spark = df.sparkSession
    told = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    at = f"{path}/batch_id={batch}"
    try:
        df.write.mode("errorifexists").parquet(at)
        return True
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    have, came = told(spark.read.schema(df.schema).parquet(at)), told(df)
    if have != came:
        raise ConflictError(f"batch {batch}: {have[0]} rows are there, {came[0]} came, and they differ")
    return False


def found(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, None if there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def backup(spark: SparkSession, tables: Mapping[str, str], into: str, day: str, keep_days: int) -> DataFrame:
    """(name, status, rows) of a dated clone of each table (name -> path): copied, kept (it is there) or missing.

    Clones are folders name/day=yyyy-mm-dd. Those older than keep_days before `day` are dropped from the list that
    `backups` gives; a table that is not there is skipped. With any other failure the job fails.
    """
    rows = []
    for name, path in tables.items():
        df = found(spark, path)
        if df is None:
            rows.append((name, "missing", 0))
            continue
        at = f"{into}/{name}/day={day}"
        have = found(spark, at)
        if have is None:
            df.write.parquet(at)
        rows.append((name, "copied" if have is None else "kept", spark.read.parquet(at).count()))
    return spark.createDataFrame(rows, "name string, status string, rows long")


def backups(spark: SparkSession, into: str, names: Sequence[str], day: str, keep_days: int) -> DataFrame:
    """(name, day, rows) of the clones from at most keep_days before `day`."""
    parts = [df.groupBy("day").agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), F.col("day").cast("date").alias("day"), "rows") for n in names if (df := found(spark, f"{into}/{n}")) is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.date_diff(F.lit(day).cast("date"), "day") <= keep_days)


def freshness(feeds: Mapping[str, tuple[DataFrame | None, str, float, bool]], now: str) -> DataFrame:
    """(feed, rows, newest, hours, state) of feeds: name -> (table or None, its time column, bar of hours, in season).

    States: missing (no table), empty, stale (newer than its bar is nothing), idle (stale out of season) or ok.
    """
    parts = []
    for name, (df, at, bar, active) in feeds.items():
        if df is None:
            continue
        row = df.agg(F.count("*").alias("rows"), F.max(F.col(at).cast("timestamp")).alias("newest"))
        parts.append(row.select(F.lit(name).alias("feed"), F.lit(bar).alias("bar"), F.lit(active).alias("active"), F.lit(True).alias("there"), "rows", "newest"))
    spark = next(df for df, *_ in feeds.values() if df is not None).sparkSession
    gone = [(name, bar, active, False, 0, None) for name, (df, _, bar, active) in feeds.items() if df is None]
    out = spark.createDataFrame(gone, "feed string, bar double, active boolean, there boolean, rows long, newest timestamp")
    for p in parts:
        out = out.unionByName(p)
    hours = (F.lit(now).cast("timestamp").cast("double") - F.col("newest").cast("double")) / 3600
    old = F.when(F.col("active"), "stale").otherwise("idle")
    state = F.when(~F.col("there"), "missing").when(F.col("rows") == 0, "empty").when(F.col("hours") > F.col("bar"), old).otherwise("ok")
    return out.withColumn("hours", hours).withColumn("state", state).drop("bar", "active", "there")
