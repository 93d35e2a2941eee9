"""Tables kept up to date: upserts, merges, coverage and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both with new rows in the place of old ones; missing columns become null."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    window = Window.partitionBy(*keys).orderBy(F.desc("_o"))
    return both.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n", "_o")


def merge_coalesce(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge in which a new value wins where it is there."""
    values = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    pick = [F.coalesce(*[F.col(f"{side}.{c}") for side, frame in (("n", new), ("o", old)) if c in frame.columns]).alias(c) for c in [*keys, *values]]
    return joined.select(*pick)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows stay; only rows of new keys are added."""
    return old.unionByName(new.join(old, keys, "left_anti"), allowMissingColumns=True)


def coverage(bars: DataFrame, ready: int = 260) -> DataFrame:
    out = bars.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("row_count"))
    return out.withColumn("status", F.when(F.col("row_count") >= ready, "ready").otherwise("partial"))


def status(basics: DataFrame, covered: DataFrame, gate: float = 0.95) -> DataFrame:
    """One row: symbols known, covered and ready, latest date, and whether the market is covered as far as the gate asks."""
    joined = basics.select("symbol").join(covered, "symbol", "left")
    out = joined.agg(F.countDistinct("symbol").alias("total"), F.countDistinct(F.when(F.col("row_count") > 0, F.col("symbol"))).alias("covered"),
        F.sum(F.when(F.col("status") == "ready", 1).otherwise(0)).alias("ready"), F.max("last_date").alias("latest"))
    return out.withColumn("ratio", F.col("ready") / F.col("total").cast("double")).withColumn("full_market_ready", F.col("ratio") >= gate)


def resume(progress: DataFrame, present: DataFrame, key: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """Progress rows whose work is there, and those that are stale."""
    keys = present.select(key).distinct()
    return progress.join(keys, key, "left_semi"), progress.join(keys, key, "left_anti")


def write_table(frame: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Replace a table's files; with ``partitions`` only the partitions that ``frame`` has."""
    writer = frame.write.mode("overwrite")
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)


BUCKETS = 256


def merge_table(new: DataFrame, path: str, keys: list[str], by: str = "symbol", buckets: int = BUCKETS) -> None:
    """``upsert`` into the table at ``path`` that rewrites only the buckets of ``by`` that ``new`` has; creates the table if there is none.

    The table is partitioned by the hash of ``by``, one of the keys, so the scan skips the buckets that stay and a bucket
    is one partition of the join.  Every merge of a table needs the same number of buckets.  New rows with the same keys
    replace each other, which one stays is not defined; rows whose ``by`` is null have a bucket of their own.  The new
    files are complete before the old ones of their buckets go.
    """
    spark = new.sparkSession
    if by not in keys:
        raise ValueError(f"{by} must be one of the keys")
    fresh = new.withColumn("bucket", F.when(F.col(by).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        changed = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not changed:
            return
        merged = upsert(spark.read.option("mergeSchema", True).parquet(path).where(F.col("bucket").isin(changed)), fresh, ["bucket", *keys])
    else:
        merged = fresh.dropDuplicates(["bucket", *keys])
    write_table(merged.repartition("bucket"), path, ["bucket"])


def read_signals(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def stale_symbols(covered: DataFrame, as_of, overlap_days: int = 10) -> DataFrame:
    """Symbols that lack ``as_of``, with the date to fetch from: an overlap before their last bar."""
    return covered.where(F.col("last_date") < F.lit(as_of).cast("date")).select("symbol", F.date_sub("last_date", overlap_days).alias("fetch_from"))


def clip(bars: DataFrame, start=None, end=None, tail: int | None = None) -> DataFrame:
    """Bars between two dates, and of those each symbol's last ``tail``."""
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    if tail is None:
        return bars
    last = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= tail).drop("_n")


def adjusted(bars: DataFrame, adjust: str, fallback: str = "qfq") -> DataFrame:
    """Bars of an adjustment; symbols that have none of it, those of the other."""
    ranked = bars.where(F.col("adjust_type").isin(adjust, fallback)).withColumn("_p", F.when(F.col("adjust_type") == adjust, 0).otherwise(1))
    return ranked.withColumn("_best", F.min("_p").over(Window.partitionBy("symbol"))).where("_p = _best").drop("_p", "_best")


def signal_rows(signals: DataFrame, version: str, universe: str = "stocks") -> DataFrame:
    """Signals as they are stored: one row for each universe, symbol, date and pattern, lists and maps as JSON text."""
    has = lambda c, default: F.col(c) if c in signals.columns else default
    return signals.select(
        F.lit(universe).alias("universe"), "symbol", F.col("date").alias("signal_date"), "pattern", has("stage", F.lit("candidate")).alias("stage"),
        "score", F.coalesce(has("confirmed", F.lit(False)), F.lit(False)).cast("int").alias("confirmed"),
        F.coalesce(F.to_json(has("fib_levels", F.lit(None).cast("map<string,double>"))), F.lit("{}")).alias("fib_levels_json"),
        F.coalesce(F.to_json(has("evidence", F.lit(None).cast("array<string>"))), F.lit("[]")).alias("evidence_json"),
        F.coalesce(F.to_json(has("factors", F.lit(None).cast("map<string,double>"))), F.lit("{}")).alias("factors_json"), F.lit(version).alias("engine_version"),
    ).dropDuplicates(["universe", "symbol", "signal_date", "pattern"])


def meta_table(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    """Settings and versions by key."""
    return spark.createDataFrame(sorted(values.items()), "key string, value string")


def merged_coverage(bars: DataFrame, fresh: DataFrame, wanted: DataFrame, target: int = 260, adjust: str = "qfq") -> tuple[DataFrame, DataFrame]:
    """Bars with a download merged in, and how each symbol that was asked for came out of it.

    Status: empty where nothing came, degraded where another adjustment came, else ready or partial by the bars that
    there are now.
    """
    merged = upsert(bars, fresh.drop("adjust_type"), ["symbol", "date"])
    came = fresh.groupBy("symbol").agg(F.count(F.lit(1)).alias("fetched"), F.max("adjust_type").alias("adjust_type"))
    covered = coverage(merged.join(wanted.select("symbol"), "symbol", "left_semi"), target)
    told = wanted.select("symbol").join(came, "symbol", "left").join(covered.drop("status"), "symbol", "left")
    status_ = F.when(F.col("fetched").isNull(), "empty").when(F.col("adjust_type") != adjust, "degraded").when(F.col("row_count") >= target, "ready").otherwise("partial")
    return merged, told.select("symbol", F.coalesce("fetched", F.lit(0)).alias("fetched"), "first_date", "last_date", "row_count", status_.alias("status"))


def conform(frame: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """A frame in a table's schema: columns cast and in its order, missing ones null or by default, others left out."""
    from pyspark.sql.types import _parse_datatype_string

    fields, given = _parse_datatype_string(schema), defaults or {}
    return frame.select(*[(F.coalesce(F.col(f.name),
        F.lit(given.get(f.name))) if f.name in frame.columns else F.lit(given.get(f.name))).cast(f.dataType).alias(f.name) for f in fields])
