"""Writing graphs, tweets, edges and metric records."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

GRAPH_TABLES = ("nodes", "edges", "graphs")
MANIFEST = "manifest"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


# --- stored graphs ----------------------------------------------------------------------------
#
# Below a path every set of graphs has a folder of its own. A set counts from the moment that its row is in the manifest, which is
# appended after all its tables; no set is ever changed, so one that breaks off leaves the others as they are.


def fingerprint(tables: dict[str, DataFrame | None], **settings) -> str:
    """A digest of the rows of some tables, in any order, and of settings. It reads every table once and shuffles no rows."""
    known = {name: df for name, df in tables.items() if df is not None}
    digests = None
    for name, df in known.items():
        row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(20,0)")
        one = df.select(row.alias("_h")).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum("_h").cast("string").alias("sum"))
        digests = one if digests is None else digests.unionByName(one)
    found = sorted(tuple(r) for r in digests.collect()) if known else []
    types = {name: sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields) for name, df in known.items()}
    return hashlib.sha256(json.dumps([found, types, settings], sort_keys=True).encode()).hexdigest()


def _sets(spark: SparkSession, path: str) -> DataFrame | None:
    if not _exists(spark, f"{path}/{MANIFEST}/_SUCCESS"):
        return None
    return spark.read.schema("number long, mark string, folder string").parquet(f"{path}/{MANIFEST}")


def _latest(spark: SparkSession, path: str, mark: str | None) -> Row | None:
    sets = _sets(spark, path)
    if sets is None:
        return None
    chosen = sets if mark is None else sets.where(F.col("mark") == mark)
    return next(iter(chosen.orderBy(F.desc("number"), F.desc("folder")).limit(1).collect()), None)


def graphs_stored(spark: SparkSession, path: str, mark: str | None = None) -> bool:
    """Whether a finished set with this mark, or any, is there."""
    return _latest(spark, path, mark) is not None


def read_graphs(spark: SparkSession, path: str, mark: str | None = None) -> dict[str, DataFrame]:
    """The tables of the latest finished set, of those with this mark if one is given."""
    found = _latest(spark, path, mark)
    if found is None:
        raise FileNotFoundError(f"no finished graphs below {path}" + (f" with mark {mark}" if mark is not None else ""))
    return {name: spark.read.parquet(f"{path}/{found['folder']}/{name}") for name in GRAPH_TABLES}


def write_graphs(tables: dict[str, DataFrame], path: str, overwrite: bool = False, mark: str = "") -> dict[str, DataFrame]:
    """Store the nodes, edges and graphs tables as Parquet and read them back.

    A finished set with the same ``mark`` is re-used, unless ``overwrite`` asks for a new one. The mark tells what the tables were
    made from (:func:`fingerprint`). Older sets stay, also for those who read them now, until :func:`drop_superseded`.
    """
    spark = tables["graphs"].sparkSession
    if overwrite or not graphs_stored(spark, path, mark):
        folder = f"set-{uuid.uuid4().hex}"
        for name in GRAPH_TABLES:
            tables[name].write.parquet(f"{path}/{folder}/{name}")
        last = _latest(spark, path, None)
        record = [(last["number"] + 1 if last else 0, mark, folder)]
        manifest = spark.createDataFrame(record, "number long, mark string, folder string").coalesce(1)
        manifest.write.mode("append").parquet(f"{path}/{MANIFEST}")
    return read_graphs(spark, path, mark)


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Delete the tables of sets that have a newer one with the same mark; the number of sets deleted now.

    Sets that aren't in the manifest may still be in writing and stay.
    """
    sets = _sets(spark, path)
    if sets is None:
        return 0
    newest = sets.groupBy("mark").agg(F.max_by("folder", F.struct("number", "folder")).alias("folder"))
    dropped = 0
    for row in sets.join(newest, ["mark", "folder"], "left_anti").toLocalIterator():
        files, place = _place(spark, f"{path}/{row['folder']}")
        dropped += files.delete(place, True)
    return dropped


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "news_id", path: str | None = None) -> DataFrame:
    """Store a table bucketed by its cascade, so that later joins and groupings on it need no shuffle.

    Rows are dealt to their buckets first: one file a bucket, not one for each task and bucket. ``path`` places an external table.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return df.sparkSession.table(table)


def drop_bucketed(spark: SparkSession, table: str, path: str | None = None) -> None:
    """Forget a table, and delete the files of an external one."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    if path is not None:
        files, place = _place(spark, path)
        files.delete(place, True)


def write_csv(df: DataFrame, path: str) -> None:
    # The default format would cut timestamps to milliseconds.
    options = {"header": True, "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    df.write.mode("overwrite").options(**options).csv(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append records ``run, model, metric, value``."""
    metrics.select("run", "model", "metric", F.col("value").cast("double")).write.mode("append").parquet(path)


def results_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per (run, model) with a column per metric name."""

    def value_of(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name)

    return metrics.groupBy("run", "model").agg(*[value_of(n) for n in names])
