"""Stored tables of key-hash buckets with versions.

    <path>/data/<write>/bucket=<k>/part-*.parquet    files never change once they are written
    <path>/versions/<n>.json                         the folders of each bucket, oldest first

A writer first writes new folders, then the manifest of the next version under another name, and
renames it: only the rename makes anything visible, so readers see a whole version or the one before,
and what a stopped writer left behind is in no version. There is one writer at a time; a second one that
commits the same number gets an error. The two newest versions stay for those who are reading them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

BUCKETS, VERSIONS_KEPT = 256, 2
#: A bucket's layers are merged into one beyond this many, so a row is written again once in so many changes of its bucket.
LAYERS = 8


@dataclass
class Version:
    number: int = -1
    schema: str = ""
    buckets: int = BUCKETS
    layers: dict[int, list[str]] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, top = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, top = _fs(spark, path)
    fs.delete(top, True)


def _version_numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/versions") if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, number: int) -> Version:
    fs, file = _fs(spark, f"{path}/versions/{number}.json")
    stream = fs.open(file)
    try:
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(number, told["schema"], told["buckets"], {int(k): v for k, v in told["layers"].items()})


def is_versioned(spark: SparkSession, path: str) -> bool:
    return bool(_version_numbers(spark, path))


def current(spark: SparkSession, path: str) -> Version:
    """The newest version; number -1 where there is no table yet."""
    found = _version_numbers(spark, path)
    return _manifest(spark, path, found[-1]) if found else Version()


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_layer(rows: DataFrame, path: str, keys: list[str], buckets: int) -> dict[int, str]:
    """Write rows by bucket, in no version yet; the folder of each bucket. Large buckets are split among tasks."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.withColumn("bucket", bucket_of(keys, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{name}")
    return {int(n.partition("=")[2]): f"data/{name}/{n}" for n in _names(spark, f"{path}/data/{name}") if n.startswith("bucket=")}


def commit(spark: SparkSession, path: str, base: Version, schema: StructType, layers: dict[int, list[str]]) -> Version:
    """Make the next version visible; the data that only older versions name is deleted."""
    new = Version(base.number + 1, schema.json(), base.buckets, layers)
    jvm = spark._jvm
    fs, temporary = _fs(spark, f"{path}/versions/.{new.number}-{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(json.dumps({"schema": new.schema, "buckets": new.buckets, "layers": new.layers}).encode())
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{new.number}.json")
    kinds = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(temporary, final, kinds)  # fails if there is one
    numbers = _version_numbers(spark, path)
    kept = {f for n in numbers[-VERSIONS_KEPT:] for layers in _manifest(spark, path, n).layers.values() for f in layers}
    for n in numbers[:-VERSIONS_KEPT]:
        for folder in {f for layers in _manifest(spark, path, n).layers.values() for f in layers} - kept:
            delete(spark, f"{path}/{folder}")
        delete(spark, f"{path}/versions/{n}.json")
    return new


def read_layers(spark: SparkSession, path: str, version: Version, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(version.schema))
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """All rows of the newest version, or those of some buckets: for tables whose buckets have one layer."""
    version = current(spark, path)
    return read_layers(spark, path, version, [f for k, layers in version.layers.items() if buckets is None or k in buckets for f in layers])


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def upsert_table(rows: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Insert or update the row of each key, the last one by ``order`` wins; merging rows twice changes nothing.

    Rows are added as one more layer of the buckets they belong to, so what is written follows the rows,
    not the table; a bucket of LAYERS layers is merged with the new ones instead. No rows change nothing.
    """
    spark = rows.sparkSession
    base = current(spark, path)
    base = base if base.number >= 0 else Version(buckets=buckets)
    added = write_layer(latest_by(rows, keys, order), path, keys, base.buckets)
    if not added and base.number >= 0:
        return
    layers = {k: list(v) for k, v in base.layers.items()}
    for k, folder in added.items():
        layers.setdefault(k, []).append(folder)
    full = [k for k in added if len(layers[k]) > LAYERS]
    if full:
        old = read_layers(spark, path, Version(0, rows.schema.json()), [f for k in full for f in layers[k]])
        layers |= {k: [folder] for k, folder in write_layer(latest_by(old, keys, order), path, keys, base.buckets).items()}
    commit(spark, path, base, rows.schema, layers)


def read_upserted(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of a table that ``upsert_table`` keeps; only buckets of several layers are merged."""
    version = current(spark, path)
    one = [v[0] for v in version.layers.values() if len(v) == 1]
    several = [f for v in version.layers.values() if len(v) > 1 for f in v]
    rows = read_layers(spark, path, version, one)
    return rows.unionByName(latest_by(read_layers(spark, path, version, several), keys, order)) if several else rows


def replace_rows(rows: DataFrame, path: str, key: str, same: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace all rows of the keys in ``same`` (a small table of ``key``) by ``rows``; other keys stay.

    Only the buckets of these keys are rewritten, with their other rows carried over.
    """
    spark = rows.sparkSession
    base = current(spark, path)
    base = base if base.number >= 0 else Version(buckets=buckets)
    touched = [r[0] for r in same.select(bucket_of([key], base.buckets)).distinct().collect()]  # at most ``buckets`` numbers
    old = [f for k in touched for f in base.layers.get(k, [])]
    if old:
        rows = rows.unionByName(read_layers(spark, path, base, old).join(same, key, "left_anti"))
    written = write_layer(rows, path, [key], base.buckets)
    commit(spark, path, base, rows.schema, {k: v for k, v in base.layers.items() if k not in touched} | {k: [f] for k, f in written.items()})
