"""Tables kept as hashed buckets under a manifest.

``root/data`` holds folders of bucket files, each written once; ``root/manifests`` has one small file a version, which names the
folder of every bucket of every part of the table. A change writes new folders for the buckets it touches and then one
manifest that names them beside the old ones, so it is seen whole or not at all, for all parts together. One writer at a
time; a second one fails when it publishes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one file of a bucket.
FILE_ROWS = 2_000_000


@dataclass
class Manifest:
    """A version: ``parts`` maps a part to {bucket: folder}; ``facts`` are small figures kept with it."""

    version: int = 0
    buckets: int = 64
    parts: dict[str, dict[int, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


def bucket_of(buckets: int, *key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, target = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def versions(spark: SparkSession, root: str) -> list[str]:
    return [n for n in _names(spark, f"{root}/manifests") if n.startswith("m") and n.endswith(".json")]


def load(spark: SparkSession, root: str, name: str | None = None) -> Manifest | None:
    """The newest manifest, or the one of that file name; None if there is none."""
    name = name or (versions(spark, root) or [None])[-1]
    if name is None:
        return None
    raw = json.loads(spark.read.text(f"{root}/manifests/{name}", wholetext=True).first()["value"])
    parts = {p: {int(b): f for b, f in held.items()} for p, held in raw["parts"].items()}
    return Manifest(raw["version"], raw["buckets"], parts, raw["schemas"], raw["facts"])


def read(spark: SparkSession, root: str, part: str, manifest: Manifest | None, only: list[int] | None = None) -> DataFrame | None:
    """The rows of a part, of the buckets ``only`` if given; None if the part has never been written."""
    if manifest is None or part not in manifest.schemas:
        return None
    held = manifest.parts.get(part, {})
    folders = [f"{root}/data/{f}" for b, f in sorted(held.items()) if only is None or b in only]
    schema = manifest.schemas[part]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def stage(rows: DataFrame, root: str, bucket: Column) -> tuple[dict[int, str], str]:
    """Write rows into a new folder by bucket; returns {bucket: folder} of the buckets with rows, and the schema. Nobody sees them yet."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    laid = rows.withColumn("_bucket", bucket)
    laid = laid.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_bucket")
    laid.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("_bucket").parquet(f"{root}/data/{name}")
    found = [n for n in _names(spark, f"{root}/data/{name}") if n.startswith("_bucket=")]
    return {int(n.split("=")[1]): f"{name}/{n}" for n in found}, schema


def changed(manifest: Manifest, part: str, touched: list[int], staged: tuple[dict[int, str], str]) -> None:
    """Put staged buckets into a manifest; a touched bucket that got no rows is empty from then on."""
    folders, schema = staged
    held = {b: f for b, f in manifest.parts.get(part, {}).items() if b not in touched}
    manifest.parts[part] = held | folders
    manifest.schemas[part] = schema


def publish(spark: SparkSession, root: str, manifest: Manifest) -> int:
    """Make a manifest the next version, by renaming a complete file; fails if another writer was first."""
    manifest.version += 1
    body = json.dumps({"version": manifest.version, "buckets": manifest.buckets, "parts": manifest.parts, "schemas": manifest.schemas, "facts": manifest.facts})
    fs, draft = _path(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/m{manifest.version:010d}.json")
    out = fs.create(draft, True)
    out.write(bytearray(body.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {manifest.version} of {root} is there already: another writer was first")
    return manifest.version


def retire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions, and data that none of these names; returns the number of folders deleted."""
    names = versions(spark, root)
    stay = names[-keep:]
    used = {f for n in stay for held in load(spark, root, n).parts.values() for f in held.values()}
    fs, _ = _path(spark, root)
    gone = 0
    for n in names[:-keep]:
        fs.delete(_path(spark, f"{root}/manifests/{n}")[1], False)
    for folder in _names(spark, f"{root}/data"):
        if not any(f.startswith(folder + "/") for f in used):
            gone += bool(fs.delete(_path(spark, f"{root}/data/{folder}")[1], True))
            continue
        for bucket in _names(spark, f"{root}/data/{folder}"):
            if bucket.startswith("_bucket=") and f"{folder}/{bucket}" not in used:
                gone += bool(fs.delete(_path(spark, f"{root}/data/{folder}/{bucket}")[1], True))
    return gone
