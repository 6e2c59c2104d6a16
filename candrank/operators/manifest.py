"""File manifests: digests of written files, and their check against an expected list."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.sources.catalogue import opened
from candrank.sources.writers import CHUNKED


CHUNK = 1 << 20
DIGESTS = "bytes bigint, sha256 string, md5 string"


def fold(paths: list[str], chunk: int = CHUNK) -> tuple[int, str, str]:
    """(bytes, sha256, md5) of files, one after another, in the memory of one chunk."""
    sha256, md5, size = hashlib.sha256(), hashlib.md5(usedforsecurity=False), 0
    for path in paths:
        files, place = opened(path)
        with files.open_input_stream(place, buffer_size=0) as f:
            while part := f.read(chunk):
                sha256.update(part)
                md5.update(part)
                size += len(part)
    return size, sha256.hexdigest(), md5.hexdigest()


def digests(lists: DataFrame, name: str, paths: str) -> DataFrame:
    """(name, bytes, sha256, md5) for each row of lists: a name and an array of paths, whose files are taken in that order. A task reads them in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size, sha256, md5 = fold(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([size], pa.int64()), pa.array([sha256]), pa.array([md5])], names=[name, "bytes", "sha256", "md5"])

    return lists.select(name, paths).mapInArrow(run, f"{name} {lists.schema[name].dataType.simpleString()}, {DIGESTS}")


def listed(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """The files below path as Spark lists them; what is selected says whether a file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)


def named(files: DataFrame, path: str) -> DataFrame:
    """(path) of the files (file) below path that write_files returned; no folder is listed."""
    return files.select(F.concat(F.lit(f"{path}/"), "file").alias("path"))


def file_manifest(spark: SparkSession, path: str, recursive: bool = True, written: DataFrame | None = None) -> DataFrame:
    """(path, bytes, sha256, md5) of every file below path, by path, of whatever size; no content goes through Spark's rows. With written, of those that write_files
    returned, without a list of the folder.

    Where only Spark's readers open a store, a file is one value, and one of 2 GiB or more raises.
    """
    files = listed(spark, path, recursive) if written is None else named(written, path)
    one = files.select("path").first()
    if one and one.path.split(":")[0] not in CHUNKED:
        return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")).orderBy("path")
    # Each file is one task's, and tasks take files by a hash of the path. Their number is stated, as paths are small and files are not: an
    # adaptive plan would give all of them to one task.
    lists = files.select("path", F.array("path").alias("paths")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return digests(lists, "path", "paths").orderBy("path")


def verify(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): ok, mismatch, missing (expected only) or unexpected (actual only)."""
    e, a = expected.select(key, F.col(digest).alias("__e")), actual.select(key, F.col(digest).alias("__a"))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__a") == F.col("__e"), "ok").otherwise("mismatch")
    return e.join(a, key, "full").select(key, status.alias("status"))


def parts_digest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(parts, bytes, sha256) of the files of paths, one after another in that order, as one file; one task reads them in chunks."""
    lists = spark.createDataFrame([(len(paths), paths)], "parts bigint, paths array<string>")
    return digests(lists, "parts", "paths").select("parts", "bytes", "sha256")
