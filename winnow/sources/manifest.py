"""SHA-256 manifests of released files."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8 << 20
LINE = r"^([0-9a-f]{64})  (.+)$"


def checksum_manifest(spark: SparkSession, folder: str, exclude: str = "checksums.sha256") -> DataFrame:
    """path below the folder, length and digest of every file, by path.

    The listing carries no contents. Each file is streamed through the digest in chunks by the task that has its path,
    so its size is not bounded by a row; the paths are dealt over all tasks by hash.
    """
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    bare = F.regexp_replace("path", r"^file:/*", "/")
    start = F.instr(bare, root.replace("file:", "") + "/") + F.lit(len(root.replace("file:", "")) + 1)
    relative = F.substr(bare, start)
    listed = files.select(F.col("path").alias("uri"), relative.alias("path"), "length")
    listed = listed.filter(F.substring_index("path", "/", -1) != exclude).repartition("uri")
    return listed.mapInPandas(_digests, "path string, length long, sha256 string").orderBy("path")


def _digests(batches):
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "length": batch["length"], "sha256": [_file_digest(u) for u in batch["uri"]]})


def _file_digest(uri: str) -> str:
    """Digest of a file read in chunks."""
    if uri.startswith("file:"):
        store, path = arrow_fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    else:
        store, path = arrow_fs.FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))
    digest = hashlib.sha256()
    with store.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def content_manifest(df: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """path, length and digest of contents that are already rows."""
    data = F.col(content_col).cast("binary")
    return df.select(
        F.col(path_col).alias("path"), F.octet_length(data).cast("long").alias("length"), F.sha2(data, 256).alias("sha256")
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Lines of `digest  path`, by path."""
    manifest.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value")).write.text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.filter(F.col("value").rlike(LINE)).select(
        F.regexp_extract("value", LINE, 2).alias("path"), F.regexp_extract("value", LINE, 1).alias("sha256")
    )


def verify_checksums(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and status (ok, mismatched, missing, extra)."""
    found = actual.select("path", F.col("sha256").alias("found"))
    listed = manifest.select("path", F.col("sha256").alias("listed"))
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("listed").isNull(), "extra")
        .when(F.col("found") == F.col("listed"), "ok")
        .otherwise("mismatched")
    )
    return found.join(listed, "path", "full_outer").select("path", status.alias("status"))
