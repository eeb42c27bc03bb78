"""File snapshots of any tree a Hadoop file system can list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Content is one binary value, which can't be longer.
HASHABLE_BYTES = 2**31 - 1 - 16


def fim_snapshot(
    spark: SparkSession,
    folder: str,
    *,
    exclude_ext: Sequence[str] = (),
    exclude_prefix: Sequence[str] = (),
    max_size: int | None = None,
    max_depth: int | None = None,
    hashable: int = HASHABLE_BYTES,
) -> DataFrame:
    """path, sha256, size_bytes, mtime_epoch and status of every file below a folder.

    Size and path tests run before any file is opened; hidden folders are left out. A file longer than ``hashable``
    bytes has a null hash and the status ``too_large``, others ``hashed``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    root = folder.split("://")[-1].rstrip("/")
    inner = F.substr(path, F.lit(len(root) + 2))
    keep = ~inner.rlike(r"(^|/)\.[^/]+/")
    if max_size is not None:
        keep = keep & (F.col("length") <= max_size)
    if max_depth is not None:
        keep = keep & (F.size(F.split(inner, "/")) <= max_depth)
    for ext in exclude_ext:
        keep = keep & ~F.lower(path).endswith(ext.lower())
    for prefix in exclude_prefix:
        keep = keep & ~path.startswith(prefix)
    rows = lambda part, digest, status: part.select(
        path.alias("path"), digest.alias("sha256"), F.col("length").alias("size_bytes"),
        F.unix_seconds("modificationTime").alias("mtime_epoch"), F.lit(status).alias("status"),
    )
    kept = files.filter(keep)
    small = rows(kept.filter(F.col("length") <= hashable), F.sha2("content", 256), "hashed")
    return small.unionByName(rows(kept.filter(F.col("length") > hashable), F.lit(None).cast("string"), "too_large"))
