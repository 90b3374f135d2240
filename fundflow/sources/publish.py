"""Atomic publication of result sets (S4): a reader sees one whole set, the old or the new.

    root/v=0000000007/<name>/...   a version's results
    root/_published/0000000007     its marker, created when all of them are written

A refresh writes a new version beside the published ones and creates its
marker last; the newest marker is what is published.  Creating one empty file is
atomic in every store Spark writes to (no rename takes part), so there is no moment at
which results of two versions mix.  A refresh that fails leaves a version without a
marker, which nobody reads and the next one removes.  The newest ``keep``
versions stay for readers that have opened one.  One writer at a time per root.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fundflow.session import ensure_checkpoint_dir
from fundflow.sources.sinks import write_result

MARKERS = "_published"


def _store(spark: SparkSession, path: str):
    """The file system of a path, as Spark's executors see it, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _store(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _store(spark, path)
    fs.delete(where, True)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions, oldest first."""
    return sorted(int(n) for n in _names(spark, os.path.join(root, MARKERS)) if n.isdigit())


def _folder(root: str, version: int) -> str:
    return os.path.join(root, f"v={version:010d}")


@dataclass(frozen=True)
class Published:
    """One published version, the same for every result read through it."""

    spark: SparkSession
    root: str
    version: int

    def path(self, name: str) -> str:
        return os.path.join(_folder(self.root, self.version), name)

    def names(self) -> list[str]:
        return sorted(_names(self.spark, _folder(self.root, self.version)))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def published(spark: SparkSession, root: str, below: int | None = None) -> Published | None:
    """The newest published version (older than ``below``, if given), or None."""
    known = [v for v in versions(spark, root) if below is None or v < below]
    return Published(spark, root, known[-1]) if known else None


def publish(spark: SparkSession, frames: dict[str, DataFrame], root: str, version: int | None = None,
            keep: int = 2) -> Published:
    """Write ``frames`` as a new version and make it the published one.

    A given ``version`` (a batch number) written again is withdrawn, replaced
    and published anew, so a replayed batch publishes its set once.
    """
    if keep < 1:
        raise ValueError("the published version itself must be kept")
    written = [int(m[1]) for n in _names(spark, root) if (m := re.fullmatch(r"v=(\d+)", n))]
    if version is None:
        version = max([*written, *versions(spark, root)], default=0) + 1
    fs, marker = _store(spark, os.path.join(root, MARKERS, f"{version:010d}"))
    fs.delete(marker, False)
    for name, frame in frames.items():
        write_result(frame, os.path.join(_folder(root, version), name))
    fs.create(marker, True).close()

    known = versions(spark, root)
    gone = set(known[:-keep]) - {version}
    for old in gone:  # the marker first: what is listed is whole
        _remove(spark, os.path.join(root, MARKERS, f"{old:010d}"))
    left = set(known) - gone
    for old in written:
        if old not in left and old < max(left):
            _remove(spark, _folder(root, old))
    return Published(spark, root, version)


def discard(spark: SparkSession, path: str) -> bool:
    """Remove an intermediate of ``scratch_path`` that no frame needs any more; nothing outside the scratch folder."""
    base = os.path.normpath(ensure_checkpoint_dir(spark))
    if os.path.dirname(os.path.normpath(path)) != base:
        raise ValueError(f"{path} is not an intermediate under {base}")
    fs, where = _store(spark, path)
    return bool(fs.delete(where, True))
