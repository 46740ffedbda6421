"""Session settings and the shared staging folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

WRITERS_SETTING = "spark.sql.maxConcurrentOutputFileWriters"
HASH_SETTING = "spark.sql.execution.useObjectHashAggregateExec"
# Settings the operators rely on. AQE splits skewed join partitions and sizes
# shuffles at run time, so only an upper partition count has to be given.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # routed rows go to three partitions: write them side by side instead of sorting first
    WRITERS_SETTING: "8",
}
_own_root: str | None = None


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the library's settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    global _own_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return _own_root


def stage(
    df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "snappy", sorted_groups: bool = False
) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Used where several consumers need the same rows: the written table cuts the
    lineage, survives lost executors, and each consumer still prunes columns. ``sorted_groups`` says that the groups
    whose rows are collected come sorted, so no hash table of them is tried first.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/ledgerloom/{uuid.uuid4().hex}/{name}"
    with (
        _side_by_side(spark) if partition_by else nullcontext(),
        _settings(spark, {HASH_SETTING: "false"}) if sorted_groups else nullcontext(),
    ):
        df.write.partitionBy(*partition_by).option("compression", codec).parquet(path)
    if _scopes:
        _scopes[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _side_by_side(spark: SparkSession):
    """Write few partitions side by side also in sessions without SETTINGS, which would sort all rows first."""
    return _settings(spark, {WRITERS_SETTING: SETTINGS[WRITERS_SETTING]})


@contextmanager
def _settings(spark: SparkSession, unless_set: dict[str, str]) -> Iterator[None]:
    """Settings for one write; what the session has set itself stays."""
    chosen = {k: v for k, v in unless_set.items() if spark.conf.get(k, None) is None}
    for key, value in chosen.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in chosen:
            spark.conf.unset(key)


class StagingScope:
    """Folders staged while the scope is open."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave the table that was staged last, which ``df`` reads, out of the scope."""
        kept = self.paths.pop()
        if len(_scopes) > 1 and _scopes[-1] is self:
            _scopes[-2].paths.append(kept)
        return df

    def drop(self, paths: list[str] | None = None) -> None:
        """Delete the folders, or only ``paths``. Results that still read them can't be computed any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for path in list(self.paths if paths is None else paths):
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
            self.paths.remove(path)


_scopes: list[StagingScope] = []


@contextmanager
def staging_scope(spark: SparkSession, drop: bool = True) -> Iterator[StagingScope]:
    """Collect what is staged inside and, where ``drop`` holds, delete it at the end.

    Tables that the result still reads are kept with ``keep``. Without ``drop`` the caller
    deletes the folders once the result is written.
    """
    scope = StagingScope(spark)
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        if drop:
            scope.drop()
