"""Session helpers: shared checkpoint folder, checked broadcasts."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A grouped statistic is broadcast only up to this many rows.
BROADCAST_ROWS = 200_000
# Stored bytes behind a shuffle partition: in memory, rows take ten to thirty times that.
PARTITION_BYTES = 4 << 20
# Written tables hold wide decimals, whose leading bytes repeat.
CODEC = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and read them back.

    For rows that several branches of a query read: filters and columns asked
    by one branch are pushed into its own scan of the written table, not into a
    second run of everything before it.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.option("compression", CODEC).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that `stage` has written, once nothing reads them any more."""
    for table in tables:
        _remove(table.sparkSession, table.staged_path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def stored_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Lengths of the files, or of all under the folders; a path that does not exist has none."""
    context = spark.sparkContext
    jvm, conf, total = context._jvm, context._jsc.hadoopConfiguration(), 0
    for path in set(paths):
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        total += fs.getContentSummary(place).getLength() if fs.exists(place) else 0
    return total


def partitions_for(spark: SparkSession, paths: Sequence[str]) -> int:
    """Shuffle partitions for rows made of the stored files: they grow with the
    files, whatever the session's setting, and there is one a core at least."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(stored_bytes(spark, paths) / PARTITION_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows shuffled by the keys into partitions of bounded size, `partitions_for` its files.

    For groups that have few rows each: grouping by the keys then needs no further
    shuffle, and no task of the scan gathers (or sorts) the groups of its whole
    split first, which combines nothing and spills. Rows that come from no files
    are left to Spark.
    """
    files = df.inputFiles()
    if not files:
        return df
    return df.repartition(partitions_for(df.sparkSession, files), *[F.col(f"`{k}`") for k in keys])


def spread_rows(df: DataFrame) -> DataFrame:
    """`spread` for grouping by all columns; floating numbers are left out of the keys,
    since grouping takes 0.0 and -0.0 for equal."""
    return spread(df, *([c for c, kind in df.dtypes if kind not in ("double", "float")] or df.columns))


@contextmanager
def shuffled_wide(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Jobs run inside shuffle into that many partitions at least, and AQE does not join
    them to its advisory size, which is of compressed bytes; it still splits hot ones."""
    number, joined = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {name: spark.conf.get(name) for name in (number, joined)}
    spark.conf.set(number, str(max(int(before[number]), partitions)))
    spark.conf.set(joined, "false")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def files_print(spark: SparkSession, *paths: str) -> str:
    """A fingerprint of the files under the paths: names, lengths and modification times.

    Only listings are read, folder by folder; a path that does not exist is empty.
    """
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    digest, folders = sha256(), [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    while folders:
        folder = folders.pop()
        fs = folder.getFileSystem(conf)
        found = [(s, s.toString()) for s in (fs.listStatus(folder) if fs.exists(folder) else [])]
        for _, said in sorted(found, key=lambda f: f[1]):
            digest.update(repr(re.findall(r"path=[^;]*|length=\d+|modification_time=\d+", said)).encode())
        folders += [s.getPath() for s, said in found if "isDirectory=true" in said]
    return digest.hexdigest()


_kept: dict[tuple[str, str], tuple[str, str, StructType]] = {}


def kept(spark: SparkSession, key: str, build: Callable[[], DataFrame], sources: Sequence[str] = ()) -> DataFrame:
    """A cleaned table, written once a session in the shared folder and read many times.

    The first call under a key builds and writes it; every report then prunes its
    own scan of the written table. When the files under `sources` have changed since,
    it is built anew and the old version is removed: results that were not computed
    before that are to be asked for again. `drop_kept` removes the files. All of the
    build shuffles into as many partitions as the sources ask for.
    """
    name = (spark.sparkContext.applicationId, key)
    version = files_print(spark, *sources)
    if name not in _kept or _kept[name][0] != version:
        path = scratch_path(spark, "kept")
        with shuffled_wide(spark, partitions_for(spark, sources)):
            df = build()
            df.write.option("compression", CODEC).parquet(path)
        old = _kept.get(name)
        _kept[name] = version, path, df.schema
        if old:
            _remove(spark, old[1])
    _, path, schema = _kept[name]
    return spark.read.schema(schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Remove the tables that `kept` has written in this session."""
    for name in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        _remove(spark, _kept.pop(name)[1])


def attach(rows: DataFrame, stats: DataFrame, on: str | list[str], how: str = "left",
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a per-group statistic back onto its rows.

    The statistic is computed first, once; with its row count known it is
    broadcast up to `max_rows`, so that a skewed group key does not shuffle the
    rows. Beyond that the join shuffles, and AQE splits the hot keys.
    """
    stats = materialize(stats)
    if stats.count() <= max_rows:
        stats = F.broadcast(stats)
    return rows.join(stats, on, how)


def build_session(master: str, app: str, shuffle_partitions: int, **extra: str) -> SparkSession:
    """Local session used by the tests and the benchmark."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
