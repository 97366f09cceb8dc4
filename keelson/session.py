"""Session defaults, reliable checkpoints and salted joins."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where set, small tables of long texts are dealt to so many partitions when read. A cluster
#: leaves it unset: its tables have many files.
READ_PARTITIONS = "spark.keelson.readPartitions"
#: Spark's setting to remove the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(
    app: str = "keelson", cores: str = "*", partitions: int = 8, memory: str = "16g"
) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small tables here can still be much work per row: keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config(READ_PARTITIONS, str(partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _ready_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="keelson-checkpoint-"))
    else:
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the reliable checkpoint folder and go on from the files.

    Parquet takes a fraction of the bytes of a checkpoint's rows. The shuffles behind the files are
    not read again and go at once.
    """
    spark, path = df.sparkSession, shared_scratch(df.sparkSession)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    if _scopes():
        _scopes()[-1].append(path)
    return written


def stored(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for tables that grow with the input: no join may broadcast them.

    Their files are a small part of what their rows take in the driver's memory, so that Spark's
    estimate is far too low for a driver that builds several of them.
    """
    written = cut_lineage(df)
    hinted = written.hint("merge")
    hinted.scratch_path = getattr(written, "scratch_path", None)
    return hinted


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends so many rows to Python at once: for rows of any length."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_local = threading.local()


def _scopes() -> list[list[str]]:
    """The paths written in each of this thread's open blocks of ``scratch_tables``."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are written inside the block are removed when it ends.

    Those that the block appends to the list it is given stay, and belong to the block around it,
    if there is one. Nothing that reads any of the others may be used later.
    """
    kept: list[DataFrame] = []
    _scopes().append([])
    try:
        yield kept
    except BaseException:
        kept = []
        raise
    finally:
        paths = _scopes().pop()
        named = {getattr(frame, "scratch_path", None) for frame in kept}
        _remove(spark, [p for p in paths if p not in named])
        if _scopes():
            _scopes()[-1].extend(p for p in paths if p in named)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        with contextlib.suppress(Py4JError):  # what cannot go now goes with the driver
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def released(*frames: DataFrame) -> None:
    """Remove written tables that nothing reads any more, before their block ends."""
    for frame in frames:
        path = getattr(frame, "scratch_path", None)
        if path is not None:
            _remove(frame.sparkSession, [path])


def salted_join(
    many: DataFrame,
    few: DataFrame,
    on: list[str],
    spread_by: list[str],
    salts: int | Column = 16,
    how: str = "inner",
) -> DataFrame:
    """Inner or left join where single keys of ``many`` may hold a large share of its rows.

    Rows of ``many`` go to one of ``salts`` slices by the hash of ``spread_by``; every row of
    ``few`` is repeated once per slice, so a hot key is spread over ``salts`` tasks. ``salts`` may be
    one of the columns in ``on``, where the keys have known sizes.
    """
    slices = F.lit(salts) if isinstance(salts, int) else salts
    salt = F.pmod(F.xxhash64(*spread_by), slices).cast("int")
    return (
        many.withColumn("_salt", salt)
        .join(
            few.withColumn("_salt", F.explode(F.sequence(F.lit(0), (slices - 1).cast("int")))),
            [*on, "_salt"],
            how,
        )
        .drop("_salt")
    )


def spread_join(
    many: DataFrame, few: DataFrame, on: list[str], spread_by: list[str], salts: int = 64
) -> DataFrame:
    """Inner join like ``salted_join`` for wide rows of ``few``.

    They are copied only to the slices that ``many`` has rows in for their key: never more copies
    than rows of ``many``, and none of rows without a partner. Reads ``many`` twice.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    dealt = many.withColumn("_salt", salt)
    copies = few.join(dealt.select(*on, "_salt").distinct(), on)
    return dealt.join(copies, [*on, "_salt"]).drop("_salt")


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high]; null stays null, unlike with bare ``least``/``greatest``."""
    limited = column
    if high is not None:
        limited = F.least(F.lit(high), limited)
    if low is not None:
        limited = F.greatest(F.lit(low), limited)
    return F.when(column.isNotNull(), limited)


def require_columns(df: DataFrame, required, what: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing {what} columns: {', '.join(missing)}")


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    As a plain projection it would be copied into every later expression and filter that uses
    it; a generator of one row per row is left where it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def shared_scratch(spark: SparkSession) -> str:
    """A new path below the checkpoint folder, which every executor can reach."""
    _ready_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
