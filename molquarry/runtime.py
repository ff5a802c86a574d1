"""Session helpers: reading tables, cutting lineage, Python maps, joins with hot keys, degree of parallelism, hash randomness."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("molquarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: as a zip file of it, once an application.

    Nothing is done where ``PYTHONPATH`` already names its folder.
    """
    package = Path(__file__).resolve().parent
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    target = Path(tempfile.mkdtemp(prefix="molquarry-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) below ``folder``."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and drop their lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where
    none is named, a session on one machine (tests) takes a temporary one that
    goes with the process; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="molquarry-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share, for files that are written and read again."""
    cut(spark.range(0))  # sets the checkpoint folder where it is not set yet
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def python_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` on workers that know this package."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)


#: Keys with fewer rows than this are never hot.
HOT_LEAST = 1 << 14


def hot_keys(counts: DataFrame, key: str, n: str = "n", least: int | None = None) -> list:
    """The keys of ``counts (key, n)`` with most rows, four a task at most and none below ``least`` rows.

    Their number does not grow with the data, so they may reach the driver; a
    key beyond them holds a quarter of a task's even share at most.
    """
    hot = counts.where((F.col(n) >= (HOT_LEAST if least is None else least)) & F.col(key).isNotNull())
    return [r[0] for r in hot.orderBy(F.desc(n)).limit(4 * width(counts.sparkSession)).select(key).collect()]


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: list, by: Column | str, how: str = "inner") -> DataFrame:
    """``rows.join(table, key)`` in which rows of ``hot`` keys are dealt over all tasks by a hash of ``by``.

    ``table`` has one row a key; those of hot keys are repeated once a task.
    """
    if not hot:
        return rows.join(table, key, how)
    salts = width(rows.sparkSession)
    is_hot = F.col(key).isin(hot)
    by = F.col(by) if isinstance(by, str) else by
    left = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0).cast("bigint")))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    right = table.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0).cast("bigint")))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def width(spark: SparkSession) -> int:
    """Partitions for stages whose cost is Python time and not bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def draw(seed: int, *keys: Column | str) -> Column:
    """A repeatable random BIGINT in [0, 2^32) for a key; the same on any partitioning.

    The first eight hex digits of an MD5 over seed and keys, so that SQL
    engines with ``md5`` can repeat the draw.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, *keys: Column | str) -> Column:
    """``draw`` scaled to [0, 1)."""
    return draw(seed, *keys) / F.lit(4294967296.0)
