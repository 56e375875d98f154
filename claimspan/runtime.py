"""Session and plan helpers shared by every operator.

Nothing here looks at data on the driver except figures with a proven bound
(a count, or at most ``HOT_KEYS`` heavy keys).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds more than 1/HOT_KEYS of the rows, so there are fewer than HOT_KEYS of them.
HOT_KEYS = 512


def build_session(app: str = "claimspan", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings are kept when it has any."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_claimspan_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="claimspan-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/claimspan", "zip", package.parent, package.name))
    context._claimspan_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table that was read as fewer parts than there are cores is dealt out to all of them before heavy work; any
    other is left as it is. Only for scans and what follows them without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; only on one machine (tests), where none is set, make one.

    On a cluster a machine-local folder would not outlive an executor, so a missing setting is an error there. What was
    stored is removed when the program ends, together with the folder Spark made in the shared one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="claimspan-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    atexit.register(_remove_checkpoints, context)


def _remove_checkpoints(context: SparkContext) -> None:
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone: nothing can be removed through it
        return


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns added and computed once a row. A plain projection would be merged into later ones and its
    expressions evaluated again at every use, inside array functions once an element; a generator of one row is not."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def join_one_sided_hot(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str,
    weight: str,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Equi-join of ``many`` (any number of rows a key) with ``one`` (one row a key, which carries in column
    ``weight`` how many rows of ``many`` have the key).

    Keys with more than 1/hot_keys of all rows go through a broadcast join: their number is below ``hot_keys``
    whatever the data, since their weights add up to at most the total. The rest go through an ordinary shuffle
    join, where no key can fill more than that share. Only for ``how`` = inner or left_semi.
    """
    total = one.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    limit = max(int(total) // hot_keys, 10_000)
    hot = one.where(F.col(weight) > limit)
    cold = one.where(F.col(weight) <= limit)
    if total <= limit:
        return many.join(cold, list(keys), how)
    hot_names = F.broadcast(hot.select(*keys))
    return many.join(F.broadcast(hot), list(keys), how).unionByName(
        many.join(hot_names, list(keys), "left_anti").join(cold, list(keys), how)
    )
