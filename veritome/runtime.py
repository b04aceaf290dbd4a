"""Session helpers: shared scratch space, lineage cuts and table loading.

Everything that must outlive one job is written below the folder named by
``spark.checkpoint.dir``, which all executors of a cluster share. Only where that setting
is absent and the master is local (tests, notebooks) a folder of our own is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["checkpoint_dir", "cut", "load", "scratch", "session", "stored", "tables_equal"]


def session(app: str = "veritome", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, AQE and Arrow transfer."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _settle(spark: SparkSession) -> None:
    """Plan unions without pairing the partitions of their sides.

    Pairing takes for granted that both sides keep equally many partitions, which adaptive
    execution does not promise for stages it coalesces ("Can't zip RDDs with unequal numbers of
    partitions").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a folder of our own where none is configured."""
    _settle(spark)
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(known)
        return known.rstrip("/")
    now = sc.getCheckpointDir()
    if now is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veritome-"))
        now = sc.getCheckpointDir()
    return now.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    The rows survive the loss of executors, and nothing upstream is computed twice.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a parquet table below the shared folder and read it back.

    Like ``cut``, but compressed and columnar: later readers touch only the columns they use.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame | tuple[DataFrame, ...]:
    """Parquet tables of a data folder by name."""
    _settle(spark)
    out = tuple(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names)
    return out[0] if len(out) == 1 else out


def tables_equal(a: DataFrame, b: DataFrame, keys: Iterable[str] | None = None) -> bool:
    """Whether two frames hold the same rows as bags; for tests."""
    cols = list(keys or a.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def void_safe(df: DataFrame) -> DataFrame:
    """Columns of the null type as strings, so that every sink takes them."""
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "void"})
