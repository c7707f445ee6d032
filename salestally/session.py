"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans in this package rely on. All can be set at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # bring left joins against small query results down to a broadcast only
    # when the measured size of the finished stage allows it
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 << 20),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app: str = "salestally",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings above.

    On a cluster leave ``master`` unset and give ``shuffle_partitions`` some
    two or three times the number of cores; AQE merges what turns out small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder, remembered for the
    calls that follow; on a cluster, where such a folder is not shared, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("salestally.work.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="salestally-")
        spark.conf.set("salestally.work.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own inside the working folder."""
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a result once and read it back, in folders by the columns ``by``.

    Used where a plan reads the same result several times. The table lies in
    shared storage, so a lost executor costs a re-read and no recomputation,
    and the readers see exact sizes, which AQE needs to choose joins.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where their path does not lead to it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    known = [os.path.realpath(p or ".") for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if os.path.realpath(root) in known or getattr(context, "_salestally_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "salestally"), "zip", root, "salestally")
    context.addPyFile(archive)
    context._salestally_shipped = True
