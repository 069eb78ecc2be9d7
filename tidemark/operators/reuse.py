"""Rows that several steps read: written once to the folder that all machines share, then reread."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own on a single
    machine (tests), and an error on a cluster."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows without their lineage. Executors may be lost: the files stay."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
