"""Written tables that cut lineage, in the folder that all machines of the cluster share."""

import atexit
import gc
import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_OWN: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own on a single
    machine (tests), and an error on a cluster."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if "dir" not in _OWN:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        _OWN["dir"] = tempfile.mkdtemp(prefix="tidemark-")
    return f"file://{_OWN['dir']}"


def ship(spark: SparkSession, value):
    """A broadcast of any object; its class travels with it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared):
    return pickle.loads(shared.value)


class Scratch:
    """Tables of one run of an operator. Executors may be lost: readers find the files elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self.n, self.tables = 0, []
        _OWN.setdefault("bases", []).append(self.base)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._tidemark_path)
            path.getFileSystem(conf).delete(path, True)
        gone = {t._tidemark_path for t in tables}
        self.tables = [t for t in self.tables if t._tidemark_path not in gone]
        self.free()

    def keep(self, *tables: DataFrame) -> None:
        """Frees all tables but those that a result reads."""
        kept = {t._tidemark_path for t in tables}
        self.drop(*(t for t in self.tables if t._tidemark_path not in kept))

    def free(self) -> None:
        """Lets Spark remove the shuffle files of finished steps, which it does for those that
        neither Python nor the JVM refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Removes the written tables of this process from the shared folder. Results read them
    lazily, so only when no result is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for base in _OWN.pop("bases", []):
        path = jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _clean() -> None:
    import shutil

    if "dir" in _OWN:
        shutil.rmtree(_OWN["dir"], ignore_errors=True)
