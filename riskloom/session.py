"""Session defaults for local work and tests; a cluster brings its own."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where none is named, a local temporary folder serves a local master; a cluster has to name its own."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or _OWN.get(context.applicationId)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="riskloom-")
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below that folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: The temporary folder of an application on a local master.
_OWN: dict[str, str] = {}


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the scratch folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
