"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "samewise", cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, wherever they start."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineages: the session's spark.checkpoint.dir, and only where that is unset a temporary one.

    A machine-local folder is only ever chosen for a local master; elsewhere an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"samewise-checkpoints-{os.getuid()}")
    return folder.rstrip("/")


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    Unlike a checkpoint, which inherits its plan's statistics (a join's size is the product of its sides', and in a loop that
    number grows until it fills the driver), a table has its true size. ``forget`` removes one that is no longer read;
    what is left goes with the application. ``options`` are those of the table's writer.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/samewise-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._samewise_table = path
    return out


def release(spark: SparkSession) -> None:
    """Let go of earlier plans. Python's unreachable frames hold their twins in the JVM until both sides have collected; a query of very many small plans, or
    many queries in one session, would else keep them all in the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Hand freed native memory of the driver back to the system and return what the JVM says of it, '' where it has no such command. What compiling
    and broadcasting free stays in the C library's arenas, one for each thread that ever freed any, and counts as the driver's."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    of = jvm.java.lang.Class.forName
    kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:  # by the interface's method: the server's own class is not exported
        return str(of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args))
    except Py4JError:  # another JVM or C library
        return ""


def forget(*tables: DataFrame) -> None:
    """Remove tables made by ``cut`` whose readers have all run."""
    for t in tables:
        if path := getattr(t, "_samewise_table", None):
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        if not path.startswith("file:") and "://" in path:
            return
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


_FOLDERS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
