"""Session helpers: a local session for tests, and the shared working folder."""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "leadline", folder: str | None = None) -> SparkSession:
    """Local session for tests and the benchmark, with a folder for stage tables; on a cluster the session comes from outside."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(n))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false"))
    spark = (spark.config("spark.checkpoint.dir", folder) if folder else spark).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The application's folder in the one that the cluster names in spark.checkpoint.dir, or else in the warehouse.

    Both are shared by all executors. Everything written there belongs to the application of that id and can be removed
    when it has ended.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/stages-{context.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def file_versions(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Name, size and time of the files at these paths; a missing one has none."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(conf)
        if system.exists(at):
            found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(at)]
    return tuple(found)


#: Stages that a driver starts at once; each is a job of its own, which Spark schedules beside the others.
STARTED_TOGETHER = 4


def together(spark: SparkSession, *steps: Callable) -> list:
    """The results of steps that do not need each other, in their order; each may run jobs. The first error is raised."""
    with ThreadPoolExecutor(STARTED_TOGETHER) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


#: Write option for a new folder of very many files: each task puts its own in place, where the driver would move all of them
#: alone. A repeated task replaces its files by their names.
COMMIT = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def list_in_few_tasks(spark: SparkSession) -> None:
    """Let this session list folders in four tasks for each core; Spark's default is a task for each of up to 10,000 folders.

    It stays set, since streams list their folders long after they were started. A lower setting of the caller is kept.
    """
    most = max(32, 4 * spark.sparkContext.defaultParallelism)
    if int(spark.conf.get(LISTING)) > most:
        spark.conf.set(LISTING, most)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back, so that a lost executor never replays earlier stages."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
