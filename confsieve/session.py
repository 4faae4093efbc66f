"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders given out by run_folder, and the temporary folder of a local session that names none.
RUN_FOLDERS: list[str] = []
_LOCAL_FOLDER: list[str] = []


def local_session(app: str = "confsieve", cores: str = "*") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if not _LOCAL_FOLDER:  # Spark does not let this setting be changed while a session runs
            _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="confsieve-"))
        folder = _LOCAL_FOLDER[0]
    return folder


def run_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own for one run, below the shared folder. :func:`remove_run_folders` removes those of this process."""
    folder = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    RUN_FOLDERS.append(folder)
    return folder


def remove_run_folders(spark: SparkSession) -> None:
    """Removes what the runs of this process have written below the shared folder, for callers that have read their results."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while RUN_FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(RUN_FOLDERS.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that a lost executor costs a re-read and not a recomputation."""
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
