"""Session defaults and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where the session names none (a single-machine test), a temporary folder is made once and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


_STAGES: dict[str, list[str]] = {}


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    Parquet rather than a checkpoint, so that later readers fetch only the columns they use. :func:`release` removes the stage
    once nothing reads it any more; stages that are left are removed when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _STAGES:
        atexit.register(_remove_left, spark, app)
    _STAGES.setdefault(app, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*stages: DataFrame) -> None:
    """Remove materialized stages that no later job reads, nor recomputes from."""
    for df in stages:
        path = df.__dict__.pop("stage_path", None)
        if path:
            spark = df.sparkSession
            _STAGES[spark.sparkContext.applicationId].remove(path)
            _delete(spark, path)


def _remove_left(spark: SparkSession, app: str) -> None:
    try:
        for path in _STAGES.pop(app, []):
            _delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended before
        pass
