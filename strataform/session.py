"""Session helpers: a local session for tests and benches, code shipping, and lineage cuts."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A single-JVM session. On a cluster the caller passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strataform")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions can import it
    there (worker-side caches then live as long as the worker)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    d = tempfile.mkdtemp(prefix="strataform-code-")
    path = os.path.join(d, "strataform_code.zip")
    Path(path).write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir, which all executors share. Where it is unset, a session in one
    process (tests) gets a folder of its machine; any other is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strataform-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: reused results are computed once and survive
    the loss of an executor. Spark deletes the files once nothing refers to them, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
