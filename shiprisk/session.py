"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock, ANSI casts (the 4.x default),
# adaptive execution for runtime re-planning, skew splitting and
# size-checked broadcast of small join sides.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # The JVM doesn't compile methods above this size: stages over some fifty
    # columns run operator by operator instead of as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "shiprisk", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Pin the SQL settings on an existing session (driver-provided ones)."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is read, never
    replaced.  Only when it is unset on a local master (tests) a private
    folder is made and registered; elsewhere that is an error, as a folder of
    one machine is no place for tables that all executors read.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a local SparkContext
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc is not None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="shiprisk-")
    if sc is not None:
        sc.setCheckpointDir(local)
    else:
        spark.conf.set("spark.checkpoint.dir", local)
    return local


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}-jobs.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (for per-application memos)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return f"session-{id(spark)}"


def parallelism(spark: SparkSession) -> int:
    """Cores available to the application (shuffle partitions as fallback)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared root for one job run."""
    root = shared_root(spark)
    # checkpoint dirs come back as a URI or a plain path; keep the scheme.
    return f"{root}/shiprisk-work/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for driver-side listing in local tests."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.normpath(path)
