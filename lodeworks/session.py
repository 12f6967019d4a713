"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []
_stored: dict[tuple[str, str], str] = {}
_shipped: set[str] = set()


def local_session(app: str = "lodeworks", cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the session names one.

    Only where it is unset (a session on one machine) a temporary folder is
    made and recorded in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as a table into the shared folder, with the writer's options, and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what lies
    before, and tables read several times are computed once. The files go
    with release(), or when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def stored(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The path of a table that build(path) writes into the shared folder once a session; it stays until the session's process ends."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
        build(path)
        _stored[key] = path
        keep(spark, path)
    return _stored[key]


def keep(spark: SparkSession, path: str) -> None:
    """Remove what lies at the path when the session's process ends."""
    _kept.append((spark, path))


@contextmanager
def scope():
    """Removes, at its end, the tables that materialize() wrote inside it; results that read them must be stored by then."""
    before = len(_written)
    try:
        yield
    finally:
        for entry in _written[before:]:
            _remove(*entry)
        del _written[before:]


def stored_bytes(table: DataFrame) -> int | None:
    """Bytes of a table of materialize() as it lies in the shared folder; None for any other."""
    path = getattr(table, "_shared_path", None)
    if path is None:
        return None
    context = table.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def release(*tables: DataFrame) -> None:
    """Remove tables of materialize() that no lazy result reads any more."""
    for table in tables:
        path = getattr(table, "_shared_path", None)
        for entry in [e for e in _written if e[1] == path]:
            _remove(*entry)
            _written.remove(entry)


def ship(spark: SparkSession) -> None:
    """Give the session's workers this package, once a session; they need not have it installed."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="lodeworks-code-")) / "lodeworks.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in [*_written, *_kept]:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the session is gone; the folder is the cluster's to clear
            return


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Shuffle partitions so that each holds about per_partition rows, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_partition))
