"""Session helpers shared by the library: package shipping and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_written: ContextVar[list | None] = ContextVar("written", default=None)

#: Bytes of an Arrow batch where the session has Spark's default of 64 MB, which several tasks of one executor hold several times over.
_BATCH, _DEFAULT, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 1 << 20
#: Whether a statement's shuffle files are removed at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application), and keep Arrow batches small unless the session sets them.

    Nothing is done in local mode where PYTHONPATH already names the package's parent folder; executors elsewhere need not have it."""
    if spark.conf.get(_BATCH, None) == _DEFAULT:
        spark.conf.set(_BATCH, str(_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT.parent) in paths and spark.sparkContext.master.startswith("local["):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{_ROOT.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(out)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share.

    Where that setting is absent a local temporary folder is used, in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/spark-{uuid.uuid4().hex}"


def _read(df: DataFrame, path: str) -> DataFrame:
    """What lies in a folder that df was written to."""
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path  # for discard()
    if (made := _written.get()) is not None:
        made.append(out)
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return _read(df, path)


def _append(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """As materialize(), with least disk: files are compressed more, and the shuffle files of the write go with it, not whenever the driver collects its garbage."""
    path = shared_folder(df.sparkSession)
    _append(df, path)
    return _read(df, path)


def stored_in_turn(makes: list[Callable[[], DataFrame]]) -> DataFrame:
    """The rows of all tables that the functions make, written one after another; the tables that each writes on its way are deleted before the next one's turn."""
    path = None
    for make in makes:
        with scratch():
            df = make()
            path = path or shared_folder(df.sparkSession)
            _append(df, path)
    return _read(df, path)


def once(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """df, stored unless it, or the table that it is a plain selection of, is a written one already."""
    return df if hasattr(df if source is None else source, "_written") else stored(df)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables of materialize() that are made inside are deleted at the end, but for those that the given function was called with.

    What leaves such a block otherwise must not read from its tables any more."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    outer = _written.get()
    token = _written.set(made)
    try:
        yield keep
    finally:
        _written.reset(token)
        discard(*[t for t in made if not any(t is k for k in kept)])
        if outer is not None:
            outer += kept


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
