"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_OWN: dict[str, str] = {}


#: Bounds of a batch on its way to a Python worker. Spark's own bound of 10,000 rows is hundreds of MB of long texts in each task.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "4m")}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it, and send them small batches unless the session says otherwise."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    given = spark.sparkContext.getConf()
    for key, (default, ours) in BATCHES.items():
        if not given.contains(key) and (default is None or spark.conf.get(key, default) == default):
            spark.conf.set(key, ours)


def bounded() -> None:
    """prepare() for functions that are given columns alone: of the session that is active, if there is one."""
    spark = SparkSession.getActiveSession()
    if spark:
        prepare(spark)


#: Bytes of texts that a function in a Python worker holds as Python strings at a time.
SLICE_BYTES = 1 << 20


def mapped(part, f: Callable[[str], str | None]):
    """f over an Arrow array of strings, null for null, a few at a time: a worker holds no more than SLICE_BYTES of them (and one text) as Python strings."""
    import pyarrow as pa

    made, at = [], 0
    step = max(1, len(part) * SLICE_BYTES // max(1, part.nbytes))
    while at < len(part):
        made.append(pa.array([x if x is None else f(x) for x in part.slice(at, step).to_pylist()], pa.string()))
        at += step
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


class Scope(list):
    """Paths written while the scope is open; those of the frames kept stay."""

    def keep(self, *frames: DataFrame) -> None:
        """frames as written() returns them. A scope around this one takes them over."""
        for frame in frames:
            path = frame._lexmill_path
            self.remove(path)
            if len(_OPEN.get()) > 1:
                _OPEN.get()[-2].append(path)


#: The scopes that are open, the innermost last; each thread has its own.
_OPEN: ContextVar[tuple[Scope, ...]] = ContextVar("open scopes", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Scope]:
    """What is written within is removed at its end, but for what was kept: only frames that read nothing else may leave."""
    scope = Scope()
    token = _OPEN.set((*_OPEN.get(), scope))
    try:
        yield scope
    finally:
        _OPEN.reset(token)
        for path in scope:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut lineage: write df once in the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out
