"""Stored tables that cut lineage, and small files in any file system Spark can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that the open scopes remove, the innermost scope last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of this machine only in local mode where that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    from tempfile import gettempdir

    return f"file://{gettempdir()}/pathweave-scratch"


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path for a scratch table, which goes when the innermost scope ends, or with ``keep`` the one around that."""
    path = f"{scratch_dir(spark)}/pathweave-{name}-{uuid.uuid4().hex}"
    owners = _scopes.get()[: -1 if keep else None]
    if owners:
        owners[-1].append(path)
    return path


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: later jobs start there, and losing an executor loses no level."""
    path = new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by rounds, kept in one scratch folder: one scan reads it, however many rounds there are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, new_path(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Store one round and read it back."""
        path, self.schema, self.n = f"{self.path}/round={self.n}", df.schema, self.n + 1
        df.write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round=*")


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are removed at the end; what is read later must be stored with ``keep``."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            delete(spark, path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Replace a small file: written beside its place, then renamed over it in one step, so that a reader finds the old or the new one."""
    fs, p = _hadoop(spark, path)
    _, beside = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    replace(spark, beside.toString(), path)


def replace(spark: SparkSession, source: str, path: str) -> None:
    """Rename a file over another in one step."""
    files = spark._jvm.org.apache.hadoop.fs
    (_, beside), (_, p) = _hadoop(spark, source), _hadoop(spark, path)
    modes = spark._sc._gateway.new_array(getattr(files, "Options$Rename"), 1)
    modes[0] = getattr(files, "Options$Rename").OVERWRITE
    files.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, p, modes)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)
