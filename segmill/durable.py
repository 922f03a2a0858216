"""Intermediate tables that outlive executors, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, one machine's temporary folder
    serves if everything runs on that machine (tests); on a cluster it would lose rows, so that is an error."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is unset: executors of {master} share no folder for intermediate tables")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="segmill-"))
    return _own_dir[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is already gone
        pass


#: Rows of a narrow table that one file holds, where a bound on the rows is known.
ROWS_PER_FILE = 100_000
#: Files up to which a small table is dealt out once more instead of leaving a file for each task above.
FEW_FILES = 16

#: Tables that were written and not yet removed: what removes each, by the id of its handle.
_written: dict[str, tuple[SparkSession, str]] = {}


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage and survives lost
    executors. ``rows``, a bound on the rows where the caller knows one, keeps small tables from becoming many small
    files; they are dealt out once more for that, so what is above runs in as many tasks as ever. The files go with
    ``release``, ``release_all``, or when the driver's Python ends."""
    spark = df.sparkSession
    if rows is not None and (files := max(1, -(-rows // ROWS_PER_FILE))) <= FEW_FILES:
        df = df.repartition(files)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _written[path] = (spark, path)
    return out


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for t in tables:
        if (path := getattr(t, "_written", None)) in _written:
            _remove(*_written.pop(path))


def release_all() -> None:
    """Remove all written tables: for sessions that live on after their results have been stored elsewhere. Results that
    weren't stored can't be read any more."""
    for path in list(_written):
        _remove(*_written.pop(path))


atexit.register(release_all)
