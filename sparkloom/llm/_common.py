"""What the training-data operators share: staged tables, word rules, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class of Java's and Python's regular expressions.
WORD_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a local session gets a temporary folder; a cluster session is an
    error, as its executors could not see it.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("sparkloom.shared.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("sparkloom.shared.dir", f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: dict[str, None] = {}


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted by ``release`` or when the driver ends."""
    path = new_path(spark, name)
    _made[path] = None
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes every temporary table of this driver: once no DataFrame that reads one is needed any more."""
    for path in list(_made):
        _delete(spark, path)
        del _made[path]


@atexit.register
def _release_at_exit() -> None:
    try:
        if (spark := SparkSession.getActiveSession()) is not None:
            release(spark)
    except Exception:  # noqa: BLE001 - the session ended first; local folders need none
        pass
    for path in _made:
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost
    executor costs only the tasks after it. ``drop_staged`` or ``release`` delete the files."""
    spark = df.sparkSession
    path = temporary_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing needs any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, path)
        tail = path.rsplit("/", 1)[-1]
        for made in [m for m in _made if m.rsplit("/", 1)[-1] == tail]:
            del _made[made]


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    core = F.trim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WORD_SPACE + "+"))


def arrow_rows(
    df: DataFrame, fn: Callable[[list], list], inputs: list[str], schema: str, block: int = 512
) -> DataFrame:
    """``mapInArrow`` over columns ``inputs``: ``fn`` gets a list of column lists for ``block``
    rows at a time, and returns a list of output column lists."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                cols = fn([part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out)], schema=out)

    return df.select(*inputs).mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_owner: list[str] = []
_held: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None]) -> None:
    """Notes that a worker process keeps a cache for operator ``name``."""
    _held[name] = clear


def release_others(name: str) -> None:
    """Worker processes are used again by other operators: the first task of one frees what the
    others keep there."""
    if _owner != [name]:
        _owner[:] = [name]
        for other, clear in _held.items():
            if other != name:
                clear()
