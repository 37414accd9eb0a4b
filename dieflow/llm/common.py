"""What the training-data operators share: scratch tables, Arrow mapping, words.

Scratch tables cut lineage: they live in the folder the cluster names in
``spark.checkpoint.dir``, which the driver and all executors see, so a lost
executor costs a reread and never a wrong or missing row.
"""

from __future__ import annotations

import atexit
import re
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dieflow.session import shared_dir

#: Words are maximal runs of anything but space, \t, \n, \v, \f and \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes, A-Z to a-z; bytes.split() then yields exactly the words above.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/dieflow-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again; the files go when discarded or when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path, compression=codec)
    _paths[out := spark.read.schema(df.schema).parquet(path)] = path
    return out


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() wrote, once nothing reads them any more."""
    for df in tables:
        _remove(df.sparkSession, _paths.pop(df))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before; the folder is then the cluster's to clean
        pass


#: Rows of an Arrow batch: they are documents, up to megabytes each, and a batch is held by the JVM and by Python.
ARROW_ROWS = 256


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches brought down to ARROW_ROWS rows if they were larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, so that what one call holds stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return small_batches(df).mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, A-Z lower-cased, by stretches of about `size` bytes that end between words."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            m = _SPACE.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end].translate(LOWER).split()
        at = end


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for the row, however often body and its lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones, lengthened until no column of df is called so."""
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        while any(c.startswith(name) for c in taken):
            name = f"_{name}"
        return name

    return [free(n) for n in names]


#: A table smaller than this for each core, in fewer files than cores, is dealt out anew.
SMALL_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's scan; a small one in few files gives few tasks, and is dealt out over the cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(cores) if size < cores * SMALL_BYTES and len(scan.inputFiles()) < cores else scan


class Shared:
    """A broadcast value from which each Python process builds one object, once."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.key, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def build(self, make: Callable):
        if self.key not in _built:
            _built.clear()
            _built[self.key] = make(self.sent.value)
        return _built[self.key]


_built: dict[str, object] = {}
