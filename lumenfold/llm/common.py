"""What the corpus operators share: table readers and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of intermediate tables that still exist.
_settled: dict[str, SparkSession] = {}
_own: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local session has a folder of its own; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lumenfold-"))
        named = f"file://{_own[0]}"
    return named.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a reread rather than a recomputation. Spark removes the shuffle
    files of the finished step once the driver's JVM has collected its garbage, which is asked for here: steps follow
    each other quickly, and their files would otherwise add up. ``release`` removes a table that nothing reads any
    more; the others are removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenfold/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled[path] = spark
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def named(view: DataFrame, table: DataFrame) -> DataFrame:
    """``view`` as what is to be released when ``table`` is."""
    view._settled_at = getattr(table, "_settled_at", None)
    return view


def release(*tables: DataFrame) -> None:
    """Remove tables that ``settle`` wrote and that nothing reads any more."""
    for table in tables:
        _remove(getattr(table, "_settled_at", None))


def _remove(path: str | None) -> None:
    spark = _settled.pop(path, None)
    try:
        if spark is not None:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session is already closed; the folder's own retention applies
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_settled):
        _remove(path)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end every table that was settled inside, but for those given to the function that it yields."""
    before, kept = set(_settled), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(getattr(table, "_settled_at", None))
        return table

    try:
        yield keep
    finally:
        for path in set(_settled) - before - kept:
            _remove(path)


def settled() -> set[str]:
    """The paths of tables that were settled and not yet released."""
    return set(_settled)


def release_paths(paths: set[str]) -> None:
    for path in paths:
        _remove(path)


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def packed(df: DataFrame) -> DataFrame:
    """(row, text): the text, and all other columns inside ``row``, where their names and types clash with nothing."""
    rest = [c for c, name in zip(columns(df), df.columns) if name != "text"]
    return df.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), "text")


def unpacked(rows: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``like`` again from (row, text, ...), some of them ``changed``."""
    one = lambda c: F.col("text") if c == "text" else F.col("row").getField(c)
    return rows.select(*[changed.get(c, one(c)).alias(c) for c in like.columns])


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` for a hash; those of types without one as text."""
    plain = lambda t: not any(kind in t.simpleString() for kind in ("map<", "variant"))
    return [c if plain(f.dataType) else c.cast("string") for c, f in zip(columns(df), df.schema.fields)]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of whole texts that pass between the JVM and Python at once.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lets the session pass at most ``BATCH_ROWS`` rows at once: texts are long, and both sides hold a batch several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(spark.conf.get(name))
    if not 0 < most <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_chunks(batch: pa.RecordBatch, column: int, chars: int) -> Iterator[list[str]]:
    """The texts of a batch, null as empty, in lists of about ``chars`` characters or of one longer text."""
    texts: list[str] = []
    size = 0
    for at in range(0, batch.num_rows, 64):
        for text in batch.column(column).slice(at, 64).to_pylist():
            text = text or ""
            if texts and size + len(text) > chars:
                yield texts
                texts, size = [], 0
            texts.append(text)
            size += len(text)
    if texts:
        yield texts
