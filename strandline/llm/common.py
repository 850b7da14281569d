"""What the operators of this subpackage share: reading columns, cutting lineage, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Rows of an Arrow batch, so that a batch of long texts stays within a Python worker's memory.
BATCH_ROWS = 1000
#: Where nothing else is set and all runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/strandline-checkpoints"
MAX_LONG = (1 << 63) - 1
#: A key is hot where more than one in so many rows, and LEAST_HOT of them, have it: there are never more hot keys than this.
HOT_SHARE, LEAST_HOT = 4096, 1000


def prepare(spark: SparkSession) -> None:
    """Bounded Arrow batches (the one setting that is changed, and only where it is larger: long texts would not fit a Python worker
    otherwise), and a checkpoint folder: the one that the session names, or on a single machine a local one. Raises RuntimeError on a cluster
    whose session names none."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = LOCAL_CHECKPOINTS
        context.setCheckpointDir(folder)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_folders: dict[str, str] = {}


def _forget(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone; the folder is then left to whoever cleans the shared one
        delete(spark, folder)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table, which lives as long as the application."""
    prepare(spark)
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{app}-tables"
        atexit.register(_forget, spark, _folders[app])
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder: lineage ends here, lost executors don't matter."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns freed memory to the system, where its C library can: Python workers live on after their tasks, and what they hold
    unused would be missing for later stages on the same executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType, done: Callable[[], None] | None = None) -> DataFrame:
    """``function`` over every Arrow batch; it yields batches. ``done`` is called where a task ends."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
                give_back()
        if done is not None:
            done()
            give_back()

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, a null as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def keyed(docs: DataFrame) -> DataFrame:
    """(id, tag, doc_id, text): id orders documents, a null doc_id coming last; id and tag, a 64-bit hash of the text, tell apart different rows
    even where very many have no doc_id. Identical rows share both, and any result."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG)).alias("id"),
        F.xxhash64("text").alias("tag"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@contextlib.contextmanager
def shuffles_let_go(spark: SparkSession):
    """What is written inside doesn't leave its shuffle files behind."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table written once to the shared folder, compressed: for what is too large for raw checkpoints."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_let_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, found: DataFrame, keys: list[str], size: str) -> DataFrame:
    """The inner join of ``rows`` with ``found``, which has one row for each of some keys and says in ``size`` how many of ``rows`` have the key. Rows of
    hot keys, of which there are ``HOT_SHARE`` at most, never meet in one task: their side of ``found`` is broadcast."""
    least = max(LEAST_HOT, rows.count() // HOT_SHARE)
    hot = F.broadcast(found.where(F.col(size) > least))
    rest = rows.join(F.broadcast(found.where(F.col(size) > least).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(found.where(F.col(size) <= least), keys))


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that very many of ``rows`` have, ``HOT_SHARE`` at most, to be broadcast."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(counts.where(F.col("n") > max(LEAST_HOT, rows.count() // HOT_SHARE)).select(*keys, F.lit(True).alias("hot")))


def salted(large: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner", salts: int = 64) -> DataFrame:
    """The join of ``large`` with ``small``, which has one row a key at most. Rows of ``large`` with one of the keys ``hot`` (see ``hot_keys``) are
    dealt over ``salts`` tasks, and the rows of ``small`` that they meet are copied so often."""
    large = large.withColumn("at", F.monotonically_increasing_id()).join(hot, keys, "left")
    large = large.withColumn("salt", F.when(F.col("hot"), F.pmod("at", F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("hot", "at")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    small = small.join(hot, keys, "left").withColumn("salt", F.explode(copies)).drop("hot")
    return large.join(small, [*keys, "salt"], how).drop("salt")


def squeeze(df: DataFrame, once: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its column text compressed, as z and size: texts that have to be shuffled take a third of the room. Of rows of a
    batch that are the same in the columns ``once``, only the first goes on."""
    names = [n for n in df.columns if n != "text"]

    def run(batch: pa.RecordBatch):
        if once:
            seen: dict[tuple, int] = {}
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in once), strict=True)):
                seen.setdefault(key, k)
            batch = batch.take(pa.array(list(seen.values())))
        codec = pa.Codec("zstd", compression_level=1)
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        z = [None if t is None else codec.compress(t, asbytes=True) for t in texts]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(z, pa.binary()), pa.array([len(t or b"") for t in texts], pa.int64())], [*names, "z", "size"])

    return map_arrow(df, run, StructType([*(df.schema[n] for n in names), StructField("z", BinaryType()), StructField("size", LongType())]))


def unsqueeze(batch: pa.RecordBatch) -> list[bytes | None]:
    """The texts of a batch of ``squeeze``, as UTF-8."""
    codec = pa.Codec("zstd")
    return [None if z is None else codec.decompress(z, n, asbytes=True) for z, n in zip(batch.column("z").to_pylist(), batch.column("size").to_pylist(), strict=True)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame, tag) -> DataFrame:
    """(id, tag, row, text): the columns of ``docs`` but text in one, so that no name of theirs can clash with others."""
    others = [F.col(quoted(n)) for n in docs.columns if n != "text"]
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG)).alias("id"), tag.alias("tag"), F.struct(*others).alias("row"), "text")


def unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the columns row and text."""
    return rows.select(*[F.col("text") if n == "text" else F.col(f"row.{quoted(n)}").alias(n) for n in docs.columns])


def keep_rows(docs: DataFrame, columns: list[str], good: Callable[..., np.ndarray]) -> DataFrame:
    """The rows of ``docs`` for which ``good`` is true; it gets these columns of a batch, null throughout where ``docs`` lacks one. All columns as they are."""
    rows = docs.select(F.struct(*[F.col(quoted(n)) for n in docs.columns]).alias("row"))

    def run(batch: pa.RecordBatch):
        own = batch.column(0)
        given = [own.field(c) if c in docs_columns else pa.nulls(batch.num_rows, pa.string()) for c in columns]
        yield batch.filter(pa.array(good(*given), pa.bool_()))

    docs_columns = docs.columns
    return map_arrow(rows, run, rows.schema).select("row.*")


def pick(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` (id, tag of ``marked``, no two the same) names; of identical ones, one."""
    rows = squeeze(boxed(docs, F.xxhash64("text")), once=("id", "tag"))
    found = rows.join(chosen, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"])

    def run(batch: pa.RecordBatch):
        yield pa.record_batch([batch.column("row"), pa.array(unsqueeze(batch), pa.binary()).cast(pa.string())], ["row", "text"])

    return unboxed(map_arrow(found, run, StructType([found.schema["row"], StructField("text", StringType())])), docs)
