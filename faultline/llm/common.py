"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents are handed to Python in Arrow batches; a batch is worked on in slices of about so many characters.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the needed columns, so that whatever else the input has can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset and the
    session runs on this machine alone (tests). On a cluster it has to be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            import tempfile

            _own_dir.append(tempfile.mkdtemp(prefix="faultline-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        at = f"file://{_own_dir[0]}"
    return at.rstrip("/")


def written(df: DataFrame, what: str, clean: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors. With
    ``clean``, the shuffle files behind it are given back now, not when the driver next collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/faultline-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._faultline_paths = [path]
    if clean:
        spark._jvm.System.gc()
    return out


def standing_on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which reads ``tables`` when it runs: ``unlink`` of it deletes them."""
    df._faultline_paths = [p for t in tables for p in getattr(t, "_faultline_paths", [])]
    return df


def unlink(*dfs: DataFrame) -> None:
    """Delete the tables of ``written`` that ``dfs`` read, when nothing lazy refers to them any more. A result that
    isn't unlinked keeps one small table; all others are deleted by the operators themselves."""
    for df in dfs:
        jvm = df.sparkSession._jvm
        for path in getattr(df, "_faultline_paths", []):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each holds about SLICE_CHARS bytes of text, or one long row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + SLICE_CHARS, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to more tasks where a table has fewer row groups than there are cores; large tables aren't moved.
    Rows are dealt by their number in the scan, so equal rows don't gather."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    query = df._jdf.queryExecution()
    plan = query.optimizedPlan()
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if plan.collectLeaves().size() != 1 or int(str(plan.stats().sizeInBytes())) >= cores * split or query.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    if df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("n"))
    return rows.repartition(2 * cores, "n").select("row.*")


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """``fn`` over slices of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    return spread(df).mapInArrow(lean(run), schema)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives its memory back when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` on a group, as ``lean``."""

    def group(rows: pa.Table) -> pa.Table:
        out = run(rows)
        give_back()
        return out

    return group


def give_back() -> None:
    """Workers live on for the next operators, so what a task freed goes back to the system, and memos to which it didn't
    add, as they are of other operators, are dropped."""
    for memo in [m for m in (r() for r in Memo.all) if m is not None]:
        if not memo.added:
            memo.clear()
            memo.old = {}
        memo.added = False
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """The bytes of all texts, and 16 for each row: counted, as the size of files says little about texts with many
    copies, and depends on how they were written."""
    return int(df.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16)).first()[0] or 0)


def row_count(df: DataFrame) -> int:
    """Rows of ``df``; of a bare Parquet table it comes from the footers."""
    return df.count()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, over an unsigned array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Memo(dict):
    """Values of words, made once, in two generations: when the younger one is full, the older one is dropped."""

    LENGTH = 48
    all: list[weakref.ref[Memo]] = []

    def __init__(self, make, most: int = 800_000):
        super().__init__()
        self.make, self.most, self.old, self.added = make, most, {}, False
        Memo.all[:] = [r for r in Memo.all if r() is not None] + [weakref.ref(self)]

    def __missing__(self, word: str) -> bytes:
        self.added = True
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > self.LENGTH:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


#: Rows of a key from which its join is split, unless the table has so many rows that a thousandth is more.
HOT = 10_000


def hot(counts: DataFrame, key: str) -> list[tuple]:
    """(key, shares) of the keys of ``counts`` (key, rows) with more than HOT rows and a thousandth of all: at most a
    thousand, so they may come to the driver."""
    total = int(counts.agg(F.sum("rows")).first()[0] or 0)
    if total <= HOT:
        return []
    least = max(HOT, total // 1000)
    return [(k, int(-(-n // least))) for k, n in counts.filter(F.col("rows") > least).select(key, "rows").collect()]


def join_spread(left: DataFrame, right: DataFrame, key: str, hot_keys: list[tuple], by: str) -> DataFrame:
    """``left`` joined with ``right``, which has a row for each ``key``. A hot key's rows of ``left`` are dealt by a hash
    of the column ``by``, and its row of ``right`` is copied to each share."""
    if not hot_keys:
        return left.join(right, key)
    spark, kind = left.sparkSession, dict(left.dtypes)[key]
    shares = spark.createDataFrame(hot_keys, f"`{key}` {kind}, shares int")
    many = left.join(F.broadcast(shares), key, "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64(by), F.col("shares")), F.lit(0)).cast("int")).drop("shares")
    few = right.join(F.broadcast(shares), key, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1))).drop("shares")
    return many.join(few, [key, "share"]).drop("share")


def roots_of(linked: np.ndarray, cut: int = 0) -> np.ndarray:
    """The least index that each index hangs together with. ``linked`` is square, or if there is a ``cut``, has the
    indexes before it as rows and those behind it as columns."""
    rows = np.arange(linked.shape[0])
    columns = np.arange(linked.shape[1]) + cut
    label = np.arange(cut + linked.shape[1])
    none = len(label)
    while True:
        least = label.copy()
        least[rows] = np.minimum(least[rows], np.where(linked, label[columns][None, :], none).min(axis=1, initial=none))
        if cut:
            least[columns] = np.minimum(least[columns], np.where(linked, label[rows][:, None], none).min(axis=0, initial=none))
        least = least[least]
        if (least == label).all():
            return label
        label = least
