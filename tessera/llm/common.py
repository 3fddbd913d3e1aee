"""What several operators share: checkpoints, Arrow batches and hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


#: Rows, and bytes, that go to a Python worker at a time; Spark's own 10,000 rows are 30 MB of texts, in and out, for each task.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def python_pass(rows: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package on the executors. Batches are short unless the session says how long they are to be."""
    spark = rows.sparkSession
    ship(spark)
    said = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in said:
            spark.conf.set(key, value)
    return rows.mapInArrow(function, schema)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names. Only a session within one process may do without, and then has a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(folder)


def cut(frame: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder: a lost executor takes none of them along."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def used_up(*frames: DataFrame) -> None:
    """Deletes the files of checkpoints that nothing will read any more: all that was made of them is written itself."""
    for frame in frames:
        spark = frame.sparkSession
        name = frame._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if name.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(name.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that in texts of ASCII alone, which it handles much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: Bits of a key filter: 2,048 bitmaps of 4 KB, 8 MB in all, however many keys there are.
FILTER_BITS = 26
#: Names that no table has.
_BUCKET, _BITS, _KEY, _FLAG, _DIGEST = (f"__tessera_{x}" for x in ("bucket", "bits", "key", "flag", "digest"))


def _slot(*columns: str) -> tuple[Column, Column]:
    """Bucket and bit of a key. Never null, so that no plan tests the key for null in its scan, at the price of hashing twice."""
    slot = F.coalesce(F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS)), F.lit(0).cast("long"))
    return F.coalesce(F.shiftright(slot, 15), F.lit(0).cast("long")), slot.bitwiseAND(32767)


def key_filter(keys: DataFrame, *columns: str) -> DataFrame:
    """A hashed bitmap of the keys, of bounded size; what it lacks is no key, and it may hold what is none."""
    bucket, bit = _slot(*columns)
    return keys.select(bucket.alias(_BUCKET), bit.alias("_bit")).groupBy(_BUCKET).agg(F.bitmap_construct_agg("_bit").alias(_BITS))


def flagged(rows: DataFrame, keys: DataFrame, *columns: str, name: str = "_hit") -> DataFrame:
    """``rows`` with a flag that is false only for rows whose key isn't among ``keys``. The bitmap is broadcast; the rows stay put."""
    bucket, bit = _slot(*columns)
    byte = F.conv(F.hex(F.substring(_BITS, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1
    joined = rows.withColumn(_BUCKET, bucket).join(F.broadcast(key_filter(keys, *columns)), _BUCKET, "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop(_BUCKET, _BITS)


def without(docs: DataFrame, lost: DataFrame, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs``, as they are, whose doc_id isn't among those of ``lost``.

    With ``digest``, a row goes only if ``lost`` also has, as digest, what that makes of its text: rows that share a doc_id, or
    have none, are told apart. Rows that a bitmap of the lost ids clears stay where they are; the others are dealt out and compared.
    """
    lost = lost.select(F.col("doc_id").alias(_KEY), *([F.col("digest").alias(_DIGEST)] if digest else []))
    marked = flagged(docs.withColumn(_KEY, F.col("doc_id").cast("long")), lost, _KEY, name=_FLAG)
    same = F.col(f"m.{_KEY}").eqNullSafe(F.col(f"l.{_KEY}"))
    unsure = marked.filter(F.col(_FLAG))
    if digest:
        unsure = unsure.withColumn(_DIGEST, digest(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        same = same & (F.col(f"m.{_DIGEST}") == F.col(f"l.{_DIGEST}"))
    checked = unsure.alias("m").join(lost.alias("l"), same, "left_anti").drop(_DIGEST)
    return marked.filter(~F.col(_FLAG)).unionByName(checked).drop(_KEY, _FLAG)


def sha256_of(text: Column) -> Column:
    """Lowercase hex digest; never null, for the reason that ``_slot`` gives."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text, a null text as the empty one; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_HASHES = 1 << 31


def bounded_sample(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """At most ``size`` of the rows, those whose doc_id has the lowest hashes, and nearly that many of more.

    All but about that many rows are dropped where they lie, by a bound on the hash that follows from their number.
    """
    n = rows.count()
    low = F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES))
    if n > size:
        rows = rows.filter(low < int(_HASHES * min(1.0, (1.1 * size + 10 * size**0.5) / n)))
    return cut(rows.orderBy(low, "doc_id", *order).limit(size))


def one_text_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents among ``ids``; of several texts of one doc_id the last in order, so no id has many rows."""
    texts = flagged(texts_of(docs), ids, "doc_id").filter("_hit").select("doc_id", "text").filter("doc_id IS NOT NULL")
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"))


def _give_back() -> None:
    """Returns free memory to the system: Spark keeps the worker, and the next pass may be another operator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: Bytes of texts that are worked on at a time, unless one text alone is longer.
SLICE_BYTES = 4 << 20


def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings of each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            total += np.asarray(pc.fill_null(pc.binary_length(column), 0))
    return total


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into short ones of so many rows and bytes of strings at most, so that what is made of one batch stays small."""
    for batch in batches:
        ends = np.cumsum(_lengths(batch))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop
    _give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
