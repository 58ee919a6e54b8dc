"""Shared helpers: the shared scratch folder, lineage cuts, text blocks, word hashes and exact ranks.

Every helper treats a null text as a text without words, and none of them reads
more than one bounded block of texts at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of text that one vectorised step looks at (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local folder of this session if all of it runs on this
    machine (tests), and an error on a cluster, whose executors would not share it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        checkpoint = context._jsc.sc().getCheckpointDir()
        found = checkpoint.get() if checkpoint.isDefined() else None
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later plans start from files that
    outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/lodeframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2500) -> None:
    """From now on this session's Arrow batches hold so many rows at most: with whole texts in them, Spark's own
    default of 10,000 takes some hundred MB in each executor, on both sides of the Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some UTF-8 texts: byte offsets in the joined buffer, the text each
    belongs to, and a 64-bit hash of its bytes."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.buffer = np.frombuffer(joined, dtype=np.uint8)
        white = _WHITE[self.buffer]
        before = np.empty_like(white)
        before[0], before[1:] = True, white[:-1]
        self.starts = np.flatnonzero(before & ~white)
        self.ends = np.flatnonzero(white & ~before)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_starts = np.cumsum(lengths) - lengths
        self.text = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.hashes = np.empty(len(self.starts), dtype=np.uint64)
        low = 0
        while low < len(self.starts):  # a bounded stretch at a time, whatever the text's length
            base = self.starts[low]
            high = max(low + 1, int(np.searchsorted(self.starts, base + BLOCK_BYTES)))
            stretch = self.buffer[base : self.ends[high - 1]]
            up, down = _powers(len(stretch) + 1)
            sums = np.zeros(len(stretch) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[stretch] * up[: len(stretch)], out=sums[1:])
            first, last = self.starts[low:high] - base, self.ends[low:high] - base
            self.hashes[low:high] = mix64((sums[last] - sums[first]) * down[first])
            low = high

    def bounds(self) -> np.ndarray:
        """For each text the index of its first word, and the number of words at the end."""
        return np.append(np.searchsorted(self.starts, self.text_starts), len(self.starts))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k successive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= np.uint64(0x100000001B3 * 0x5851F42D4C957F2D % (1 << 64) | 1)
        out += hashes[i : n + i]
    return mix64(out)


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most limit bytes together, or one row."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        if i > low and held + len(t) > limit:
            yield low, i
            low, held = i, 0
        held += len(t) + 1
    if low < len(texts):
        yield low, len(texts)


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+, null as 0, JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


def with_prefix(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, *, before: str = "before", per_bucket: int = 5_000) -> DataFrame:
    """Adds the exact sum of value over the rows of the same keys that come earlier in order.

    order[0] has to be a hash spread over all longs: its top part deals the rows of each key into buckets, so
    a key with a third of all rows is summed in many tasks; bucket totals (keys x buckets rows) are summed
    first and joined back. Null keys form a group of their own. Rows with equal order get any order among them.
    """
    n = buckets_for(rows, per_bucket)
    # floor((hash + 2^63) / 2^64 * n), in an order that follows the hash
    bucket = F.least(F.floor((F.col(order[0]).cast("decimal(38,0)") + F.lit("9223372036854775808").cast("decimal(38,0)")).cast("double") / F.lit(float(1 << 64)) * n), F.lit(n - 1)).cast("int")
    dealt = df.withColumn("_bucket", bucket)
    flat = [F.struct(*[F.col(k) for k in keys]).alias("_key")]
    totals = dealt.groupBy(*flat, "_bucket").agg(F.sum(value).alias("_sum"))
    past = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_key", F.col("_bucket").alias("_at"), F.coalesce(F.sum("_sum").over(past), F.lit(0)).cast("long").alias("_past"))
    joined = dealt.withColumn("_own", flat[0]).join(totals, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_at")))
    inner = Window.partitionBy("_own", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn(before, (F.col("_past") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long"))
    return out.select(*df.columns, before)


def spread(column: Column) -> Column:
    """A hash over all longs that is not the one Spark deals its partitions by."""
    return F.xxhash64(F.lit("lodeframe"), column)


def long_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])
