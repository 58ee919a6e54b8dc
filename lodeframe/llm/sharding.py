"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a few bits: numbers by equi-depth bounds (one percentile pass over all rows),
strings by a hash, so equal values share a cell. Rows are sorted by their index on the Hilbert curve through the
cells and the order is cut into runs whose row counts differ by one at most. Neighbours on the curve are
neighbours in every dimension, so each run covers a small box of the metadata and a reader can prune it by
several columns. Only DataFrame functions are used; only ids, sizes and indexes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.common import cut

BITS = 5
LAW = "rows"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with the given axes (ints of so many bits each).

    The point is brought into transposed Hilbert coordinates (inverse undo of excess work, then Gray code), and
    their bits are interleaved, the first axis leading.
    """
    n = len(axes)
    start = F.array(*[a.cast("int") for a in axes])
    steps = [(q, i) for q in (1 << b for b in range(bits - 1, 0, -1)) for i in range(n)]

    def undo(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        p = q - 1
        at = F.get(x, i)
        set_ = at.bitwiseAND(q) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(at).bitwiseAND(p)
        return F.transform(x, lambda v, j: F.when(set_, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)).otherwise(F.when(j == i, F.when(i == 0, v).otherwise(v.bitwiseXOR(swap))).when(j == 0, v.bitwiseXOR(swap)).otherwise(v)))

    moved = F.aggregate(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps]), start, undo) if steps else start
    # Gray code: each coordinate is xored with all before it
    grey = F.aggregate(moved, F.array().cast("array<int>"), lambda done, v: F.concat(done, F.array(F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(F.lit(0)).bitwiseXOR(v))))

    def twist(x: Column) -> Column:
        lead = F.element_at(x, -1)
        t = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<int>"), F.lit(0), lambda t, q: F.when(lead.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return _let(t, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def interleaved(x: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda acc, s: acc * 2 + F.getbit(F.get(x, s["i"]), s["b"]).cast("long"))

    return _let(_let(grey, twist), interleaved)


def quantised(df: DataFrame, numbers: list[str], strings: list[str], bits: int) -> list[Column]:
    """Columns of cell numbers 0 .. 2**bits - 1; a null number is in cell 0, a null string is hashed as null."""
    cells = 1 << bits
    out: list[Column] = []
    if numbers:
        shares = [k / cells for k in range(1, cells)]
        row = df.agg(*[F.percentile_approx(n, F.array(*[F.lit(s) for s in shares]), 10_000).alias(n) for n in numbers]).first()
        for n in numbers:
            bounds = sorted(set(row[n] or []))
            above = sum(((F.col(n) > b).cast("int") for b in bounds), F.lit(0))
            out.append(F.coalesce(above, F.lit(0)).cast("int"))
    out += [F.pmod(F.xxhash64(s), F.lit(cells)).cast("int") for s in strings]
    return out


def ranked(df: DataFrame, order: list[str], rank: str, parts: int) -> DataFrame:
    """df with its exact row number from 0 in the order, without gathering rows in one task.

    Range partitions are sorted and written once with their own row numbers; the partitions' sizes (one row
    each) are summed and joined back.
    """
    index = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = cut(dealt.select("*", F.shiftright(index, 33).cast("int").alias("_part"), index.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_of"), before.alias("_start"))
    # at most one row for each of the range partitions, whose number is the argument parts
    return numbered.join(F.broadcast(starts), F.col("_part") == F.col("_of")).select(*df.columns, (F.col("_start") + F.col("_at")).alias(rank))


def hilbert_shards(docs: DataFrame, *, shards: int = 8, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", string_cols: tuple[str, ...] = ("lang", "source"), rows_per_part: int = 250_000) -> DataFrame:
    """One row for each row of docs: (doc_id, size, text_crc32, law, shard, slot, grown_shard, curve).

    Law `rows`: shard sizes differ by one row at most (the first ones have more). slot counts the rows of a
    shard from 0 in curve order. size is the UTF-8 length plus 1 (null text: 1); text_crc32 of a null text is
    that of an empty one. Ties on the curve go by crc, size and id, so equal texts of the same metadata lie
    together; repeated rows are separate rows. grown_shard is null under this law. With fewer rows than shards the
    last shards are empty; an empty table gives an empty result. Strings that are not among the columns of docs
    are left out as dimensions.
    """
    placed = _placed(docs, [], shards=shards, bits=bits, id_col=id_col, text_col=text_col, string_cols=string_cols, rows_per_part=rows_per_part)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _placed(docs: DataFrame, carried: list[str], *, shards: int = 8, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", string_cols: tuple[str, ...] = ("lang", "source"), rows_per_part: int = 250_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, curve) and the carried columns of docs."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    strings = [c for c in string_cols if c in docs.columns]
    base = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[docs[c].cast("string").alias(f"_s{i}") for i, c in enumerate(strings)], *[docs[c] for c in carried])
    base = cut(base, "metadata")
    axes = quantised(base, ["size", "doc_id"], [f"_s{i}" for i in range(len(strings))], bits)
    placed = base.select("doc_id", "size", "text_crc32", hilbert_index(axes, bits).alias("curve"), *carried)
    total = base.count()
    order = ranked(placed, ["curve", "text_crc32", "size", "doc_id"], "_rank", max(1, min(4096, -(-total // rows_per_part))))
    small, more = divmod(total, shards)
    wide = (small + 1) * more  # rows in the shards that have one more
    rank = F.col("_rank")
    in_wide = rank < wide
    shard = F.when(in_wide, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - wide) / max(small, 1))).cast("int")
    slot = F.when(in_wide, rank % (small + 1)).otherwise((rank - wide) % max(small, 1)).cast("long")
    return order.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.alias("slot"), "curve", *carried)


def write_shards(docs: DataFrame, path: str, *, shards: int = 8, id_col: str = "doc_id", **options) -> None:
    """Write whole rows of docs as Parquet, one folder shard=k for each shard, in curve order within each task.

    Rows are numbered in a copy of docs, so that rows that repeat an id (or have none) go each to its own shard. An
    empty table writes no folder; a column of docs named shard is replaced by the folder's.
    """
    row = "_lodeframe_row"
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    placed = _placed(numbered, [row], shards=shards, id_col=id_col, **options).select(F.col(row).alias("_to"), F.col("shard").alias("_lodeframe_shard"), F.col("slot").alias("_slot"))
    full = numbered.join(placed, numbered[row] == F.col("_to")).select(*[numbered[c] for c in docs.columns if c != "shard"], F.col("_lodeframe_shard").alias("shard"), "_slot")
    full.repartitionByRange("shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
