"""Histogram sort into shards of near equal bytes.

Rows are ordered by (hash of the text, doc_id, a number dealt to each row), so equal texts are neighbours. Exact bytes below candidate boundaries are
counted over all partitions; each round looks only inside the ranges that still hold an unsettled splitter and halves them
BITS times, until every splitter lies within TOLERANCE of its target or no finer boundary exists. Boundaries between texts
come first, so a group of equal texts stays whole where the tolerance allows, and only a group too large for that is cut, by
doc_id, and among rows equal in both by the dealt number. Rows then move once, to (shard, slice); a slice is a hashed share of a shard, so a shard of any size has its slots
numbered by many tasks.

Defined cases: a null text has no bytes (size 8, crc 0); a null doc_id sorts first; repeated rows are neighbours and parted where the law needs it; no rows, no
splitters; the operator's own columns are named with a leading underscore.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from busloom.llm.common import keep

#: Bits that a round adds to a boundary, and how far bytes below a splitter may be from the target, in shards.
BITS, TOLERANCE = 11, 0.02
#: Rows that one task numbers.
SLICE_ROWS = 500_000
SIGN = -(1 << 63)
#: The order of the rows: hash of the text, doc_id, number among all rows.
WORDS = ("_hash", "_id", "_row")
WIDTH = 64 * len(WORDS)


def row_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def row_crc(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def with_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds the WORDS of the order, longs that sort as signed numbers; write the result before it is read twice, as _row is dealt once."""
    return docs.withColumns({
        "_hash": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        "_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(SIGN)),
        "_row": F.monotonically_increasing_id(),
    })


@dataclass
class Range:
    """An interval of the order, WIDTH bits long: its first `bits` bits are `prefix`, `below` bytes lie before it."""

    prefix: int
    bits: int
    below: int
    size: int
    targets: list[tuple[int, float]] = field(default_factory=list)


def leading(bits: int) -> Column:
    """Of the first bits of the order, those in the last word that they reach, as an unsigned number in a long; 0 bits: 0."""
    if not bits:
        return F.lit(0).cast("long")
    word = (bits - 1) // 64
    return F.shiftrightunsigned(F.col(WORDS[word]).bitwiseXOR(F.lit(SIGN)), 64 * (word + 1) - bits)


def signed(value: int) -> int:
    """A 64-bit unsigned number as Spark's long."""
    return value - (1 << 64) if value >= 1 << 63 else value


def within(r: Range) -> Column:
    inside = F.lit(True)
    for end in {*range(64, r.bits, 64), r.bits}:
        bits = end - (end - 1) // 64 * 64 if end else 0
        inside = inside & (leading(end) == F.lit(signed((r.prefix >> (r.bits - end)) & ((1 << bits) - 1))))
    return inside


def splitters(narrow: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """shards - 1 boundaries, a number for each of WORDS: a row belongs to the shard whose number is the boundaries at or below it."""
    total = narrow.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    found: dict[int, int] = {}
    open_ = [Range(0, 0, 0, total, [(s, total * s / shards) for s in range(1, shards)])]
    while open_ and total:
        bits = open_[0].bits
        step = min(BITS, 64 - bits % 64)
        place = F.lit(None).cast("int")
        for k, r in enumerate(open_):
            place = F.when(within(r), F.lit(k)).otherwise(place)
        fine = bits + step
        counts = narrow.withColumn("_range", place).where("_range is not null").groupBy("_range", leading(fine).alias("_part")).agg(F.sum("size").alias("size")).collect()
        before = bits // 64 * 64
        mask = (1 << (fine - before)) - 1
        nexts = []
        for k, r in enumerate(open_):
            parts = sorted(((c._part & mask), c["size"]) for c in counts if c._range == k)
            high = (r.prefix >> (bits - before)) << (fine - before)
            made, below = [], r.below
            for part, size in parts:
                made.append(Range(high | part, fine, below, size))
                below += size
            for s, target in r.targets:
                inside = next((m for m in made if m.below <= target < m.below + m.size), made[-1])
                low, up = target - inside.below, inside.below + inside.size - target
                if min(low, up) <= slack or fine == WIDTH:
                    found[s] = (inside.prefix + (up < low)) << (WIDTH - fine)
                else:
                    inside.targets.append((s, target))
            nexts += [m for m in made if m.targets]
        open_ = nexts
    top = (1 << WIDTH) - 1
    cut = [min(found[s], top) for s in sorted(found)]
    return [tuple((c >> end & ((1 << 64) - 1)) - (1 << 63) for end in range(WIDTH - 64, -1, -64)) for c in cut]


def shard_of(cuts: list[tuple[int, ...]]) -> Column:
    shard = F.lit(0)
    for h, i, r in cuts:
        same_text = (F.col("_id") > i) | ((F.col("_id") == i) & (F.col("_row") >= r))
        shard = shard + ((F.col("_hash") > h) | ((F.col("_hash") == h) & same_text)).cast("int")
    return shard


def with_slots(placed: DataFrame, rows: int, shards: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Numbers each shard's rows from 0 without gaps: by slice, then in the order of the sort."""
    slices = max(1, -(-rows // (shards * slice_rows)))
    cut = placed.withColumn("_slice", F.pmod(F.xxhash64("_id", "_row"), F.lit(slices)).cast("int"))
    counts = cut.groupBy("shard", "_slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("_s"), F.col("_slice").alias("_l"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("shard", "_slice").orderBy(*WORDS)
    numbered = cut.withColumn("_row", F.row_number().over(own).cast("long") - 1)
    return numbered.join(starts, (F.col("shard") == F.col("_s")) & (F.col("_slice") == F.col("_l"))).withColumn("slot", F.col("_start") + F.col("_row")).drop("_s", "_l", "_start", "_row", "_slice")


def apply(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    narrow = keep(with_order(docs).select("doc_id", row_bytes().alias("size"), row_crc().alias("text_crc32"), *WORDS))
    placed = narrow.withColumn("shard", shard_of(splitters(narrow, shards)).cast("int"))
    out = with_slots(placed, narrow.count(), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
