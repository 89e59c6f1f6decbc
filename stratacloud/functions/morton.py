"""Progressive spatial order: Morton codes and the centred bit-reversal permutation, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.geometry import finite

AXIS_BITS = 10
STEPS = (1 << AXIS_BITS) - 1


def quantize(v: Column, low: Column, high: Column) -> Column:
    """10 bits of a coordinate between its limits: the middle if it isn't finite, 0 on a flat axis."""
    flat = low.isNull() | (high <= low)
    step = F.floor((v - low) / (high - low) * STEPS + 0.5)
    return F.when(~finite(v), 512).when(flat, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(STEPS), step))).cast("bigint")


def spread(q: Column) -> Column:
    """Every bit three places apart."""
    out = F.lit(0).cast("bigint")
    for i in range(AXIS_BITS):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(q, i).bitwiseAND(F.lit(1)), 3 * i))
    return out


def morton(qx: Column, qy: Column, qz: Column) -> Column:
    return spread(qx).bitwiseOR(F.shiftleft(spread(qy), 1)).bitwiseOR(F.shiftleft(spread(qz), 2))


def bit_width(n: Column) -> Column:
    """ceil(log2 n) for whole n >= 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def reverse_bits(v: Column, bits: Column) -> Column:
    return F.when(bits <= 0, F.lit(0)).otherwise(F.conv(F.reverse(F.lpad(F.bin(v), bits, F.lit("0"))), 2, 10).cast("bigint"))


def progressive_key(rank: Column, n: Column) -> Column:
    """Place of Morton rank ``rank`` of n in the order whose every prefix is spread evenly."""
    b = bit_width(n)
    half = F.when(b > 0, F.pow(F.lit(2.0), b - 1).cast("bigint")).otherwise(F.lit(0))
    return reverse_bits(rank.cast("bigint").bitwiseXOR(half), b)


def progressive_order(points: DataFrame, group: str, index: str, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Adds ``morton``, ``prog_key`` and ``prog_rank`` (from 0) per group. Groups are nodes: bounded by construction."""
    whole = Window.partitionBy(group)
    safe = lambda a: F.when(finite(F.col(a)), F.col(a))
    q = [quantize(F.col(a), F.min(safe(a)).over(whole), F.max(safe(a)).over(whole)) for a in axes]
    out = points.withColumn("morton", morton(*q))
    rank = F.row_number().over(whole.orderBy("morton", index)) - 1
    out = out.withColumn("prog_key", progressive_key(rank, F.count(F.lit(1)).over(whole)))
    return out.withColumn("prog_rank", F.row_number().over(whole.orderBy("prog_key")) - 1)
