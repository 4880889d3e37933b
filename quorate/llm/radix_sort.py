"""A distributed LSD radix sort: stable counting-sort passes over the digits of a composite key.

Rows lie in blocks of consecutive places. A pass counts each block's digits, finds by prefix sums over (digit, block) where
each block's rows of a digit go, and moves each row to the place after those of the same digit that stand before it. After the
pass over the most significant digit a row's place is its rank. No pass needs an order of all rows, and no task more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import Workspace, fresh

#: Bits of a digit and rows of a block: the counts of all blocks are an eighth of the rows at most.
DIGIT_BITS, BLOCK_BITS = 10, 13
#: 2 to the power 63: numbers that span more than this are taken by their bits, the sign turned.
_HALF = 1 << 63


def pieces(rows: DataFrame, keys: list[tuple[str, bool]]) -> list[tuple[Column, int]]:
    """(unsigned number, its bits) of each part of the composite key, the least significant first; keys are (long column, descending).

    Nulls stand last in either direction. Bits that no two rows differ in are left out.
    """
    aggs = [f for c, _ in keys for f in (F.min(c), F.max(c), F.count_if(F.col(c).isNull()))]
    found, out = rows.agg(*aggs).first(), []
    for i, (c, down) in reversed(list(enumerate(keys))):
        least, most, nulls = found[3 * i : 3 * i + 3]
        if least is not None:
            if most - least < _HALF:
                u, bits = (F.lit(most) - F.col(c) if down else F.col(c) - F.lit(least)), (most - least).bit_length()
            else:
                u, bits = F.col(c).bitwiseXOR(F.lit(_HALF - 1 if down else -_HALF)), 64
            out.append((F.coalesce(u, F.lit(0).cast("long")), bits))
        out.append((F.col(c).isNull().cast("long"), 1 if nulls else 0))
    return [part for part in out if part[1]]


def digits(parts: list[tuple[Column, int]], bits: int = DIGIT_BITS) -> list[Column]:
    """The composite key's digits, the least significant first."""
    out, total = [], sum(n for _, n in parts)
    for low in range(0, total, bits):
        digit, start = F.lit(0).cast("long"), 0
        for u, n in parts:
            a, b = max(low, start), min(low + bits, start + n)
            if a < b:
                piece = F.shiftrightunsigned(u, a - start).bitwiseAND(F.lit((1 << (b - a)) - 1))
                digit += F.shiftleft(piece, a - low)
            start += n
        out.append(digit.cast("int"))
    return out


def ranked(rows: DataFrame, keys: list[tuple[str, bool]], ws: Workspace, rank: str = "rank", name: str = "radix", bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows with their rank from 1 by the keys, (long column, descending) from the most significant on.

    Nulls stand last. Rows that are equal in all keys stand in an order of no meaning. An empty table gives one. Rows go
    through a shuffle a digit, so give those columns only that are needed with the rank.
    """
    place, block, digit, local, before, start, n = fresh("place", "block", "digit", "local", "before", "start", "n")
    held = rows.drop(rank)
    now = ws.save(held.withColumn(place, F.monotonically_increasing_id()), f"{name}-0")
    passes = digits(pieces(now, keys), bits) or [F.lit(0)]  # all keys equal: any order, but gapless places
    for k, d in enumerate(passes):
        cut = now.withColumn(digit, d).withColumn(block, F.shiftright(place, block_bits))
        counts = cut.groupBy(digit, block).agg(F.count("*").alias(n))
        earlier = Window.partitionBy(digit).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        lower = Window.orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as a digit has values
        starts = counts.groupBy(digit).agg(F.sum(n).alias(n)).select(F.col(digit).alias(f"{digit}s"), F.coalesce(F.sum(n).over(lower), F.lit(0)).alias(start))
        offsets = counts.select(F.col(digit).alias(f"{digit}o"), F.col(block).alias(f"{block}o"), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
        offsets = offsets.join(F.broadcast(starts), F.col(f"{digit}o") == F.col(f"{digit}s"))
        own = F.row_number().over(Window.partitionBy(block, digit).orderBy(place)) - 1
        moved = cut.withColumn(local, own).join(offsets, (F.col(block) == F.col(f"{block}o")) & (F.col(digit) == F.col(f"{digit}o")))
        now = ws.save(moved.select(*held.columns, (F.col(start) + F.col(before) + F.col(local)).alias(place)), f"{name}-{k + 1}")
        ws.drop(f"{name}-{k}")
    return now.select(*held.columns, (F.col(place) + 1).alias(rank))
