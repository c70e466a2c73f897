"""A blocked Bloom filter in plain expressions: one 64-bit block for a key, two of its bits set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A filter has at most so many blocks (8 bytes each, a quarter of a MB in every task that asks it); more keys than fit well only let more through to the exact join.
MAX_BLOCKS = 32_768
#: Where in a hash the places of its two bits are.
SHIFTS = (24, 32)


class BlockedBloom:
    """Built from a column of 64-bit hashes; of bounded size.

    The filter is one stored row that plans refer to, so that it stands in no plan itself. Spark doesn't allow that inside
    higher-order functions; for these, ``inside`` puts it into the plan.
    """

    def __init__(self, hashes: DataFrame, column: str, n_keys: int, inside: bool = False) -> None:
        blocks = 64
        while blocks < MAX_BLOCKS and blocks < n_keys:  # 64 bits for a key: two set bits let one in some thousand others pass
            blocks *= 2
        self.blocks = blocks
        keys = hashes.select(self._block(F.col(column)).alias("block"), self._mask(column).alias("mask"))
        if inside:
            bits = [0] * blocks
            for r in keys.groupBy("block").agg(F.bit_or("mask").alias("bits")).collect():
                bits[r["block"]] = r["bits"]
            self.bits = F.from_json(F.lit("[" + ",".join(map(str, bits)) + "]"), "array<bigint>")
        else:
            none = hashes.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("bigint").alias("mask"))
            all_ = keys.unionByName(none).groupBy("block").agg(F.bit_or("mask").alias("bits"))
            row = all_.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "bits"))), lambda x: x["bits"]).alias("bits"))
            self.bits = saved(row, "bloom").scalar()

    def _block(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.blocks)).cast("int")

    @staticmethod
    def _mask(column: str) -> Column:
        return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {s}) & 63 as int))" for s in SHIFTS))

    def _bit(self, h: Column, shift: int) -> Column:
        place = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)

    def may_hold(self, h: Column) -> Column:
        """Whether the hash may be among the keys: always true for a key."""
        block = F.get(self.bits, self._block(h))
        mask = self._bit(h, SHIFTS[0]).bitwiseOR(self._bit(h, SHIFTS[1]))
        return block.bitwiseAND(mask) == mask
