"""Semi-join on a key list too large to broadcast, with a filter of its keys applied before the shuffle.

The filter is a blocked Bloom filter made of Spark's bitmap aggregates: a key's hash
picks one block of BITS bits and PROBES bits in it. Its size is known from the
number of keys (one row of 4 KB a block), so it is broadcast only up to a stated
size; a row that is not in it cannot match and never reaches the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32768  # bits of a bitmap of Spark's bitmap functions
PROBES, KEYS_A_BLOCK = 6, 3000
MOST_BYTES = 256 << 20


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """PROBES places 0..BITS-1: 15 bits each of two further hashes."""
    return F.array(*[F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(17 + k // 3), key), 15 * (k % 3)), F.lit(BITS)).cast("int") for k in range(PROBES)])


def key_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bits): the filter of the distinct keys."""
    k = keys.select(_block(F.col(key), blocks).alias("block"), F.explode(_bits(F.col(key))).alias("bit"))
    return k.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def filtered_semi_join(df: DataFrame, keys: DataFrame, key: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``keys``; null keys match nothing."""
    blocks = max(1, -(-keys.count() // KEYS_A_BLOCK))
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    if blocks * BITS // 8 <= most_bytes:
        bits = F.broadcast(key_filter(wanted, key, blocks))  # blocks x 4 KB, checked above
        at = df.withColumn("_block", _block(F.col(key), blocks)).join(bits.withColumnRenamed("block", "_block"), "_block")
        df = at.where(F.forall(_bits(F.col(key)), lambda b: _is_set(F.col("bits"), b))).select(*df.columns)
    return df.join(wanted, key, "left_semi")
