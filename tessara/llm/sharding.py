"""Placing documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = 8191, weights: dict[str, int] | None = None) -> list[int]:
    """The shard (its place in the list) of each slot.

    Each shard has a preference order of all slots, (offset + k * skip) mod size with a skip that the prime size can't
    share a factor with. Shards take turns; in its turn a shard claims the first slot of its order that is still free,
    as many in a row as its weight says. So shards get equal numbers of slots but for one, and when a shard goes, few
    slots besides its own change hands.
    """
    if not is_prime(size):
        raise ValueError(f"table size {size} is not prime")
    if not shards or len(shards) > size or len(set(shards)) != len(shards):
        raise ValueError("needs distinct shards, at least one and no more than slots")
    offsets = [_number(f"offset:{s}") % size for s in shards]
    skips = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    following, slots, left = [0] * len(shards), [-1] * size, size
    while left:
        for i, s in enumerate(shards):
            for _ in range((weights or {}).get(s, 1)):
                slot = (offsets[i] + following[i] * skips[i]) % size
                while slots[slot] >= 0:
                    following[i] += 1
                    slot = (offsets[i] + following[i] * skips[i]) % size
                slots[slot] = i
                following[i] += 1
                left -= 1
                if not left:
                    return slots
    return slots


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def place(docs: DataFrame, shards: list[str], size: int = 8191, weights: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `slot` and `shard` (long, the place of the shard in the list).

    The slot is the id's MD5 mod the table's size; a null id goes by its text (null: as empty), so that rows without id
    spread too. Rows with the same id share a shard. The table has `size` rows whatever the input, and is broadcast.
    Columns slot and shard that docs already has are replaced.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame([(slot, shard) for slot, shard in enumerate(lookup_table(shards, size, weights))], "slot long, shard long")
    key = F.coalesce(F.concat(F.lit("id:"), F.col(id_col).cast("string")), F.concat(F.lit("text:"), F.coalesce(F.col(text_col), F.lit(""))))
    slot = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") % size
    keyed = docs.withColumn("slot", slot)
    return keyed.drop("shard").join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes a folder for each shard. Rows go straight from their task to the shard's files, without a shuffle."""
    placed.write.partitionBy("shard").parquet(path)


def oracle(n_shards: int = 64, size: int = 8191) -> str:
    slots = ", ".join(map(str, lookup_table(shard_names(n_shards), size)))
    return f"""
WITH k AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce('id:' || CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 13) AS BIGINT) % {size} AS slot
  FROM documents)
SELECT doc_id, slot, CAST([{slots}][CAST(slot + 1 AS INT)] AS BIGINT) AS shard FROM k
"""
