"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, id, place in the written table), so equal texts stand together and even repeated
rows can be cut apart.  A size-weighted Poisson sample of the keys gives quantile boundaries; records are range-partitioned
by them, ranges that turn out overfull are subdivided by a denser sample of their own keys, and the exact bytes of every
range then place each record at its global byte offset.  There are at most ``MOST_RANGES`` ranges, so the sample on the
driver and the offsets sent to the tasks are bounded however many records there are.
A shard is one fortieth (1/``shards``) of that byte line, so shards differ by one record's size at most, however the
sample fell; a hot text is cut between its ids.

Defined results: a null text counts as empty (size ``overhead``); a null id sorts first; rows equal in text and id take
neighbouring slots in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.session import ship_package

from .common import staged

ROWS_PER_RANGE, SAMPLES_PER_RANGE, LEAST_RANGES, MOST_RANGES = 100_000, 16, 256, 16_384
KEY = ("h", "i", "u")


def _range_of(bounds: list[tuple[int, int, int]]):
    """A column function: the number of boundaries at or below a key; the boundaries are bounded by the number of ranges."""
    heads = np.array([b[0] for b in bounds], dtype=np.int64)

    @F.pandas_udf("long")
    def which(h: pd.Series, i: pd.Series, u: pd.Series) -> pd.Series:
        hv = h.to_numpy()
        low, high = np.searchsorted(heads, hv, "left"), np.searchsorted(heads, hv, "right")
        tied = np.flatnonzero(low < high)
        if len(tied):
            iv, uv = i.to_numpy(), u.to_numpy()
            low[tied] = [bisect_right(bounds, (int(hv[k]), int(iv[k]), int(uv[k]))) for k in tied]
        return pd.Series(low)

    return which


def _sample(rows: DataFrame, per_byte: float) -> list[tuple[int, int, int]]:
    """Keys drawn with probability 1 - exp(-size * per_byte), by a hash of the key, so a retried task draws the same."""
    draw = (F.xxhash64(*KEY, F.lit("draw")).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
    return sorted(tuple(r) for r in rows.where(-F.log(draw) < F.col("size") * F.lit(per_byte)).select(*KEY).collect())


def shard_by_bytes(docs: DataFrame, *, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for every record; the law is ``bytes``."""
    ship_package(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("i"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
    )
    rows = staged(rows, "shard-rows")
    rows = rows.withColumn("u", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = min(MOST_RANGES, max(LEAST_RANGES, -(-count // ROWS_PER_RANGE)))
    drawn = _sample(rows, SAMPLES_PER_RANGE * n / max(total, 1))
    bounds = sorted({drawn[len(drawn) * k // n] for k in range(1, n)}) if drawn else []
    for _ in range(4):
        ranged = rows.withColumn("range", _range_of(bounds)(*KEY))
        sums = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.sum("size"), F.count("*")).collect())
        over = [r for r, size, k in sums if size > 3 * max(total, 1) / n and k > 1]
        if not over:
            break
        more = _sample(ranged.where(F.col("range").isin(over)), 4 * SAMPLES_PER_RANGE * n / max(total, 1))
        fresh = sorted({more[k] for k in range(0, len(more), SAMPLES_PER_RANGE)} - set(bounds))
        if not fresh:
            break
        bounds = sorted(set(bounds) | set(fresh))
    # offsets of the ranges: as many rows as ranges
    ats, byte_at, row_at = [], 0, 0
    for r, size, k in sums:
        ats.append((r, byte_at, row_at))
        byte_at, row_at = byte_at + size, row_at + k
    spark = docs.sparkSession
    offsets = spark.createDataFrame(pd.DataFrame(ats or [(0, 0, 0)], columns=["range", "byte_at", "row_at"]).astype("int64"))
    order = Window.partitionBy("range").orderBy(*KEY)
    placed = (
        ranged.join(F.broadcast(offsets), "range")
        .withColumn("at", F.col("byte_at") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rank", F.col("row_at") + F.row_number().over(order) - 1)
        .withColumn("shard", F.expr(f"cast(at * {shards} div {max(total, 1)} as int)"))
        .select(key, "size", "text_crc32", "shard", "rank")
    )
    placed = staged(placed, "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # as many rows as shards
    return placed.join(F.broadcast(firsts), "shard").select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
