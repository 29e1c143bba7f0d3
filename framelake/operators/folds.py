"""Order-dependent folds: event clusters with a span cap, greedy dedupe and spaced picks, as folds over sorted arrays.

Each fold runs inside an island of rows that can influence each other, so an array holds one island and not one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .segments import islands


def linked_to_previous(cands: DataFrame, *, keys: list[str], gap: int, chain: float, wide_gap: int, near: float) -> DataFrame:
    """``linked``: whether a candidate is close enough to the one before it, in time and in place.

    Where both have a hoop position (hx, hy) the distance is between hoops, otherwise between balls.
    """
    w = Window.partitionBy(*keys).orderBy("t0", "ord")
    prev = lambda c: F.lag(c).over(w)
    d = lambda x, y: F.sqrt(((F.col(x) - prev(x)) * (F.col(x) - prev(x)) + (F.col(y) - prev(y)) * (F.col(y) - prev(y))).cast("double"))
    rows = cands.withColumn("__gap", F.col("t0") - prev("t0")).withColumn("__d", F.coalesce(d("hx", "hy"), d("cx", "cy")))
    linked = ((F.col("__gap") <= gap) & (F.col("__d") <= chain)) | ((F.col("__gap") <= wide_gap) & (F.col("__d") <= near))
    return rows.withColumn("linked", F.coalesce(linked, F.lit(False))).drop("__gap", "__d")


def cluster_events(cands: DataFrame, *, keys: list[str], gap: int = 20, chain: float = 800.0, wide_gap: int = 60, near: float = 400.0, span: int | None = 200) -> DataFrame:
    """Numbers the event of every candidate (keys..., t0, ord, cx, cy, hx, hy); times in deciseconds.

    A link is between neighbours only, so islands come from a running sum; only the cap on an event's span needs a fold,
    which starts a new event within the island when the span would pass it.
    """
    rows = islands(linked_to_previous(cands, keys=keys, gap=gap, chain=chain, wide_gap=wide_gap, near=near), keys, ["t0", "ord"], ~F.col("linked"))
    if span is None:
        return rows.withColumn("event", F.col("island")).drop("linked", "island")
    packed = rows.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("t0", "ord"))).alias("xs"))
    first = packed.withColumn("cuts", F.aggregate("xs", F.array().cast("array<bigint>"), lambda s, x: F.when((F.size(s) == 0) | (x["t0"] - F.element_at(s, -1) > span), F.concat(s, F.array(x["t0"].cast("bigint")))).otherwise(s)))
    cuts = first.select(*keys, "island", "cuts")
    joined = rows.join(cuts, [*keys, "island"]).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("t0"))))
    return joined.withColumn("event", F.dense_rank().over(Window.partitionBy(*keys).orderBy("island", "part")).cast("long")).drop("linked", "island", "cuts", "part")


def merge_candidates(static: DataFrame, rejoin: DataFrame, *, keys: list[str], time: int = 15, reach: float = 200.0) -> DataFrame:
    """All static candidates and the rejoin candidates that are near none kept before them; (keys..., t0, cx, cy, src).

    A rejoin is first dropped if it is near a static one; among the rest, earlier kept ones drop later ones, by a fold
    over islands of rejoins that are close in time.
    """
    from .joins import range_join

    r = rejoin.withColumn("rid", F.monotonically_increasing_id()) if "rid" not in rejoin.columns else rejoin
    s = static.select(*keys, F.col("t0").alias("s_t0"), F.col("cx").alias("s_cx"), F.col("cy").alias("s_cy"))
    d = lambda x1, y1, x2, y2: F.sqrt(((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)).cast("double"))
    near = range_join(s, r, keys=keys, at="s_t0", low=F.col("t0") - time, high=F.col("t0") + time, width=max(1, 2 * time))
    near = near.where(d(F.col("cx"), F.col("cy"), F.col("s_cx"), F.col("s_cy")) <= reach).select("rid").distinct()
    left = r.join(near, "rid", "left_anti")
    w = Window.partitionBy(*keys).orderBy("t0", "rid")
    runs = islands(left, keys, ["t0", "rid"], F.col("t0") - F.lag("t0").over(w) > time)
    packed = runs.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("t0", "rid", "cx", "cy"))).alias("xs"))
    empty = F.array().cast("array<struct<t0:bigint,rid:bigint,cx:bigint,cy:bigint>>")
    one = lambda x: F.struct(*[x[c].cast("bigint").alias(c) for c in ("t0", "rid", "cx", "cy")])
    kept = F.aggregate("xs", empty, lambda acc, x: F.when(F.exists(acc, lambda k: (F.abs(k["t0"] - x["t0"]) <= time) & (d(k["cx"], k["cy"], x["cx"], x["cy"]) <= reach)), acc).otherwise(F.concat(acc, F.array(one(x)))))
    kept = packed.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.t0", "k.cx", "k.cy", F.lit("rejoin").alias("src"))
    return static.select(*keys, "t0", "cx", "cy", F.lit("static").alias("src")).unionByName(kept)


def pick_spaced(scored: DataFrame, *, keys: list[str], n: int, spacing: int, gate: Column) -> DataFrame:
    """The best ``n`` rows (frame, score) that pass the gate and lie ``spacing`` frames or more apart; best score first,
    earlier frame on ties."""
    rows = scored.where(gate)
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("frame").cast("bigint").alias("frame")))).alias("xs"))
    empty = F.array().cast("array<bigint>")
    picked = F.aggregate("xs", empty, lambda acc, x: F.when((F.size(acc) < n) & ~F.exists(acc, lambda f: F.abs(f - x["frame"]) < spacing), F.concat(acc, F.array(x["frame"]))).otherwise(acc))
    return packed.select(*keys, F.posexplode(picked).alias("rank", "frame"))


def drop_opposite(chain: DataFrame, *, keys: list[str], seed_frame: str, team: str, pairs: dict[str, str]) -> DataFrame:
    """Without the rows whose team is the opposite of the seed frame's."""
    seed = F.max(F.when(F.col("frame") == F.col(seed_frame), F.col(team))).over(Window.partitionBy(*keys))
    opposite = F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), F.col("__seed"))
    return chain.withColumn("__seed", seed).where(~F.coalesce(F.col(team) == F.when(F.col("__seed").isin(*pairs), opposite), F.lit(False))).drop("__seed")
