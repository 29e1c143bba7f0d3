"""Windows over ordered rows: static runs, stable segments, overlap groups, gaps, offsets, chunks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.session import staged


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows within ``keys`` from 1; a row where ``starts`` holds opens a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__new", F.coalesce(starts, F.lit(True)).cast("long")).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def static_segments(det: DataFrame, *, track: list[str], size: int = 4, max_move: int = 40, merge_gap: int = 4) -> DataFrame:
    """Stretches in which ``size`` consecutive detections stay within ``max_move`` pixels on both axes (strictly).

    ``det`` has (track..., frame, det, cx, cy, conf).  Starts of such windows at most ``merge_gap`` positions apart
    join; gives (track..., seg, first_pos, last_pos).
    """
    order = Window.partitionBy(*track).orderBy("frame", "det")
    ahead = order.rowsBetween(0, size - 1)
    spread = lambda c: F.max(c).over(ahead) - F.min(c).over(ahead)
    flagged = det.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).withColumn("full", F.count("*").over(ahead) == size).withColumn("still", (spread("cx") < max_move) & (spread("cy") < max_move))
    starts = flagged.where("full AND still").select(*track, "pos")
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy(*track).orderBy("pos"))
    runs = islands(starts, track, ["pos"], gap > merge_gap, "seg")
    return runs.groupBy(*track, "seg").agg(F.min("pos").alias("first_pos"), (F.max("pos") + size - 1).alias("last_pos"))


def static_candidates(det: DataFrame, *, track: list[str], size: int = 4, max_move: int = 40, merge_gap: int = 4, dead_ds: int = 30) -> DataFrame:
    """Candidates of static segments no longer than ``dead_ds`` deciseconds: start, duration, mean place and confidence."""
    order = Window.partitionBy(*track).orderBy("frame", "det")
    placed = det.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    segs = static_segments(det, track=track, size=size, max_move=max_move, merge_gap=merge_gap)
    members = placed.join(segs, track).where("pos BETWEEN first_pos AND last_pos")
    out = members.groupBy(*track, "seg").agg(
        (F.min("frame") * 2).alias("t0_ds"),
        ((F.max("frame") - F.min("frame")) * 2).alias("dur_ds"),
        F.floor(F.sum("cx") / F.count("*")).alias("cx"),
        F.floor(F.sum("cy") / F.count("*")).alias("cy"),
        F.avg("conf").alias("ac"),
        F.count("*").alias("n"),
    )
    return out.where(F.col("dur_ds") <= dead_ds)


def stable_segments(det: DataFrame, *, keys: list[str], max_gap: int = 2, max_step: float = 60.0, least: int = 2) -> DataFrame:
    """Runs of detections without a frame gap over ``max_gap`` or a step over ``max_step``; shorter than ``least`` drop out."""
    w = Window.partitionBy(*keys).orderBy("frame", "det")
    dx, dy = F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)
    breaks = (F.col("frame") - F.lag("frame").over(w) > max_gap) | (F.sqrt((dx * dx + dy * dy).cast("double")) > max_step)
    runs = islands(det, keys, ["frame", "det"], breaks, "seg")
    return runs.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "seg"))).where(F.col("n") >= least)


def frame_best(det: DataFrame, *, keys: list[str], least_conf: float | None = None) -> DataFrame:
    """The most confident detection of each group, the first on ties; under ``least_conf`` the group has none."""
    w = Window.partitionBy(*keys).orderBy(F.desc("conf"), "det")
    best = det.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return best if least_conf is None else best.where(F.col("conf") >= least_conf)


def overlap_groups(events: DataFrame, *, keys: list[str], start: Column, end: Column, order: list[str]) -> DataFrame:
    """Groups of events whose windows touch or overlap, two members at least; (…, grp, members)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = islands(events.withColumn("__start", start).withColumn("__end", end), keys, order, F.col("__start") > reach, "grp")
    return rows.withColumn("members", F.count("*").over(Window.partitionBy(*keys, "grp"))).where("members > 1").drop("__start", "__end")


def fill_gaps(track: DataFrame, *, keys: list[str], most: int = 3) -> DataFrame:
    """Detections plus linear points for gaps of 1 to ``most`` missing frames, rounded half to even; src is det or interp."""
    w = Window.partitionBy(*keys).orderBy("frame")
    ahead = track.select(*keys, "frame", "cx", "cy", F.lead("frame").over(w).alias("f2"), F.lead("cx").over(w).alias("x2"), F.lead("cy").over(w).alias("y2"))
    gaps = ahead.where(F.col("f2") - F.col("frame") - 1 <= most).where("f2 - frame > 1")
    between = gaps.withColumn("f", F.explode(F.sequence(F.col("frame") + 1, F.col("f2") - 1)))
    share = (F.col("f") - F.col("frame")) / (F.col("f2") - F.col("frame"))
    at = lambda a, b: F.bround(F.col(a) + (F.col(b) - F.col(a)) * share).cast("long")
    made = between.select(*keys, F.col("f").alias("frame"), at("cx", "x2").alias("cx"), at("cy", "y2").alias("cy"), F.lit("interp").alias("src"))
    return track.select(*keys, "frame", "cx", "cy", F.lit("det").alias("src")).unionByName(made)


def running_offset(df: DataFrame, *, keys: list[str], order: list[str], value: str, name: str = "offset") -> DataFrame:
    """The sum of ``value`` over all earlier rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def chunks(df: DataFrame, *, keys: list[str], order: list[str], size: int, name: str = "batch") -> DataFrame:
    """Numbers batches of ``size`` rows from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, (F.floor((F.row_number().over(w) - 1) / size) + 1).cast("long"))


def even_sample(df: DataFrame, *, keys: list[str], order: list[str], n: int) -> DataFrame:
    """``n`` evenly spaced rows of each group with both ends, all if there are fewer; ``slot`` from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__i", (F.row_number().over(w) - 1).cast("long")).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    slots = F.when(F.col("__n") <= n, F.sequence(F.lit(0), F.col("__n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (n - 1)).cast("long")))
    picked = ranked.select(*keys, "__n").distinct().select(*keys, F.posexplode(slots).alias("slot", "__i"))
    return ranked.drop("__n").join(picked, [*keys, "__i"]).drop("__i")


def next_row(df: DataFrame, *, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lead(column).over(Window.partitionBy(*keys).orderBy(*order)))


def bucket_pick(scored: DataFrame, *, keys: list[str], bucket: Column, order: list[str], total: int, forced: Column) -> DataFrame:
    """All forced rows, the best other row of every bucket, then by score up to ``total`` rows of a group.

    ``order`` ranks rows, best first.  Guaranteed rows may exceed ``total``.
    """
    asc_desc = [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order]
    rows = scored.withColumn("__forced", forced).withColumn("__bucket", bucket)
    first = F.row_number().over(Window.partitionBy(*keys, "__bucket", "__forced").orderBy(*asc_desc)) == 1
    rows = rows.withColumn("__sure", F.col("__forced") | first)
    rows = rows.withColumn("__have", F.sum(F.col("__sure").cast("long")).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__sure").orderBy(*asc_desc)))
    return rows.where(F.col("__sure") | (F.col("__rank") <= F.lit(total) - F.col("__have"))).drop("__forced", "__bucket", "__sure", "__have", "__rank")


def ranks(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in the order of the whole table; ties stand in any order.

    No task sees more than a range of the rows: ranges are counted, and a row's place is its place within its range after
    the sizes of those before.
    """
    ranged = staged(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranks")
    sizes = sorted((r["__range"], r["n"]) for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect())  # as many as ranges
    before, starts = 0, []
    for r, n in sizes:
        starts += [F.lit(r), F.lit(before).cast("long")]
        before += n
    first = F.element_at(F.create_map(*starts), F.col("__range")) if starts else F.lit(0).cast("long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + first
    return ranged.withColumn(name, place).drop("__range")
