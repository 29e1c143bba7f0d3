"""As-of, containment, proximity and lookup joins.

Time joins are equi-joins on a bucket of the time axis: a point goes to one bucket, an interval to all it touches, so the
shuffle key is (group, bucket) and a busy group is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_join(points: DataFrame, spans: DataFrame, *, keys: list[str], at: str, low: Column, high: Column, width: int) -> DataFrame:
    """Pairs with equal ``keys`` and low <= at <= high, borders included; other column names must differ."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    s = spans.withColumn("__low", low).withColumn("__high", high).where("__low <= __high").withColumn("__b", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))))
    return p.join(s, [*keys, "__b"]).where(F.col(at).between(F.col("__low"), F.col("__high"))).drop("__b", "__low", "__high")


def nearest(pairs: DataFrame, *, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group under ``order``."""
    return pairs.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")


def asof(left: DataFrame, right: DataFrame, *, keys: list[str], left_id: str, at: str, right_at: str, right_order: str, tolerance: int) -> DataFrame:
    """The row of ``right`` nearest in time within ``tolerance``; of equally near ones the later in order."""
    pairs = range_join(right, left, keys=keys, at=right_at, low=F.col(at) - tolerance, high=F.col(at) + tolerance, width=max(1, 2 * tolerance))
    return nearest(pairs, by=[left_id], order=[F.abs(F.col(right_at) - F.col(at)), F.desc(right_order)])


def containing(points: DataFrame, spans: DataFrame, *, keys: list[str], point_id: str, at: str, low: str, high: str, order: str, width: int) -> DataFrame:
    """The first span, in list order, that contains each point."""
    return nearest(range_join(points, spans, keys=keys, at=at, low=F.col(low), high=F.col(high), width=width), by=[point_id], order=[F.col(order)])


def containing_or_any(points: DataFrame, spans: DataFrame, *, keys: list[str], point_id: str, at: str, low: str, high: str, slack: int, gap: Column, order: list[Column]) -> DataFrame:
    """The best span around each point within ``slack``, or of all spans of the group if none is; ``degraded`` says which.

    ``order`` ranks the spans of the pool after the time gap.  Points meet the spans around them by time buckets; only the
    points without any go to the nearest spans of their group: those before the point that end last and those after it that
    start first have the smallest gaps, so the search widens bucket by bucket and not over all spans.
    """
    width = max(1, 2 * slack + 1)
    inside = range_join(points, spans, keys=keys, at=at, low=F.col(low) - slack, high=F.col(high) + slack, width=max(width, 64))
    best = nearest(inside.withColumn("gap", gap), by=[point_id], order=[F.col("gap"), *order]).withColumn("degraded", F.lit(False))
    alone = points.join(inside.select(point_id).distinct(), point_id, "left_anti")
    # of the spans outside, the gap is that to the last end before or to the first start after the point
    none = F.lit(None).cast("long")
    marks = alone.select(*keys, F.col(at).cast("long").alias("__t"), F.col(point_id), none.alias("__edge"))
    edges = lambda c: marks.unionByName(spans.select(*keys, F.col(c).cast("long").alias("__t"), F.lit(None).cast(dict(points.dtypes)[point_id]).alias(point_id), F.col(c).cast("long").alias("__edge")))
    over = lambda c: Window.partitionBy(*keys).orderBy(c).rangeBetween(Window.unboundedPreceding, -1)
    past = edges(high).withColumn("__past", F.max("__edge").over(over(F.col("__t")))).where(F.col(point_id).isNotNull()).select(point_id, "__past")
    next_ = edges(low).withColumn("__next", F.min("__edge").over(over(-F.col("__t")))).where(F.col(point_id).isNotNull()).select(point_id, "__next")
    t = F.col(at)
    far = alone.join(past, point_id).join(next_, point_id).withColumn("__gap", F.least(t - F.col("__past"), F.col("__next") - t)).where("__gap IS NOT NULL").drop("__past", "__next")
    before = far.withColumn("__edge", t - F.col("__gap")).join(spans.withColumn("__edge", F.col(high)), [*keys, "__edge"])
    after = far.withColumn("__edge", t + F.col("__gap")).join(spans.withColumn("__edge", F.col(low)), [*keys, "__edge"])
    pool = before.unionByName(after).drop("__edge", "__gap").distinct()
    return best.unionByName(nearest(pool.withColumn("gap", gap), by=[point_id], order=[F.col("gap"), *order]).withColumn("degraded", F.lit(True)))


def within(left: DataFrame, right: DataFrame, *, keys: list[str], at: tuple[str, str], right_at: tuple[str, str], reach: float, name: str = "dist") -> DataFrame:
    """Pairs with equal ``keys`` whose places lie at most ``reach`` apart: an equi-join on a grid, a row of ``left`` asks nine cells."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = left.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    asked = asked.withColumns({"__gx": cell(at[0]) + F.col("__dx"), "__gy": cell(at[1]) + F.col("__dy")}).drop("__dx", "__dy")
    there = right.withColumns({"__gx": cell(right_at[0]), "__gy": cell(right_at[1])})
    dx, dy = F.col(at[0]) - F.col(right_at[0]), F.col(at[1]) - F.col(right_at[1])
    pairs = asked.join(there, [*keys, "__gx", "__gy"]).withColumn(name, F.sqrt((dx * dx + dy * dy).cast("double")))
    return pairs.where(F.col(name) <= reach).drop("__gx", "__gy")


def one_letter_apart(names: DataFrame, column: str) -> DataFrame:
    """(a, b), a < b, of distinct names within one insertion, deletion or change.

    Two such names share a variant: the name itself or the name without one of its letters; variants meet by equality and
    the distance is verified.
    """
    distinct = names.select(F.col(column).alias("a")).distinct()
    gone = F.transform(F.sequence(F.lit(1), F.length("a")), lambda k: F.concat(F.substring("a", F.lit(1), k - 1), F.substring("a", k + 1, F.length("a"))))
    variants = distinct.select("a", F.explode(F.array_distinct(F.concat(F.array("a"), F.when(F.length("a") > 0, gone).otherwise(F.array().cast("array<string>"))))).alias("v"))
    pairs = variants.join(variants.select(F.col("a").alias("b"), "v"), "v").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b", 1).between(0, 1))


def rejoin_pairs(det: DataFrame, *, keys: list[str], low: int, high: int, reach: float, void: float, least_conf: float, before: int, before_reach: float, after: int, after_reach: float) -> DataFrame:
    """Detections that vanish and come back: (a, b) with b ``low`` to ``high`` frames after a.

    a must have a predecessor (``before`` frames, ``before_reach`` pixels), b a follower, and no row between them in
    order may lie within ``void`` of a; each a takes its first such b.  Order is by frame, then detection.
    """
    w = Window.partitionBy(*keys).orderBy("frame", "det")
    rows = det.select(*keys, "frame", "det", "cx", "cy", "conf", F.row_number().over(w).cast("long").alias("ord"))
    tagged = lambda t: rows.select(*keys, *[F.col(c).alias(f"{t}_{c}") for c in ("frame", "det", "cx", "cy", "conf", "ord")])
    d = lambda p, q: F.sqrt(((F.col(f"{p}_cx") - F.col(f"{q}_cx")) * (F.col(f"{p}_cx") - F.col(f"{q}_cx")) + (F.col(f"{p}_cy") - F.col(f"{q}_cy")) * (F.col(f"{p}_cy") - F.col(f"{q}_cy"))).cast("double"))
    near = lambda left, t, at, lo, hi: range_join(tagged(t), left, keys=keys, at=f"{t}_frame", low=F.col(at) + lo, high=F.col(at) + hi, width=max(1, high))
    a = tagged("a")
    seeds = near(a, "p", "a_frame", -before, 0).where(F.col("p_ord") < F.col("a_ord")).where(d("p", "a") <= before_reach).select(*keys, "a_ord").distinct()
    pairs = near(a.join(seeds, [*keys, "a_ord"], "left_semi"), "b", "a_frame", low, high).where(F.col("b_conf") >= least_conf).where(d("a", "b") <= reach)
    followed = near(pairs, "c", "b_frame", 0, after).where(F.col("c_ord") > F.col("b_ord")).where(d("b", "c") <= after_reach).select(*keys, "a_ord", "b_ord").distinct()
    pairs = pairs.join(followed, [*keys, "a_ord", "b_ord"], "left_semi")
    filled = near(pairs, "m", "a_frame", 0, high).where((F.col("m_ord") > F.col("a_ord")) & (F.col("m_ord") < F.col("b_ord"))).where(d("a", "m") < void).select(*keys, "a_ord", "b_ord").distinct()
    pairs = pairs.join(filled, [*keys, "a_ord", "b_ord"], "left_anti")
    return nearest(pairs, by=[*keys, "a_ord"], order=[F.col("b_ord")])


def boosted(scored: DataFrame, anchors: DataFrame, *, keys: list[str], row_id: str, at: str, anchor_id: str, anchor_at: str, window: int, factor: float, order: list[Column]) -> DataFrame:
    """Scores within ``window`` of any anchor times ``factor``, once; each anchor's best boosted row is ``forced``."""
    pairs = range_join(scored, anchors, keys=keys, at=at, low=F.col(anchor_at) - window, high=F.col(anchor_at) + window, width=max(1, 2 * window))
    hit = pairs.select(row_id).distinct().withColumn("__hit", F.lit(True))
    best = nearest(pairs, by=[anchor_id], order=order).select(row_id).distinct().withColumn("forced", F.lit(True))
    out = scored.join(hit, row_id, "left").join(best, row_id, "left")
    return out.withColumn("score", F.when(F.col("__hit"), F.col("score") * factor).otherwise(F.col("score"))).withColumn("forced", F.coalesce("forced", F.lit(False))).drop("__hit")


def best_match(pairs: DataFrame, *, by: list[str], score: Column, least: float, order: list[Column]) -> DataFrame:
    """The pair with the highest score of at least ``least``; ``order`` breaks ties."""
    scored = pairs.withColumn("score", score).where(F.col("score") >= least)
    return nearest(scored, by=by, order=[F.desc("score"), *order])


def coverage_split(expected: DataFrame, found: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Expected keys without rows: ``zero`` where a valid source exists, else ``missing``."""
    absent = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")
    return absent.join(valid.select(key).distinct().withColumn("__ok", F.lit(True)), key, "left").select(key, F.when(F.col("__ok"), "zero").otherwise("missing").alias("verdict"))


def fact_diff(old: DataFrame, new: DataFrame, *, key: str, columns: list[str]) -> DataFrame:
    """(key, change) of rows added, removed or changed in any of ``columns``."""
    o = old.select(key, F.struct(*columns).alias("__old"))
    n = new.select(key, F.struct(*columns).alias("__new"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def verdicts(items: DataFrame, answers: DataFrame, *, item: str, prefix: str, key: str, answer: str, separator: str = "@") -> DataFrame:
    """Y if any answer of the item's prefix is YES, else ? if any is UNCLEAR, else N if any is NO, else blank.

    A prefix is what stands before the separator and the separator, so keys are cut there and joined by equality.
    """
    said_of = answers.select(F.concat(F.substring_index(key, separator, 1), F.lit(separator)).alias(prefix), F.col(answer).alias("__answer"))
    said = lambda x: F.coalesce(F.bool_or(F.col("__answer") == x), F.lit(False))
    return items.join(said_of, prefix, "left").groupBy(item).agg(F.when(said("YES"), "Y").when(said("UNCLEAR"), "?").when(said("NO"), "N").otherwise("").alias("verdict"))
