"""Vector similarity, votes, propagation and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.session import ship_package


def mean_vector(vectors: DataFrame, *, by: list[str], vec: str = "vec") -> DataFrame:
    """The mean of each group's vectors, brought to unit length; (by..., vec).  Every element is an aggregate of its own, so
    partial sums and not elements are shuffled."""
    size = vectors.agg(F.max(F.size(vec))).first()[0] or 0
    means = vectors.groupBy(*by).agg(F.array(*[F.avg(F.get(F.col(vec), F.lit(k)).cast("double")) for k in range(size)]).cast("array<double>").alias("__m"))
    norm = F.sqrt(F.aggregate("__m", F.lit(0.0), lambda s, x: s + x * x))
    return means.withColumn("__n", norm).where("__n > 0").select(*by, F.transform("__m", lambda x: x / F.col("__n")).alias("vec"))


GALLERY_BLOCK, PROBE_BLOCK = 4096, 16_384


def max_similarity(probes: DataFrame, gallery: DataFrame, *, probe: str, label: str, vec: str = "vec", digits: int = 6) -> DataFrame:
    """(probe, label, score): the largest cosine of any probe vector with any gallery vector of the label.

    Vectors have unit length.  Both sides are dealt into blocks; each pair of blocks is one matrix product, of which only
    the best of each probe and label is kept and shuffled.
    """
    ship_package(probes.sparkSession)
    rows, cols = (max(1, -(-side.count() // size)) for side, size in ((probes, PROBE_BLOCK), (gallery, GALLERY_BLOCK)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = probes.select(F.col(probe).alias("__id"), F.col(vec).alias("__v"), block(probe, rows).alias("__p"), every(cols).alias("__g"))
    right = gallery.select(F.col(label).alias("__id"), F.col(vec).alias("__v"), every(rows).alias("__p"), block(vec, cols).alias("__g"))
    kinds = {name: dict(df.dtypes)[c] for name, df, c in (("probe", probes, probe), ("label", gallery, label))}

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"probe": a["__id"][:0], "label": b["__id"][:0], "s": np.empty(0)})
        b = b.sort_values("__id", kind="stable")
        names, first = np.unique(b["__id"].to_numpy(), return_index=True)
        ids, x, y = a["__id"].to_numpy(), np.stack(a["__v"].to_numpy()).astype(np.float64), np.stack(b["__v"].to_numpy()).astype(np.float64)
        best = np.concatenate([np.maximum.reduceat(x[at : at + 1024] @ y.T, first, axis=1) for at in range(0, len(x), 1024)])
        return pd.DataFrame({"probe": np.repeat(ids, len(names)), "label": np.tile(names, len(ids)), "s": best.ravel()})

    found = left.groupBy("__p", "__g").cogroup(right.groupBy("__p", "__g")).applyInPandas(multiply, f"probe {kinds['probe']}, label {kinds['label']}, s double")
    return found.groupBy(F.col("probe").alias(probe), F.col("label").alias(label)).agg(F.round(F.max("s"), digits).alias("score"))


def top_two(scores: DataFrame, *, by: str, label: str) -> DataFrame:
    """(by, winner, score, margin): no winner and margin 0 on an exact tie, an infinite margin without a second label."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), label)
    ranked = scores.withColumn("__k", F.row_number().over(w))
    first = ranked.where("__k <= 2").groupBy(by).agg(
        F.max(F.when(F.col("__k") == 1, F.col(label))).alias("__first"), F.max(F.when(F.col("__k") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("__k") == 2, F.col("score"))).alias("__second")
    )
    tie = F.coalesce(F.col("score") == F.col("__second"), F.lit(False))
    margin = F.when(F.col("__second").isNull(), F.lit(float("inf"))).otherwise(F.col("score") - F.col("__second"))
    return first.select(by, F.when(~tie, F.col("__first")).alias("winner"), "score", F.round(margin, 6).alias("margin"))


def adopted(top: DataFrame, *, threshold: float, margin: float | None = None) -> DataFrame:
    """Rows whose winner may be adopted."""
    out = top.where(F.col("winner").isNotNull() & (F.col("score") >= threshold))
    return out if margin is None else out.where(F.col("margin") >= margin)


def confusion(pairs: DataFrame, *, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n); a missing prediction is a column of its own."""
    return pairs.groupBy(truth, F.coalesce(F.col(predicted).cast("string"), F.lit("none")).alias(predicted)).agg(F.count("*").alias("n"))


def rates(pairs: DataFrame, *, positive: Column, adopted_: Column, right: Column) -> DataFrame:
    """Hit rate of positives, mis-hit rate of negatives, coverage and error among adopted; null without a denominator."""
    n = lambda c: F.count_if(c)
    share = lambda a, b: F.round(F.try_divide(n(a).cast("double"), n(b).cast("double")), 6)
    return pairs.agg(
        n(positive).alias("positives"), share(positive & adopted_ & right, positive).alias("hit_rate"), share(~positive & adopted_, ~positive).alias("mishit_rate"),
        share(adopted_, F.lit(True)).alias("coverage"), share(adopted_ & ~right, adopted_).alias("error_rate"), n(~adopted_).alias("burden"),
    )


def majority(rows: DataFrame, *, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; on ties the one seen first.  (by..., value, votes, total)"""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("votes"), F.min(order).alias("__first"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("total", F.sum("votes").over(w)).withColumn("__k", F.row_number().over(w.orderBy(F.desc("votes"), "__first")))
    return ranked.where("__k = 1").select(*by, value, "votes", "total")


def purity(groups: DataFrame) -> DataFrame:
    """Share of rows in their group's majority, from ``majority``'s result."""
    return groups.agg(F.sum("votes").alias("agreeing"), F.sum("total").alias("assigned"), F.round(F.try_divide(F.sum("votes").cast("double"), F.sum("total").cast("double")), 6).alias("purity"))


def rule_vote(guesses: DataFrame, *, by: list[str], value: str, high: Column, order: str) -> DataFrame:
    """(by..., number, sure): two equal guesses win (the number seen first among such); a single guess or the only
    confident one must be confident; otherwise null."""
    per = guesses.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"), F.min(order).alias("__first"), F.max(high.cast("int")).alias("__high"))
    rules = per.groupBy(*by).agg(
        F.min(F.when(F.col("__n") >= 2, F.struct("__first", "__v"))).alias("__twice"), F.sum("__high").alias("__sure"), F.min(F.when(F.col("__high") == 1, F.col("__v"))).alias("__only")
    )
    everyone = guesses.select(*by).distinct().join(rules, by, "left")
    number = F.when(F.col("__twice").isNotNull(), F.col("__twice.__v")).when(F.col("__sure") == 1, F.col("__only"))
    return everyone.select(*by, number.alias("number"), F.coalesce(F.col("__twice").isNotNull(), F.lit(False)).alias("agreed"))


def seeded_evaluation(members: DataFrame, *, track: list[str], order: str, label: str) -> DataFrame:
    """Of each track the earliest labelled member seeds the others: seeds, prefilled, correct, and conflicting tracks."""
    labelled = members.where(F.col(label).isNotNull())
    w = Window.partitionBy(*track)
    rows = labelled.withColumn("__k", F.row_number().over(w.orderBy(order))).withColumn("__seed", F.first(label).over(w.orderBy(order)))
    per = rows.groupBy(*track).agg(
        F.count("*").alias("n"), F.count_distinct(label).alias("labels"), F.count_if((F.col("__k") > 1) & (F.col(label) == F.col("__seed"))).alias("same")
    )
    return per.agg(F.count("*").alias("seeds"), F.sum(F.col("n") - 1).alias("prefilled"), F.sum("same").alias("correct"), F.count_if(F.col("labels") > 1).alias("conflicts"))


def propagate(members: DataFrame, *, track: list[str], key: str, label: str, mixed: Column) -> DataFrame:
    """(key, tag, state): what the other members of the track say: one tag fills, several conflict, none leaves blank.

    The others' tags follow from per-track counts, so no pair of members is formed.
    """
    per_tag = members.where(F.col(label).isNotNull()).groupBy(*track, label).agg(F.count("*").alias("n"))
    tags = per_tag.groupBy(*track).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("n")))).alias("__tags"))
    # a name of its own, lest the lambda take the output column of that name
    rows = members.withColumn("__mixed", mixed).withColumn("__own", F.col(label)).join(tags, track, "left")
    own = F.col("__own")
    others = F.map_filter(F.coalesce("__tags", F.create_map().cast("map<string,bigint>")), lambda t, n: ~((t == own) & (n == 1)) | own.isNull())
    names = F.array_sort(F.map_keys(others))
    state = F.when(F.col("__mixed"), "mixed").when(F.size(names) > 1, "conflict").when(F.size(names) == 1, "filled").otherwise("blank")
    return rows.select(key, F.when(~F.col("__mixed") & (F.size(names) == 1), names[0]).alias("tag"), state.alias("state"))


def representatives(members: DataFrame, *, cluster: str, score: str, order: str) -> DataFrame:
    """The best-scored member of each cluster; a missing score counts as 0, the first member wins ties."""
    w = Window.partitionBy(cluster).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), order)
    return members.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def unique_majority(rows: DataFrame, *, by: list[str], value: str) -> DataFrame:
    """The only most frequent value of each group, null on a tie (unlike ``majority``)."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    top = counts.withColumn("__top", F.max("n").over(Window.partitionBy(*by))).where("n = __top")
    return top.groupBy(*by).agg(F.when(F.count("*") == 1, F.max(value)).alias(value), F.max("n").alias("n"))
