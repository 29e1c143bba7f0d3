"""Unions with a rule for rows that meet: last writer, conflict, priority, overlay; and the exports built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_writer(parts: list[DataFrame], *, key: list[str], order: str) -> DataFrame:
    """One row for each key: of the last part that has it, the last in order; ``position`` is that of the first appearance."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
    w = Window.partitionBy(*key)
    first = F.min(F.struct("part", order)).over(w)
    ranked = rows.withColumn("position", first).withColumn("__k", F.row_number().over(w.orderBy(F.desc("part"), F.desc(order))))
    return ranked.where("__k = 1").drop("__k")


def conflicts(a: DataFrame, b: DataFrame, *, key: str, value: str) -> DataFrame:
    """Keys that both sides have with different values; merging is allowed only if there are none."""
    x, y = a.select(key, F.col(value).alias("left_value")), b.select(key, F.col(value).alias("right_value"))
    return x.join(y, key).where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def checked_union(a: DataFrame, b: DataFrame, *, key: str, value: str) -> DataFrame:
    """The union by key; a key with different values fails the run."""
    x, y = a.select(key, F.col(value).alias("__a")), b.select(key, F.col(value).alias("__b"))
    both = x.join(y, key, "full_outer")
    clash = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__a") != F.col("__b"))
    return both.select(key, F.when(clash, F.raise_error(F.concat(F.lit("different values for "), F.col(key).cast("string")))).otherwise(F.coalesce("__a", "__b")).alias(value))


def priority_union(a: DataFrame, b: DataFrame, *, key: str, value: str) -> DataFrame:
    """All keys; where both have one, ``a`` wins."""
    x, y = a.select(key, F.col(value).alias("__a")), b.select(key, F.col(value).alias("__b"))
    return x.join(y, key, "full_outer").select(key, F.coalesce("__a", "__b").alias(value), F.when(F.col("__a").isNotNull(), "a").otherwise("b").alias("source"))


def overlay(base: DataFrame, local: DataFrame, names: DataFrame, *, key: str, tag: str) -> DataFrame:
    """Assignments overlaid by local ones, then tags renamed by ``names`` (tag, new_tag)."""
    x, y = base.select(key, F.col(tag).alias("__a")), local.select(key, F.col(tag).alias("__b"))
    merged = x.join(y, key, "full_outer").select(key, F.coalesce("__b", "__a").alias(tag))
    return merged.join(names.select(tag, "new_tag"), tag, "left").select(key, F.coalesce("new_tag", tag).alias(tag))


def rekey(cache: DataFrame, mapping: DataFrame, *, old: str, new: str, value: str) -> DataFrame:
    """Entries under their old keys and, copied, under new ones; existing entries stay, a second run changes nothing."""
    copies = cache.join(mapping.select(F.col(old).alias("__old"), new), cache[old] == F.col("__old")).select(F.col(new).alias(old), value)
    fresh = copies.join(cache.select(old), old, "left_anti").groupBy(old).agg(F.min(value).alias(value))
    return cache.select(old, value).unionByName(fresh)


def latest(log: DataFrame, *, key: list[str], order: list[Column]) -> DataFrame:
    """The view of an appended store: the newest row of each key."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return log.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def roster_export(assignments: DataFrame, players: DataFrame, *, key: str, tag: str, drop_tag: str, skip_tag: str, pseudo: str) -> DataFrame:
    """Players after an export: known ones, those first seen in assignments, without an unused pseudo-player; and whether
    every row that is not skipped has a tag (``confirmed``)."""
    used = assignments.where(F.col(tag).isNotNull() & ~F.col(tag).isin(drop_tag, skip_tag)).groupBy(tag).agg(F.count("*").alias("uses"))
    known = players.select(tag).distinct()
    everyone = known.join(used, tag, "full_outer").select(tag, F.coalesce("uses", F.lit(0)).alias("uses"))
    confirmed = assignments.agg(F.bool_and(F.col(tag).isNotNull() | (F.coalesce(tag, F.lit("")) == skip_tag)).alias("confirmed"))
    return everyone.where(~((F.col(tag) == pseudo) & (F.col("uses") == 0))).crossJoin(confirmed)  # one row


def bulk_accept(rows: DataFrame, *, tag: str, prefill: str, touched: Column, team: str, black: str, opponent: str) -> DataFrame:
    """Prefills are accepted where nobody touched the row; rows of the black team become the opponent's."""
    accepted = F.when(~touched & F.col(tag).isNull() & F.col(prefill).isNotNull(), F.col(prefill)).when(~touched & F.col(tag).isNull() & (F.col(team) == black), F.lit(opponent)).otherwise(F.col(tag))
    return rows.withColumn(tag, accepted)


def goal_export(marks: DataFrame, *, before: int = 40, after: int = 20) -> DataFrame:
    """(event, anchor, clip_start, clip_end, status) of marks ``goal`` and ``practice``; a human anchor beats the machine's."""
    anchor = F.coalesce("human_anchor", "machine_anchor")
    status = F.when(F.col("mark") == "goal", "confirmed").when(F.col("mark") == "practice", "rejected")
    return marks.select("event", anchor.alias("anchor"), F.greatest(F.lit(0), anchor - before).alias("clip_start"), (anchor + after).alias("clip_end"), status.alias("status")).where("status IS NOT NULL")


def work_queue(rows: DataFrame, groups: DataFrame, *, key: str, tag: str, group: str, ejected: Column, pending: Column) -> DataFrame:
    """Unassigned rows that were ejected, have no group, or whose group is no longer pending."""
    waiting = groups.where(pending).select(group).distinct()
    open_rows = rows.where(F.col(tag).isNull())
    free = open_rows.where(ejected | F.col(group).isNull())
    rest = open_rows.where(~(ejected | F.col(group).isNull())).join(waiting, group, "left_anti")
    return free.select(key).unionByName(rest.select(key))


def group_roots(merges: DataFrame, members: DataFrame, *, child: str, parent: str) -> DataFrame:
    """(child, root) after following merge pointers: the member of the group without a pointer, of a cycle the smallest."""
    from .clustering import components

    links = merges.where(F.col(child) != F.col(parent)).select(F.least(child, parent).alias("a"), F.greatest(child, parent).alias("b")).distinct()
    groups = components(links)
    named = members.select(F.col(child).alias("v")).distinct().join(groups, "v", "left").select("v", F.coalesce("root", "v").alias("g"))
    pointing = merges.where(F.col(child) != F.col(parent)).select(F.col(child).alias("v")).distinct().withColumn("points", F.lit(True))
    tops = named.join(pointing, "v", "left").groupBy("g").agg(F.coalesce(F.min(F.when(F.col("points").isNull(), F.col("v"))), F.min("v")).alias("root"))
    return named.join(tops, "g").select(F.col("v").alias(child), "root")
