"""Connected components and agglomerative clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import ship_package, staged


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for the vertices of ``edges`` (a, b); the root is the smallest of its component.

    Labels go to neighbours and then jump to their label's label, so the rounds grow with the logarithm of a component's
    diameter; each round is written to the shared folder.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("heard"))
        better = labels.join(heard, labels.v == heard.a).select("v", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("v").alias("at"), F.col("root").alias("next"))
        after = staged(better.join(jump, better.root == jump["at"]).select("v", "old", F.least("root", "next").alias("root")), "labels")
        if after.where("root <> old").isEmpty():
            return after.select("v", "root")
        labels = after.select("v", "root")


LINK_BLOCK = 8192


def close_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y): links that join all rows whose 1 - x·y is under the threshold, one short of a tree's at most.

    Products of matrices find the pairs; those that rounding could decide are summed again in the vectors' order. Pairs
    within one component of the links so far add nothing, so a crowd of close vectors is not listed pair by pair. With
    ``same``, x is y, a row's product with itself counts, and that link is listed.
    """
    n = 0 if same else len(x)  # rows of y are numbered after those of x
    root = np.arange(n + len(y))
    lengths = [np.sqrt(max(np.max(s[np.isfinite(s)], initial=0.0), 0.0)) for s in (np.einsum("ij,ij->i", v, v) for v in (x, y))]
    slack = (x.shape[1] + 2) * 2.0**-50 * (1.0 + abs(threshold) + lengths[0] * lengths[1])
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        product = part @ y.T
        near = product > 1.0 - threshold - slack
        rows, columns = np.nonzero(near & ~(product > 1.0 - threshold + slack))
        for cut in range(0, len(rows), 1 << 16):
            r, c = rows[cut : cut + (1 << 16)], columns[cut : cut + (1 << 16)]
            near[r, c] = 1.0 - np.cumsum(part[r] * y[c], axis=1)[:, -1] < threshold if x.shape[1] else 1.0 < threshold
        if same:
            own = np.flatnonzero(near[np.arange(len(part)), at + np.arange(len(part))]) + at
            out.append((own, own))
        while True:
            near &= root[at : at + len(part), None] != root[None, n:]
            hit = np.flatnonzero(near.any(axis=1))
            if not len(hit):
                break
            met = np.flatnonzero(near.any(axis=0))  # each row to its first near column, each column to its first near row
            pairs = np.concatenate((np.stack((hit + at, near[hit].argmax(axis=1)), axis=1), np.stack((near[:, met].argmax(axis=0) + at, met), axis=1)))
            used = []
            for a, b in pairs.tolist():
                u, v = find(a), find(n + b)
                if u != v:
                    root[max(u, v)] = min(u, v)
                    used.append((a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up
            out.append(tuple(np.array(used).T))
    return tuple(np.concatenate(z).astype(np.int64) for z in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2


def single_linkage(vectors: DataFrame, *, id_: str, vec: str, threshold: float, block: str | None = None) -> DataFrame:
    """(id, cluster): vectors (unit length, within a block) joined by cosine distances under the threshold.

    Equal vectors of a block are one; the rest are dealt into parts, and each pair of parts is a product of matrices that
    gives no more links than rows. Vectors with nulls or NaN, or without a block, are linked to none.
    """
    ship_package(vectors.sparkSession)
    kind = dict(vectors.dtypes)[id_]
    rows = vectors.select((F.col(block) if block else F.lit(0)).alias("__block"), F.col(id_).alias("__id"), F.col(vec).cast("array<double>").alias("__vec"))
    whole = rows.where(F.col("__block").isNotNull() & F.col("__id").isNotNull() & F.coalesce(F.forall("__vec", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))
    known = staged(whole, "linkage-rows")
    one = ["__block", "__vec"]
    classes = staged(known.groupBy(*one).agg(F.min("__id").alias("__id")).withColumn("__size", F.size("__vec")), "linkage-classes")
    keys = ["__block", "__size"]
    parts = classes.groupBy(*keys).agg(F.ceil(F.count("*") / LINK_BLOCK).cast("int").alias("__parts"))
    dealt = classes.join(parts, keys).withColumn("__p", F.pmod(F.xxhash64("__vec"), F.col("__parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__q")
    tiles = dealt.select(*keys, "__id", "__vec", "__p", other).select(*keys, "__id", "__vec", F.least("__p", "__q").alias("__i"), F.greatest("__p", "__q").alias("__j"), "__p")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, part = pdf["__id"].to_numpy(), pdf["__p"].to_numpy()
        matrix = np.stack(pdf["__vec"].to_numpy()).astype(np.float64)
        same = pdf["__i"].iloc[0] == pdf["__j"].iloc[0]
        x, y = (np.ones(len(ids), bool),) * 2 if same else (part == pdf["__i"].iloc[0], part == pdf["__j"].iloc[0])
        a, b = close_links(matrix[x], matrix[y], same, threshold)
        return pd.DataFrame({"a": ids[x][a], "b": ids[y][b]})

    between = staged(tiles.groupBy(*keys, "__i", "__j").applyInPandas(run, f"a {kind}, b {kind}"), "linkage-links")
    linked = between.select(F.explode(F.array("a", "b")).alias("__id")).distinct()
    # the rows of a class are joined if it is linked, be it to itself
    joined = classes.join(linked, "__id", "left_semi").select(*one, F.col("__id").alias("a"))
    copies = known.join(joined, one).select("a", F.col("__id").alias("b")).where("a <> b")
    groups = components(between.unionByName(copies))
    return vectors.select(id_).join(groups, F.col(id_) == groups.v, "left").select(id_, F.coalesce("root", id_).alias("cluster"))


def agglomerate(vectors: np.ndarray, threshold: float, linkage: str = "average") -> list[list[int]]:
    """Clusters of row numbers: the closest two merge while their cosine distance is under the threshold.

    Distances of merged clusters follow from those of their parts (Lance-Williams); clusters are ordered by first member.
    """
    n = len(vectors)
    members = [[k] for k in range(n)]
    if n < 2:
        return members
    d = 1.0 - vectors @ vectors.T
    np.fill_diagonal(d, np.inf)
    sizes, alive = np.ones(n), n
    while alive > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not d[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        if linkage == "average":
            row = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
        else:
            row = np.maximum(d[i], d[j]) if linkage == "complete" else np.minimum(d[i], d[j])
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        members[i] += members[j]
        members[j] = []
        alive -= 1
    return sorted((sorted(m) for m in members if m), key=lambda m: m[0])


def cluster_groups(vectors: DataFrame, *, group: str, id_: str, vec: str, threshold: float, linkage: str = "average") -> DataFrame:
    """(group, id, cluster) by agglomeration within each group, such as the goals of one session: tens of rows."""
    ship_package(vectors.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id")
        matrix = np.array(pdf["__vec"].tolist(), dtype=np.float64)
        out = [(pdf["__group"].iloc[0], pdf["__id"].iloc[m], k + 1) for k, ms in enumerate(agglomerate(matrix, threshold, linkage)) for m in ms]
        return pd.DataFrame(out, columns=["grp", "id", "cluster"])

    rows = vectors.select(F.col(group).cast("long").alias("__group"), F.col(id_).cast("long").alias("__id"), F.col(vec).cast("array<double>").alias("__vec"))
    return rows.groupBy("__group").applyInPandas(run, "grp long, id long, cluster long")
