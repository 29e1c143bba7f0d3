"""Near-duplicate groups by 64-bit SimHash and meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant within half the radius of each.  Emitting all variants of 64
bits at half radius 2 costs 2,081 rows a fingerprint; therefore the bits are first cut into ``blocks`` parts.  Leaving out
the part with the most differing bits leaves at most ``radius - ceil(radius / blocks)`` of them, so the same argument
holds on the kept bits with a smaller ball: with three parts 132 rows a fingerprint.  ``blocks=1`` is the plain ball.
Variants are shuffled; keys met twice or more give candidate pairs, which the whole fingerprints then verify.

A key met by more than ``crowd`` distinct fingerprints (a large group of near copies) is not expanded into pairs.  Its
members emit the plain ball of half the radius instead: all members of one such variant are within the radius of each
other by the triangle inequality, so linking each to the smallest is exact and linear.

Components of the links are found by label propagation with pointer jumping over distinct fingerprints; every round is
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.session import reclaim, settle, ship_package, tidy

from .common import staged

SEED, BITS = 42, 64
BROADCAST_ROWS = 1_000_000
LINK_ROWS = 1 << 16  # shared variants that the driver may hold while links are sought; 650,000 of them took it 140 MB


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle; A-Z are lower-cased, words are parted by ASCII white space."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, dtype="<u8")
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype="<u8")


def fingerprint(text: str | None, words: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; zero without words."""
    return _majority(shingle_hashes(text, words))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    ship_package(docs.sparkSession)
    return docs.selectExpr(f"cast(`{key}` as long) AS doc_id", f"`{text}` AS text").mapInArrow(tidy(run), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(radius: int, blocks: int) -> list[tuple[int, int]]:
    """(kept bits, flipped bits) of every variant; a mark in the left-out bits tells the parts apart."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    half = (radius - (-(-radius // blocks) if blocks > 1 else 0) + 1) // 2
    out = []
    for b in range(blocks):
        gone = sum(1 << k for k in range(cuts[b], cuts[b + 1])) if blocks > 1 else 0
        kept = [k for k in range(BITS) if not gone >> k & 1]
        mark = (b + 1) << cuts[b] if blocks > 1 else 0
        out += [(_signed((1 << 64) - 1 - gone), _signed(sum(1 << k for k in c) | mark)) for n in range(half + 1) for c in combinations(kept, n)]
    return out


def _variants(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    masks = F.array(*[F.struct(F.lit(kept).alias("kept"), F.lit(flip).alias("flip")) for kept, flip in ball(radius, blocks)])
    return fps.select("fp", F.explode(masks).alias("m")).select(F.expr("(fp & m.kept) ^ m.flip").alias("variant"), "fp")


def links(fps: DataFrame, *, radius: int = 4, blocks: int = 3, crowd: int = 64) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints with the components of all links within ``radius``."""
    if radius % 2:
        raise ValueError("an even radius is needed")
    near = F.bit_count(F.expr("a ^ b")) <= radius
    emitted = _variants(fps, radius, blocks)
    met = staged(emitted.repartition("variant").groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-met")
    pairs = met.where("n = 2").select("a", "b").where(near)
    many = met.where("n > 2").select("variant", "n")
    size = many.count()
    if not size:
        return pairs.distinct()
    # few enough meet the variants where they are made; beyond it the join shuffles them and hashes the shared ones
    many = F.broadcast(many) if size <= LINK_ROWS else many.hint("shuffle_hash")
    members = staged(emitted.join(many, "variant"), "simhash-members")
    small = members.where(F.col("n") <= crowd).groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    small = small.select(F.explode("all").alias("b"), "all").select("b", F.filter("all", lambda a: (a < F.col("b")) & (F.bit_count(a.bitwiseXOR(F.col("b"))) <= radius)).alias("lower"))
    # of a member's smaller neighbours all are tied to the smallest, which keeps the component and not every pair
    small = small.where(F.size("lower") > 0).select(F.element_at("lower", 1).alias("a"), F.explode(F.concat(F.array("b"), F.expr("slice(lower, 2, size(lower))"))).alias("b"))
    hot = members.where(F.col("n") > crowd).select("fp").distinct()
    if not hot.isEmpty():
        # no join: Spark takes a ball for as small as its few members, and would broadcast 2,081 rows of each from the driver
        spread = _variants(hot, radius, 1).withColumn("a", F.min("fp").over(Window.partitionBy("variant")))
        small = small.unionByName(spread.where("a < fp").select("a", F.col("fp").alias("b")))
    return pairs.unionByName(small).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b); the root is the smallest vertex of the component."""
    smallest = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(smallest, "b")  # again every smaller neighbour is tied to the smallest
    edges = tied.select(F.col("m").alias("a"), "b").unionByName(tied.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("v"), F.least("a", "l").alias("root")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("heard"))
        better = labels.join(heard, labels.v == heard.a).select("v", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("v").alias("at"), F.col("root").alias("next"))
        after = staged(better.join(jump, better.root == jump["at"]).select("v", "old", F.least("root", "next").alias("root")), "labels")
        if after.where("root <> old").isEmpty():
            return after.select("v", "root")
        labels = after.select("v", "root")


def _rooted(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, first, root) of every fingerprint (fp, first)."""
    groups = components(edges)
    return staged(distinct.join(groups, distinct.fp == groups.v, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-known")


def _named(known: DataFrame) -> DataFrame:
    """(fp, first, root, component_id) of every fingerprint (fp, first, root)."""
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.join(least, "root").select("fp", "first", "root", "component_id")


def near_duplicates(docs: DataFrame, *, words: int = 4, radius: int = 4, blocks: int = 3, crowd: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    ``component_id`` is the smallest id reachable by links.  A null or blank text has fingerprint zero and is linked like
    any other; null ids are passed over when the smallest is sought; repeated rows share their component; an empty table
    gives no rows; other columns are ignored.
    """
    marked = staged(fingerprints(docs, words=words, key=key, text=text), "simhash-docs")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = _named(_rooted(distinct, staged(links(distinct.select("fp"), radius=radius, blocks=blocks, crowd=crowd), "simhash-links")))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SAMPLE_SETS, LEAST_SEEN, MOST_COMMON, SALTS, SALT_ROWS, REPRESENTATIVES = 20_000, 5, 1 << 18, 16, 1024, 16


def least_common(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` shares at least with any set of that Jaccard similarity to it."""
    return int(np.ceil(similarity * n - 1e-9))


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set (sorted, distinct) in the order of all sets: two sets as similar as that share one of them.

    Shingles that are not ``common`` come first, by their hash; common ones follow by their counts.  The order may be any as
    long as all sets have the same one, so what is common may be estimated without changing which pairs are found.
    """
    n = len(shingles)
    if not n:
        return shingles
    weight = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weight = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, weight))[: n - least_common(n, similarity) + 1]]


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bits of a set, as longs: each shingle flips the one its hash names.  There are two bits or more for each shingle.

    Two sets differ in at least as many shingles as these bits differ, so a pair whose bits differ in more than the
    similarity allows need not be compared by shingles.
    """
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _differing(x: str, y: str) -> str:
    """Differing bits of two parities; the longer one, at most twice as long, is folded."""
    m = f"least(size({x}), size({y}))"
    fold = lambda z: f"IF(size({z}) > {m}, zip_with(slice({z}, 1, {m}), slice({z}, {m} + 1, {m}), (p, q) -> p ^ q), {z})"
    return f"aggregate(zip_with({fold(x)}, {fold(y)}, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"


def _set_id(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def common_shingles(docs: DataFrame, *, words: int, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those seen in several of at most about ``SAMPLE_SETS`` texts; they only set an order."""
    n = docs.count()
    part = F.pmod(F.xxhash64(F.col(key), F.lit("shingles")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_SETS / max(n, 1)))
    sets = _shingle_sets(docs.where(part), words, text).dropDuplicates(["sid"])
    seen = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN)
    rows = seen.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toPandas()
    shingles, counts = rows.s.to_numpy(np.int64).view(np.uint64), rows.n.to_numpy(np.int64)
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def _sketched(docs: DataFrame, words: int, similarity: float, key: str, text: str) -> DataFrame:
    """(doc_id, fp, sid, n, prefix, parity) of every row; sid stands for the set of shingles, n is its size."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(common_shingles(docs, words=words, key=key, text=text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sids, sizes, firsts, parities = [], [], [], [], []
            for x in batch.column(1):
                hashes = shingle_hashes(x.as_py(), words)
                distinct = np.unique(hashes)
                fps.append(_signed(_majority(hashes)))
                sids.append(_set_id(distinct))
                sizes.append(len(distinct))
                firsts.append(prefix(distinct, similarity, *shared.value).view(np.int64))
                parities.append(parity(distinct))
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(fps, pa.int64()), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, longs), pa.array(parities, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "sid", "n", "prefix", "parity"])

    return docs.selectExpr(f"cast(`{key}` as long) AS doc_id", f"`{text}` AS text").mapInArrow(tidy(run), "doc_id long, fp long, sid long, n int, prefix array<long>, parity array<long>")


def _shingle_sets(docs: DataFrame, words: int, text: str) -> DataFrame:
    """(sid, shingles) of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                sets = [np.unique(shingle_hashes(x.as_py(), words)) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["sid", "shingles"])

    return docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "sid long, shingles array<long>")


def _may_reach(similarity: float, a: str = "a", b: str = "b") -> str:
    """Whether two sets (n, at) that meet in their shingles number ``at`` can still be as similar as that."""
    room = f"least({a}.n - {a}.at, {b}.n - {b}.at)"  # at counts from 0: the met shingle and all behind it
    return f"{a}.sid < {b}.sid AND {a}.fp <> {b}.fp AND {room} >= {similarity / (1 + similarity)!r} * ({a}.n + {b}.n) - 1e-6 AND least({a}.n, {b}.n) >= {similarity!r} * greatest({a}.n, {b}.n) - 1e-6"


def _within(similarity: float, x: str, y: str, a: str, b: str) -> str:
    """Whether the parities x and y of sets of a and b shingles leave room for that similarity."""
    return f"{_differing(x, y)} <= {(1 - similarity) / (1 + similarity)!r} * ({a} + {b}) + 1e-6"


def _verified(pairs: DataFrame, marked: DataFrame, docs: DataFrame, *, words: int, similarity: float, key: str, text: str) -> DataFrame:
    """(a, b) as fingerprints of those pairs of sets (sa, sb) that share ``similarity`` of their shingles."""
    sketches = marked.groupBy("sid").agg(F.min("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("parity").alias("parity"))
    near = pairs.join(sketches.select(F.col("sid").alias("sa"), F.col("fp").alias("a"), F.col("n").alias("na"), F.col("parity").alias("x")), "sa")
    near = near.join(sketches.select(F.col("sid").alias("sb"), F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("y")), "sb")
    near = staged(near.where(_within(similarity, "x", "y", "na", "nb")).select("sa", "sb", "a", "b"), "simhash-possible")
    needed = staged(near.select(F.explode(F.array("sa", "sb")).alias("sid")).distinct(), "simhash-needed")
    asked = docs
    if needed.count() <= BROADCAST_ROWS:  # few enough to pick their texts before these are hashed
        needed = F.broadcast(needed)
        ids = staged(marked.join(needed, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("id")).select("id").distinct(), "simhash-ids")
        asked = docs.join(F.broadcast(ids), docs[key].cast("long").eqNullSafe(ids["id"]), "left_semi")
    sets = staged(_shingle_sets(asked, words, text).join(needed, "sid", "left_semi").dropDuplicates(["sid"]), "simhash-shingles")
    both = near.join(sets.select(F.col("sid").alias("sa"), F.col("shingles").alias("x")), "sa").join(sets.select(F.col("sid").alias("sb"), F.col("shingles").alias("y")), "sb")
    common = F.size(F.array_intersect("x", "y"))
    found = both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-6)
    return staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-similar")


def _named_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.col("a.sid").alias("sa"), F.col("b.sid").alias("sb")).distinct()


def similar_pairs(marked: DataFrame, docs: DataFrame, *, words: int, similarity: float, crowd: int, key: str, text: str) -> DataFrame:
    """Pairs (a, b) of groups, the ``fp`` of ``marked``, with texts that share at least ``similarity`` of their shingles, found by prefixes.

    Only shingles that occur in different groups count.  One in the prefixes of up to ``crowd`` sets compares them all.  One
    in more compares each with one of them first, the first such shingle of a set with ``REPRESENTATIVES``; then all pairs in
    it that these links leave in different components.  So the components are those of all pairs, and a large group of near
    copies is not expanded into its pairs.
    """
    spread = marked.select("sid", "fp", "n", F.posexplode("prefix").alias("at", "shingle"))
    reclaim(docs.sparkSession)  # all first shingles are shuffled twice, which is most of the stage's disk
    met = staged(spread.groupBy("shingle").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("shingle"), "simhash-met-shingles")
    reclaim(docs.sparkSession)
    members = staged(spread.join(met, "shingle").groupBy("shingle", "sid").agg(*(F.min(x).alias(x) for x in ("fp", "n", "at"))), "simhash-members")
    one = F.struct("sid", "fp", "n", "at")
    sizes = members.groupBy("shingle").agg(F.count("*").alias("m"), F.min(one).alias("top"))
    sized = staged(members.join(sizes, "shingle"), "simhash-sized")
    few = sized.where(F.col("m") <= crowd).groupBy("shingle").agg(F.collect_list(one).alias("all"))
    few = few.select(F.explode("all").alias("a"), "all").select(F.col("a.sid").alias("sa"), F.expr(f"transform(filter(all, b -> {_may_reach(similarity)}), b -> b.sid)").alias("bs"))
    # similar sets meet in many shingles, and their pair is a row once
    few = few.where(F.size("bs") > 0).groupBy("sa").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs")).select("sa", F.explode("bs").alias("sb"))
    many = sized.where(F.col("m") > crowd).select(F.col("top").alias("a"), one.alias("b")).where(_may_reach(similarity))
    # a text that is not like that one may be like others: its first crowded shingle compares it with a few more
    first = sized.where(F.col("m") > crowd).groupBy(F.col("sid").alias("of")).agg(F.min_by("shingle", F.struct("at", "shingle")).alias("shingle"))
    some = sized.where(F.col("m") > crowd).groupBy("shingle", F.pmod(F.xxhash64("sid"), F.lit(REPRESENTATIVES)).alias("part")).agg(F.min(one).alias("x"))
    asking = sized.where(F.col("m") > crowd).join(first, (F.col("sid") == F.col("of")) & (sized.shingle == first.shingle)).select(sized.shingle, one.alias("y"))
    more = asking.join(some, "shingle").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where(_may_reach(similarity))
    pairs = staged(few.unionByName(_named_pairs(many.unionByName(more))).distinct(), "simhash-candidates")
    settle(docs.sparkSession)
    found = _verified(pairs, marked, docs, words=words, similarity=similarity, key=key, text=text)
    crowded = staged(sized.where(F.col("m") > crowd).select("shingle", "sid", "fp", "n", "at", "m"), "simhash-crowded")
    if crowded.isEmpty():
        return found
    groups = components(found)
    crowded = crowded.join(groups, crowded.fp == groups.v, "left").select("shingle", "sid", "fp", "n", "at", "m", F.coalesce("root", "fp").alias("root"))
    crowded = staged(crowded, "simhash-crowded-roots")
    apart = crowded.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    crowded = crowded.join(apart, "shingle").join(marked.select("sid", "parity").dropDuplicates(["sid"]), "sid")
    one = F.struct("sid", "fp", "n", "at", "root", "parity")
    # salts, as many as a shingle's rows need, spread its pairs over tasks; the condition is part of the join, so only pairs that pass are rows
    salts = F.least(F.lit(SALTS), F.ceil(F.col("m") / SALT_ROWS)).cast("int")
    left = crowded.select("shingle", F.pmod(F.xxhash64("sid"), salts).cast("int").alias("salt"), one.alias("a"))
    right = crowded.select("shingle", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), one.alias("b"))
    left, right = left.alias("left"), right.alias("right")
    same = (F.col("left.shingle") == F.col("right.shingle")) & (F.col("left.salt") == F.col("right.salt"))
    settle(docs.sparkSession)
    met = left.join(right, same & (F.col("a.root") != F.col("b.root")) & F.expr(_may_reach(similarity)) & F.expr(_within(similarity, "a.parity", "b.parity", "a.n", "b.n")))
    rest = staged(_named_pairs(met), "simhash-candidates-crowded")
    return found.unionByName(_verified(rest, marked, docs, words=words, similarity=similarity, key=key, text=text)).distinct()


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, radius: int = 4, blocks: int = 3, crowd: int = 64, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the same columns and one row of every group: the one with the smallest id.

    Groups are the components of links within the radius and of pairs that share ``similarity`` of their shingles, which 64
    bits at a small radius often miss.  Of rows that share the smallest id the one with the smallest
    fingerprint stays, of repeated rows one.
    """
    marked = staged(_sketched(docs, words, similarity, key, text), "simhash-docs")
    settle(docs.sparkSession)
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    near = staged(links(distinct.select("fp"), radius=radius, blocks=blocks, crowd=crowd), "simhash-near")
    known = _rooted(distinct, near)
    moved = known.where("root <> fp").select(F.col("fp").alias("v"), "root")
    if moved.count() <= BROADCAST_ROWS:
        moved = F.broadcast(moved)
    grouped = marked.join(moved, marked.fp == moved.v, "left").withColumn("fp", F.coalesce("root", "fp")).drop("v", "root")
    later = components(staged(similar_pairs(grouped, docs, words=words, similarity=similarity, crowd=crowd, key=key, text=text), "simhash-links"))
    known = known.join(later.select(F.col("v").alias("root"), F.col("root").alias("further")), "root", "left").select("fp", "first", F.coalesce("further", "root").alias("root"))
    named = staged(_named(staged(known, "simhash-known")), "simhash-named")
    # of each component the fingerprint under which the smallest id occurs
    chosen = named.where(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("fp"), F.any_value("component_id").alias("id"))
    kept = staged(chosen.select("fp", "id"), "simhash-kept")
    rows = marked.join(kept, (marked.fp == kept.fp) & marked.doc_id.eqNullSafe(kept.id)).select(marked.doc_id, marked.fp)
    repeats = staged(rows.groupBy("doc_id", "fp").agg(F.count("*").alias("n")), "simhash-rows")
    reclaim(docs.sparkSession)  # before the texts are shuffled
    kept_docs = _with_fingerprint(docs, words, text).join(repeats.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__kept")), F.col(key).cast("long").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__kept")), "left_semi")
    if not repeats.where("n > 1").isEmpty():
        kept_docs = kept_docs.dropDuplicates([key, "__fp"])
    return kept_docs.select(docs.columns)


def _with_fingerprint(docs: DataFrame, words: int, text: str) -> DataFrame:
    where, names = docs.columns.index(text), [*docs.columns, "__fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(where)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names)

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))
