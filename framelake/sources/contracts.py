"""The documents that several readers share, each under its own contract.

A contract names what must hold of every row, what must hold of the rows it keeps, and what it gives.  A broken rule stops
the run with the rule's name and the row's place; rows that a contract passes over are simply not there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake import schemas
from framelake.errors import SchemaError
from framelake.functions.keys import first_crops, goal_key, seed_box

from .scans import documents

#: The statuses that a goal may have, and those of a scorer candidate.
GOAL_STATUSES = ("candidate", "confirmed", "clipped", "done", "rejected", "removed", "uncertain")
OK, SKIP = "OK", "SKIP"


def demand(rows: DataFrame, rules: dict[str, Column], *, place: str = "ordinal") -> DataFrame:
    """``rows`` unchanged; the first rule that a row breaks (false or null) fails the run."""
    if not rules:
        return rows
    broken = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    said = F.concat(F.lit("row "), F.col(place).cast("string"), F.lit(": "), broken)
    return rows.where(F.when(broken.isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def listed(spark: SparkSession, path: str, item: str, *, under: str | None = None) -> DataFrame:
    """(session, path, ordinal, item fields) of JSON documents: a list, or an object that holds one ``under`` a name.

    ``session`` is the partition folder ``session=`` of a file, empty without one.
    """
    kind = f"array<struct<{item}>>"
    if under:
        raw = documents(spark, path, f"`{under}` {kind}").withColumn("__list", F.col(under))
    else:
        texts = spark.read.option("wholetext", True).schema("value string").text(path).withColumn("path", F.col("_metadata.file_path"))
        raw = texts.withColumn("__list", F.from_json("value", kind, {"mode": "FAILFAST"}))
    raw = raw.withColumn("__list", F.coalesce("__list", F.raise_error(F.concat(F.lit("no list in "), F.col("path"))).cast(kind)))
    session = F.col("session").cast("string") if "session" in raw.columns else F.regexp_extract("path", "/session=([^/]*)/", 1)
    return raw.select(session.alias("session"), "path", F.posexplode("__list").alias("ordinal", "__x")).select("session", "path", "ordinal", "__x.*")


def _given(name: str) -> Column:
    return F.col(name).isNotNull()


def _named(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


@dataclass
class Contract:
    """What one reader asks of all rows and of those it keeps."""

    every: dict[str, Column] = field(default_factory=dict)
    keep: Column | None = None
    kept: dict[str, Column] = field(default_factory=dict)
    unique: list[str] = field(default_factory=list)


def under_contract(rows: DataFrame, c: Contract) -> DataFrame:
    out = demand(rows, c.every)
    out = out if c.keep is None else out.where(c.keep)
    out = demand(out, c.kept)
    if c.unique:
        once = F.count("*").over(Window.partitionBy("session", *c.unique)) == 1
        out = demand(out.withColumn("__once", once), {f"a second row of {', '.join(c.unique)}": F.col("__once")}).drop("__once")
    return out


def goal_contracts() -> dict[str, Contract]:
    """The readers of goal lists: clips, release probe, crops, labelling page, match keys, photo anchors, work keys, read budget."""
    confirmed = F.col("status") == "confirmed"
    place = {"file is missing": _named("file"), "anchor_time is missing": _given("anchor_time")}
    status = {"status is missing": _given("status")}
    times = {"clip_start is missing": _given("clip_start"), "clip_end is missing": _given("clip_end"), "the anchor is outside its clip": F.col("anchor_time").between(F.col("clip_start"), F.col("clip_end"))}
    return {
        "clips": Contract(status, confirmed, {**place, **times}),
        "probe": Contract({**place, "anchor_time is negative": F.col("anchor_time") >= 0, **status}, confirmed, unique=["file", "anchor_time"]),
        "crops": Contract({}, confirmed, place),
        "page": Contract({}, confirmed, place),
        "keys": Contract(status, confirmed, place),
        "anchors": Contract({**place, **status}, confirmed),
        "work": Contract({}, confirmed & _named("file") & _given("anchor_time")),
        "budget": Contract({}, confirmed),
    }


def goals(spark: SparkSession, path: str, contract: str) -> DataFrame:
    """Confirmed goals (session, ordinal, file, anchor_time, …, key) under one of ``goal_contracts``."""
    rows = under_contract(listed(spark, path, schemas.GOAL, under="goals"), goal_contracts()[contract])
    return rows.withColumn("key", goal_key(F.col("file"), F.round(F.col("anchor_time") * 10)))


def unknown_statuses(spark: SparkSession, path: str) -> DataFrame:
    """(session, ordinal, status) of goals whose status no reader knows: likely typing errors, which are passed over."""
    return listed(spark, path, schemas.GOAL, under="goals").where(~F.col("status").isin(*GOAL_STATUSES)).select("session", "ordinal", "status")


def candidate_contracts() -> dict[str, Contract]:
    place = {f"{c} is missing": _given(c) for c in ("fid", "t0", "cx", "cy")}
    return {"index": Contract(place), "hoops": Contract({**place, "ac is missing": _given("ac")}), "review": Contract({**place, "ac is missing": _given("ac"), "label is missing": _given("label")})}


def candidates(spark: SparkSession, paths: list[str], contract: str) -> DataFrame:
    """Candidates of all batches, one after another: (file_idx, ordinal, fid, label, t0, …) under one contract."""
    if not paths:
        raise SchemaError("no candidate file is given")
    out = None
    for k, p in enumerate(paths):
        rows = under_contract(listed(spark, p, schemas.CANDIDATES_JSON), candidate_contracts()[contract]).withColumn("file_idx", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


HOOP_EVENT = "fid string, window array<double>, anchor array<double>, detected boolean, track array<array<string>>"


def hoop_contracts() -> dict[str, Contract]:
    """Two strict readers, of which one needs detected tracks only in shape, and one that passes over what it cannot use."""
    pair = lambda c: F.coalesce(F.size(c) == 2, F.lit(False))
    strict = {"fid is missing": _named("fid"), "the window has not two ends": pair("window"), "the window ends before it starts": F.col("window")[0] <= F.col("window")[1], "track is missing": _given("track")}
    return {"heat": Contract({**strict, "the anchor has not two parts": pair("anchor")}), "rank": Contract(strict), "review": Contract({}, _named("fid"))}


def hoop_events(spark: SparkSession, path: str, contract: str) -> DataFrame:
    """(session, ordinal, fid, w0, w1, anchor_cx, anchor_cy, detected, track): points mix numbers and words and are cast one by one."""
    rows = under_contract(listed(spark, path, HOOP_EVENT, under="events"), hoop_contracts()[contract])
    point = lambda p: F.struct(p[0].cast("double").alias("sec"), p[1].cast("int").alias("cx"), p[2].cast("int").alias("cy"), p[3].alias("src"))
    at = lambda c, k: F.get(c, F.lit(k))
    return rows.select("session", "ordinal", "fid", at("window", 0).alias("w0"), at("window", 1).alias("w1"), at("anchor", 0).cast("int").alias("anchor_cx"), at("anchor", 1).cast("int").alias("anchor_cy"), "detected", F.transform("track", point).alias("track"))


def scorer_contracts() -> dict[str, Contract]:
    """The readers of scorer candidates: clustering, propagation, team votes, labelling page."""
    key = {"key is missing": _named("key")}
    known = {"status is neither OK nor SKIP": F.col("status").isin(OK, SKIP)}
    place = {"file is missing": _named("file"), "anchor_time is missing": _given("anchor_time")}
    return {
        "cluster": Contract({**key, "status is missing": _given("status")}, (F.col("status") == OK) & (F.size(first_crops(F.col("crops"), F.col("crop"))) > 0)),
        "propagate": Contract({**key, **place, **known}),
        "votes": Contract({**key, "status is missing": _given("status")}, (F.col("status") == OK) & _named("team_guess")),
        "page": Contract({**key, **known}, None, {}, ["key"]),
    }


def scorer_candidates(spark: SparkSession, path: str, contract: str) -> DataFrame:
    """Candidates (…, images, seed) under one contract: the older field ``crop`` fills ``images`` where ``crops`` is absent."""
    rows = under_contract(listed(spark, path, schemas.SCORER_CANDIDATE, under="candidates"), scorer_contracts()[contract])
    return rows.withColumn("images", first_crops(F.col("crops"), F.col("crop"))).withColumn("seed", seed_box(F.col("seed_box"), F.col("seed_frame")))


def result_cache(spark: SparkSession, path: str, value: str, version: int) -> DataFrame:
    """(session, key, value) of result caches of this version; one of another version counts as empty."""
    raw = documents(spark, path, f"version int, entries map<string,{value}>")
    session = F.col("session").cast("string") if "session" in raw.columns else F.lit("")
    return raw.where(F.col("version") == version).select(session.alias("session"), F.explode("entries").alias("key", "value"))


def clusters(spark: SparkSession, path: str, *, images: bool = False) -> DataFrame:
    """(session, cluster_id, keys, rep_crops); ids are unique within a session, and keys (and images) lists without gaps."""
    whole = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    rules = {"cluster_id is missing": _given("cluster_id"), "keys are no list of names": whole("keys")}
    rules |= {"rep_crops are no list of names": whole("rep_crops")} if images else {}
    rows = listed(spark, path, "cluster_id int, keys array<string>, rep_crops array<string>", under="clusters")
    return under_contract(rows, Contract(rules, unique=["cluster_id"])).select("session", "cluster_id", "keys", "rep_crops")


def track_links(spark: SparkSession, path: str) -> DataFrame:
    """(session, key, track, mixed) of the links from goals to tracks; a goal is linked once."""
    rows = listed(spark, path, "key string, track int, mixed boolean", under="links")
    return under_contract(rows, Contract({"key is missing": _named("key"), "track is missing": _given("track")}, unique=["key"])).select("session", "key", "track", F.coalesce("mixed", F.lit(False)).alias("mixed"))


def photo_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(session, id, status, image, video_no, sec, score); ids are unique."""
    rows = listed(spark, path, "id string, status string, image string, video_no int, sec double, score double", under="candidates")
    return under_contract(rows, Contract({"id is missing": _named("id"), "status is missing": _given("status")}, unique=["id"])).drop("path")


def team_config(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """(session, name, value): the configured names of each session, defaults for the rest; a corrupt file counts as absent."""
    raw = documents(spark, path, "teams map<string,string>, _corrupt_record string", strict=False)
    session = F.col("session").cast("string") if "session" in raw.columns else F.lit("")
    known = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    teams = F.coalesce(F.map_filter("teams", lambda k, v: v.isNotNull() & (v != "")), F.create_map().cast("map<string,string>"))
    whole = F.map_concat(F.map_filter(known, lambda k, v: ~F.map_contains_key(teams, k)), teams)
    return raw.select(session.alias("session"), F.explode(whole).alias("name", "value"))


def folder_usage(spark: SparkSession, path: str, *, depth: int = 1) -> DataFrame:
    """(folder, files, bytes) under ``path`` by the first ``depth`` folders, from the listing alone; nothing is deleted here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    inner = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    parts = F.split(F.expr(f"substring(p, instr(p, '{path.rstrip('/')}/') + {len(path.rstrip('/')) + 1})"), "/")
    rows = files.withColumn("p", inner).withColumn("parts", parts)
    folder = F.array_join(F.slice("parts", F.lit(1), F.least(F.lit(depth), F.size("parts") - 1)), "/")
    return rows.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


__all__ = [
    "Contract", "candidates", "clusters", "demand", "folder_usage", "goals", "hoop_events", "listed", "photo_candidates", "result_cache", "scorer_candidates", "team_config", "track_links", "under_contract",
    "unknown_statuses",
]
