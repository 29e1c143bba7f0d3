"""The chains of a session: detections to ranked events, goals to identities, assignments to clip and zone reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.errors import SchemaError
from framelake.functions import geometry as geo
from framelake.functions.keys import team_of
from framelake.functions.plugins import crop_team
from framelake.operators import folds, joins, landing, segments, tracking, votes
from framelake.schemas import BLACK, CASUAL, NO_GOAL, OPPONENT, WHITE
from framelake.session import staged

STAGES = ["init", "candidates", "goals", "roster", "roster_confirmed", "output"]


def mine_candidates(det: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """Numbered candidates of every file (fid, frame, det, cx, cy, conf) under the default thresholds."""
    tracks = tracking.track_balls(det)
    static = segments.static_candidates(tracks, track=["fid", "track"])
    if persons is not None:
        static = static.join(held_segments(tracks, persons), ["fid", "track", "seg"], "left_anti")
    static = static.select("fid", F.col("t0_ds").alias("t0"), "cx", "cy")
    pairs = joins.rejoin_pairs(det, keys=["fid"], low=3, high=7, reach=400, void=250, least_conf=0.3, before=3, before_reach=150, after=4, after_reach=200)
    rejoin = pairs.select("fid", (F.col("a_frame") + F.col("b_frame")).alias("t0"), F.col("b_cx").alias("cx"), F.col("b_cy").alias("cy"), F.col("a_ord").alias("rid"))
    merged = folds.merge_candidates(static, rejoin, keys=["fid"])
    return merged.withColumn("label", F.concat(F.lit("#"), F.row_number().over(Window.partitionBy("fid").orderBy("t0", "src", "cx", "cy")).cast("string")))


def held_segments(tracks: DataFrame, persons: DataFrame, *, half: int = 10, least: float = 0.5) -> DataFrame:
    """(fid, track, seg) of static stretches in which a person box covers over half of the ball's box."""
    order = Window.partitionBy("fid", "track").orderBy("frame", "det")
    placed = tracks.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    segs = segments.static_segments(tracks, track=["fid", "track"])
    members = placed.join(segs, ["fid", "track"]).where("pos BETWEEN first_pos AND last_pos")
    ball = F.struct((F.col("cx") - half).alias("x1"), (F.col("cy") - half).alias("y1"), (F.col("cx") + half).alias("x2"), (F.col("cy") + half).alias("y2"))
    boxes = persons.where("x2 > x1 AND y2 > y1").select("fid", "frame", F.struct("x1", "y1", "x2", "y2").alias("b"))
    return members.withColumn("a", ball).join(boxes, ["fid", "frame"]).where(geo.coverage(F.col("a"), F.col("b")) > least).select("fid", "track", "seg").distinct()


def rank_events(candidates: DataFrame, hoops: DataFrame) -> DataFrame:
    """(fid, event, anchor, hoop_dist, position): clustered candidates, nearest to a hoop first, those without one last.

    ``hoops`` has points (fid, t, hx, hy); a candidate's hoop is the nearest within a second.
    """
    c = candidates.withColumn("ord", F.row_number().over(Window.partitionBy("fid").orderBy("t0", "src", "cx", "cy")).cast("long"))
    near = joins.asof(c.withColumn("cid", F.concat_ws("-", "fid", "ord")), hoops.withColumn("hord", F.col("t")), keys=["fid"], left_id="cid", at="t0", right_at="t", right_order="hord", tolerance=10)
    c = c.join(near.select("fid", "ord", "hx", "hy"), ["fid", "ord"], "left")
    events = folds.cluster_events(c, keys=["fid"])
    d = geo.distance(F.col("cx"), F.col("cy"), F.col("hx"), F.col("hy"))
    out = events.groupBy("fid", "event").agg(F.max_by("t0", F.struct("t0", "ord")).alias("anchor"), F.min(d).alias("hoop_dist"), F.count("*").alias("members"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("fid").orderBy(F.asc_nulls_last("hoop_dist"), "event")))


def link_identities(goals: DataFrame, boxes: DataFrame, *, least_iou: float = 0.3) -> DataFrame:
    """(goal, track) of goals (fid, goal, frame, x1…y2) whose seed box overlaps a tracked person box of that frame."""
    seeds = goals.select("fid", "goal", "frame", F.struct("x1", "y1", "x2", "y2").alias("s"))
    tracks = tracking.track_persons(boxes).select("fid", "track", "frame", F.struct("x1", "y1", "x2", "y2").alias("b"))
    return joins.best_match(seeds.join(tracks, ["fid", "frame"]), by=["goal"], score=geo.iou(F.col("s"), F.col("b")), least=least_iou, order=[F.col("track")]).select("goal", "track")


def require_confirmed(confirmed: bool, waived: bool = False) -> None:
    if not confirmed and not waived:
        raise SchemaError("the roster is not confirmed")


def select_goals(goals: DataFrame, assignments: DataFrame | None, players: DataFrame | None, *, scorer: str | None = None, team: str | None = None) -> DataFrame:
    """Confirmed goals (key, scorer) of one scorer, one team, or all.

    A roster is needed for a team, not both choices may be given, and players without a team have no team's choice.  With a
    roster a scorer is a tag, or else the one player of that name, and all means all assigned goals; without one the scorer
    is matched by name.
    """
    confirmed = goals.where("status = 'confirmed'")
    if scorer and team:
        raise SchemaError("choose a scorer or a team")
    if team and assignments is None:
        raise SchemaError("a team needs a roster")
    if team == CASUAL:
        raise SchemaError("players without a team have no goals of a team")
    if not scorer and not team:
        return confirmed if assignments is None else confirmed.join(assignments.select("key"), "key", "left_semi")
    if assignments is None:
        return confirmed.where(F.col("scorer") == scorer)
    by_tag = players.where(F.col("tag") == scorer) if scorer else players.where(F.col("team") == team)
    if scorer and by_tag.isEmpty():
        by_tag = players.where(F.col("name") == scorer)
        if by_tag.limit(2).count() != 1:
            raise SchemaError(f"the roster names {scorer} not once")
    tags = by_tag.select("tag")
    return confirmed.join(assignments.join(tags, "tag", "left_semi").select("key"), "key", "left_semi")


def score_chain(chain: DataFrame, frames: DataFrame) -> DataFrame:
    """(goal, fid, frame, box, score, team) of chained boxes (goal, fid, frame, box) whose frame could be read: ``frames`` has
    (fid, frame, sharpness, black, white), null where it could not."""
    seen = frames.where("sharpness IS NOT NULL").select("fid", "frame", F.col("sharpness").alias("score"), crop_team(F.col("black"), F.col("white")).alias("team"))
    return chain.select("goal", "fid", "frame", "box").join(seen, ["fid", "frame"])


def process_goals(goals: DataFrame, caches: DataFrame, located: DataFrame, chain: DataFrame, frames: DataFrame, *, crops: int = 4, spacing: int = 3, gate: Column | None = None) -> DataFrame:
    """(goal, status, reason, picked, team): what becomes of each goal (fid, goal) on the way from detections to crops.

    ``caches`` are the readable files (fid), ``located`` the scorers' places (goal, reason, frame), ``chain`` the boxes
    followed from there and ``frames`` what is known of the pictures.  A goal is skipped for a missing cache, a location
    without result, a missing or unreadable frame, or because the gate holds none of its frames good; frames of the
    opposite team are left out before the best ones are picked, best first.
    """
    placed = goals.select("goal", "fid").join(caches.select("fid").distinct().withColumn("__cache", F.lit(True)), "fid", "left")
    placed = placed.join(located.select("goal", "reason", "frame"), "goal", "left")
    pictures = frames.select("fid", "frame", F.lit(True).alias("__frame"), F.col("sharpness").isNotNull().alias("__read"), crop_team(F.col("black"), F.col("white")).alias("__seed"))
    placed = placed.join(pictures, ["fid", "frame"], "left")
    reason = F.when(F.col("__cache").isNull(), "missing_cache").when(F.coalesce("reason", F.lit("no_track")) != "", F.coalesce("reason", F.lit("no_track")))
    reason = reason.when(F.col("__frame").isNull(), "missing_frame").when(~F.col("__read"), "decode_failed").otherwise("")
    placed = staged(placed.select("goal", "fid", F.col("frame").alias("seed"), reason.alias("reason"), F.col("__seed").alias("seed_team")), "goals-placed")
    scored = score_chain(chain.join(placed.where("reason = ''").select("goal", "seed"), "goal"), frames).join(placed.select("goal", "seed"), "goal")
    own = folds.drop_opposite(scored, keys=["goal"], seed_frame="seed", team="team", pairs={BLACK: WHITE, WHITE: BLACK})
    picked = folds.pick_spaced(own.select("goal", "frame", "score", "team", "box"), keys=["goal"], n=crops, spacing=spacing, gate=F.lit(True) if gate is None else gate)
    best = picked.groupBy("goal").agg(F.array_sort(F.collect_list(F.struct("rank", "frame"))).alias("p"))
    out = placed.join(best, "goal", "left").withColumn("reason", F.when((F.col("reason") == "") & F.col("p").isNull(), "quality_gate").otherwise(F.col("reason")))
    ok = F.col("reason") == ""
    return out.select("goal", F.when(ok, "OK").otherwise("SKIP").alias("status"), "reason", F.when(ok, F.transform("p", lambda x: x["frame"])).alias("picked"), F.when(ok, F.col("seed_team")).alias("team"))


def label_page(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Events of the labelling page, each with its likely rally (grp, members) if it is in one."""
    return events.join(groups.select("key", "grp", "members"), "key", "left")


def photo_page(candidates: DataFrame) -> DataFrame:
    """(id, img, v, t, s) of the photo page: candidates that are fine and have a picture; scores with two decimals."""
    good = (F.col("status") == "ok") & (F.coalesce("image", F.lit("")) != "")
    return candidates.where(good).select("id", F.col("image").alias("img"), F.col("video_no").cast("int").alias("v"), F.col("sec").cast("double").alias("t"), F.format_string("%.2f", F.col("score").cast("double")).alias("s"))


def truth_of(assignments: DataFrame, players: DataFrame) -> DataFrame:
    """(key, truth): a numbered player of ours, one without number, or not judgeable; NOGOAL rows are left out."""
    known = assignments.where(F.col("tag") != NO_GOAL).join(players.select("tag", "team"), "tag", "left")
    team = F.coalesce("team", team_of(F.col("tag")))
    truth = F.when(team.isin(OPPONENT, CASUAL), "unjudgeable").when(F.col("tag").rlike(r"\d"), "ours_numbered").otherwise("no_number")
    return known.select("key", truth.alias("truth"))


def heat_report(landings: DataFrame, zones: DataFrame) -> DataFrame:
    """(team, zone, n, share, shade) of landings (team, x, y, hoop_x, hoop_y, box_h): the hoop's median x over all goals
    says which end a goal belongs to, so it is computed before any point is placed."""
    mid = landings.agg(F.percentile("hoop_x", F.lit(0.5)).alias("mid"))
    m = geo.to_court(F.col("x"), F.col("y"), F.col("hoop_x"), F.col("hoop_y"), F.col("box_h"), F.col("hoop_x") > F.col("mid"))
    placed = landings.crossJoin(F.broadcast(mid)).select("team", m["x"].alias("cx"), m["y"].alias("cy"))  # one row
    inside = placed.where(geo.in_court(F.col("cx"), F.col("cy"))).select("team", geo.zone_of(F.col("cx"), F.col("cy")).alias("zone"))
    return landing.zone_shares(inside, zones, by="team")


def stage_of(flags: DataFrame) -> DataFrame:
    """(session, stage): the furthest stage whose flag is set."""
    rank = F.greatest(*[F.when(F.coalesce(s, F.lit(False)), F.lit(k)).otherwise(0) for k, s in enumerate(STAGES) if k])
    return flags.select("session", F.element_at(F.array(*[F.lit(s) for s in STAGES]), rank + 1).alias("stage"))


def resume(spark: SparkSession, path: str, make, *, valid=None) -> DataFrame:
    """A stage's table from ``path`` if it is there and valid, else made and written."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        have = spark.read.parquet(path)
        if valid is None or valid(have):
            return have
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def evaluate_adoption(top: DataFrame, truth: DataFrame, *, threshold: float, margin: float) -> DataFrame:
    """Rates of gated winners (key, winner, score, margin) against the truth (key, number)."""
    pairs = staged(truth.join(top, "key", "left"), "evaluation")
    gate = F.coalesce(F.col("winner").isNotNull() & (F.col("score") >= threshold) & (F.col("margin") >= margin), F.lit(False))
    return votes.rates(pairs, positive=F.col("number").isNotNull(), adopted_=gate, right=F.coalesce(F.col("winner") == F.col("number"), F.lit(False)))
