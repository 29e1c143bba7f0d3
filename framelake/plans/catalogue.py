"""The registered queries: every operator on the test tables, with thresholds that suit their density."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import geometry as geo
from framelake.functions import keys as k
from framelake.functions import plugins
from framelake.operators import clustering, folds, joins, landing, merges, segments, tracking, votes
from framelake.sources import sinks
from framelake.sources.scans import detections_of_events
from framelake.sources.sinks import clip_segments
from framelake.streaming import tasks

from . import sessions
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def det(spark: SparkSession, sf: str, role: str | None = None) -> DataFrame:
    rows = detections_of_events(table(spark, sf, "events"))
    return rows if role is None else rows.where(F.col("role") == role)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def boxed(df: DataFrame, half: int = 300) -> DataFrame:
    return df.withColumns({"x1": F.col("cx") - half, "y1": F.col("cy") - half, "x2": F.col("cx") + half, "y2": F.col("cy") + half})


# --- segments -----------------------------------------------------------------------------------------------------


@query
def static_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.static_candidates(det(spark, sf), track=["fid"], max_move=900, dead_ds=3000)
    out = out.withColumn("ac", F.floor(F.col("ac") * 1000 + 1e-6) / 1000)  # a mean cut to three digits does not hang on the order of its sum
    return longs(out, "t0_ds", "dur_ds", "cx", "cy", "n", "seg")


@query
def stable_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.stable_segments(det(spark, sf), keys=["fid"], max_gap=30, max_step=900.0)
    return out.groupBy("fid", "seg").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query
def frame_argmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = det(spark, sf).withColumn("day", F.floor(F.col("frame") / 120))
    return segments.frame_best(rows, keys=["fid", "day"], least_conf=0.35).select("fid", "day", "det", F.round("conf", 6).alias("conf"))


@query
def rally_groups(spark: SparkSession, sf: str) -> DataFrame:
    goals = det(spark, sf, "purchase")
    out = segments.overlap_groups(goals, keys=["fid"], start=F.col("frame") - 10, end=F.col("frame") + 20, order=["frame", "det"])
    return out.select("fid", "det", "grp", "members")


@query
def impact_score(spark: SparkSession, sf: str) -> DataFrame:
    """Day frames: hoop nearness, box size, ball speed, nearness of a person and height."""
    day = det(spark, sf).withColumn("day", F.floor(F.col("frame") / 120))
    ball = segments.frame_best(day.where("role = 'view'"), keys=["fid", "day"], least_conf=0.05).select("fid", "day", "cx", "cy")
    spine = day.groupBy("fid").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("fid", F.explode(F.sequence("a", "b")).alias("day"))
    w = Window.partitionBy("fid").orderBy("day")
    rows = spine.join(ball, ["fid", "day"], "left").withColumn("px", F.lag("cx").over(w)).withColumn("py", F.lag("cy").over(w))
    people = boxed(day.where("role = 'click'")).select("fid", "day", F.struct("x1", "y1", "x2", "y2").alias("b"))
    near = rows.join(people, ["fid", "day"]).groupBy("fid", "day").agg(F.min(geo.distance_to_box(F.col("cx"), F.col("cy"), F.col("b"))).alias("gap"), F.max(geo.area(F.col("b"))).alias("area"))
    hoops = day.where("role = 'signup'").select("fid", F.col("day").alias("hday"), F.col("cx").alias("hx"), F.col("cy").alias("hy"))
    hoop = joins.range_join(rows.select("fid", "day", "cx", "cy").where("cx IS NOT NULL"), hoops, keys=["fid"], at="day", low=F.col("hday") - 1, high=F.col("hday") + 1, width=3)
    hoop = hoop.groupBy("fid", "day").agg(F.max(F.greatest(F.lit(0.0), 1 - geo.distance(F.col("cx"), F.col("cy"), F.col("hx"), F.col("hy")) / 400)).alias("hoop"))
    full = rows.join(near, ["fid", "day"], "left").join(hoop, ["fid", "day"], "left")
    speed = F.coalesce(geo.clamp(geo.distance(F.col("cx"), F.col("cy"), F.col("px"), F.col("py")) / 300, 0.0, 1.0), F.lit(0.0))
    score = 0.35 * F.coalesce("hoop", F.lit(0.0)) + 0.20 * F.coalesce(geo.clamp(F.col("area") / (0.12 * 1920 * 1080), 0.0, 1.0), F.lit(0.0)) + 0.20 * speed
    score = score + 0.15 * F.coalesce(geo.clamp(1 - F.col("gap") / 400, 0.0, 1.0), F.lit(0.0)) + 0.10 * F.coalesce(geo.clamp(1 - F.col("cy") / 1080, 0.0, 1.0), F.lit(0.0))
    return full.select("fid", "day", F.round(score, 6).alias("score"))


@query
def running_offset(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return segments.running_offset(orders, keys=["o_custkey"], order=["o_orderkey"], value="cents").select("o_orderkey", F.col("offset").cast("long").alias("offset"))


@query
def batches(spark: SparkSession, sf: str) -> DataFrame:
    return segments.chunks(table(spark, sf, "documents").select("doc_id", "source"), keys=["source"], order=["doc_id"], size=50)


@query
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.even_sample(table(spark, sf, "documents").select("doc_id", "source"), keys=["source"], order=["doc_id"], n=7)
    return out.select("source", "doc_id", F.col("slot").cast("long").alias("slot"))


@query
def gap_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    best = segments.frame_best(det(spark, sf), keys=["fid", "frame"])
    return segments.fill_gaps(best, keys=["fid"], most=3)


@query
def clip_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf, "purchase")
    a, b = geo.clip_window(F.col("frame") * 2, F.col("frame") * 2 + 5), geo.preview_window(F.col("frame") * 2)
    return d.select("det", a["start"].alias("start_ds"), a["end"].alias("end_ds"), b["start"].alias("preview_start"), b["end"].alias("preview_end"))


@query
def clip_segment_plan(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf, "purchase")
    files = table(spark, sf, "events").groupBy(F.col("user_id").cast("long").alias("fid")).agg(F.lit(7000).cast("long").alias("duration"))
    clips = d.select("det", "fid", (F.col("frame") * 2 - 20).alias("start"), (F.col("frame") * 2 + 40).alias("end"))
    return longs(clip_segments(clips, files, clip="det", file="fid", start="start", end="end", order="fid", duration="duration"), "part", "start", "end")


@query
def crop_boxes(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).groupBy("fid").agg(F.collect_list(F.struct("cx", "cy")).alias("points"), F.max(F.struct("conf", (-F.col("det")).alias("o"), "cx", "cy")).alias("best"))
    a = geo.adaptive_crop(F.col("points"), F.lit(3840), F.lit(2160))
    b = geo.square_crop(F.col("best.cx") * 2, F.col("best.cy") * 2, F.lit(1200), F.lit(3840), F.lit(2160))
    return longs(d.select("fid", a["crop_x"].alias("ax"), a["crop_y"].alias("ay"), a["side"].alias("side"), b["crop_x"].alias("bx"), b["crop_y"].alias("by")), "ax", "ay", "side", "bx", "by")


# --- joins --------------------------------------------------------------------------------------------------------


@query
def rejoin_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.rejoin_pairs(det(spark, sf), keys=["fid"], low=15, high=70, reach=800, void=250, least_conf=0.1, before=60, before_reach=900, after=60, after_reach=900)
    mid = lambda c: F.floor((F.col(f"a_{c}") + F.col(f"b_{c}")) / 2)
    return out.select("fid", F.col("a_det").alias("a"), F.col("b_det").alias("b"), mid("cx").alias("cx"), mid("cy").alias("cy"), (F.col("a_frame") + F.col("b_frame")).alias("t0_ds"))


def _goals(spark: SparkSession, sf: str) -> DataFrame:
    return det(spark, sf, "purchase").select("fid", F.col("det").alias("goal"), F.col("frame").alias("anchor"), F.col("cx").alias("gx"), F.col("cy").alias("gy"))


@query
def asof_candidate(spark: SparkSession, sf: str) -> DataFrame:
    views = det(spark, sf, "view").select("fid", F.col("frame").alias("vframe"), F.col("det").alias("view"))
    return joins.asof(_goals(spark, sf), views, keys=["fid"], left_id="goal", at="anchor", right_at="vframe", right_order="view", tolerance=10).select("goal", "view", F.abs(F.col("vframe") - F.col("anchor")).alias("dt"))


@query
def asof_clip(spark: SparkSession, sf: str) -> DataFrame:
    clips = det(spark, sf, "click").select("fid", F.col("frame").alias("cframe"), F.col("det").alias("clip"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("wide-"), F.col("det").cast("string"))).alias("wide"))
    out = joins.asof(_goals(spark, sf), clips, keys=["fid"], left_id="goal", at="anchor", right_at="cframe", right_order="clip", tolerance=40)
    return out.select("goal", F.coalesce("wide", F.concat(F.lit("clip-"), F.col("clip").cast("string"))).alias("file"))


def _hoops(spark: SparkSession, sf: str) -> DataFrame:
    return det(spark, sf, "signup").select("fid", F.col("det").alias("hoop"), (F.col("frame") - 30).alias("w0"), (F.col("frame") + 30).alias("w1"), F.col("cx").alias("hx"), F.col("cy").alias("hy"))


@query
def containing_window(spark: SparkSession, sf: str) -> DataFrame:
    return joins.containing(_goals(spark, sf), _hoops(spark, sf), keys=["fid"], point_id="goal", at="anchor", low="w0", high="w1", order="hoop", width=60).select("goal", "hoop")


@query
def window_degrade(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.greatest(F.col("w0") - F.col("anchor"), F.col("anchor") - F.col("w1"), F.lit(0))
    d = geo.distance(F.col("gx"), F.col("gy"), F.col("hx"), F.col("hy"))
    out = joins.containing_or_any(_goals(spark, sf), _hoops(spark, sf), keys=["fid"], point_id="goal", at="anchor", low="w0", high="w1", slack=5, gap=gap, order=[d, F.col("hx"), F.col("hy"), F.col("hoop")])
    return out.select("goal", "hoop", "degraded")


@query
def goal_boost(spark: SparkSession, sf: str) -> DataFrame:
    views = det(spark, sf, "view").select("fid", F.col("det").alias("row"), "frame", F.col("conf").alias("score"))
    anchors = _goals(spark, sf).select("fid", "goal", "anchor")
    out = joins.boosted(views, anchors, keys=["fid"], row_id="row", at="frame", anchor_id="goal", anchor_at="anchor", window=10, factor=1.5, order=[F.desc("score"), F.col("frame"), F.col("row")])
    return out.select("row", F.round("score", 6).alias("score"), "forced")


def _person_days(spark: SparkSession, sf: str) -> DataFrame:
    d = boxed(det(spark, sf, "click")).withColumn("day", F.floor(F.col("frame") / 120))
    return d.select("fid", "day", F.col("det").alias("box"), F.struct("x1", "y1", "x2", "y2").alias("b"))


@query
def last_holder(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user the last ball inside a person box of the same day."""
    balls = det(spark, sf, "view").withColumn("day", F.floor(F.col("frame") / 120))
    held = balls.join(_person_days(spark, sf), ["fid", "day"]).where(geo.inside(F.col("cx"), F.col("cy"), F.col("b")))
    return joins.nearest(held, by=["fid"], order=[F.desc("frame"), F.col("det"), F.col("box")]).select("fid", "det", "box")


@query
def box_iou_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """For each ball box the best overlapping person box of its day, and none under 0.3."""
    balls = boxed(det(spark, sf, "view")).withColumn("day", F.floor(F.col("frame") / 120)).select("fid", "day", "det", F.struct("x1", "y1", "x2", "y2").alias("a"))
    best = joins.best_match(balls.join(_person_days(spark, sf), ["fid", "day"]), by=["det"], score=geo.iou(F.col("a"), F.col("b")), least=0.3, order=[F.col("box")])
    return best.select("det", "box", F.round("score", 6).alias("iou"))


@query
def unlinked_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return det(spark, sf, "view").select("det").join(box_iou_argmax(spark, sf), "det", "left_anti")


@query
def held_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Small ball boxes covered by over half by a person box of their day."""
    balls = boxed(det(spark, sf, "view"), 10).withColumn("day", F.floor(F.col("frame") / 120)).select("fid", "day", "det", F.struct("x1", "y1", "x2", "y2").alias("a"))
    pairs = balls.join(_person_days(spark, sf), ["fid", "day"])
    return pairs.groupBy("det").agg(F.round(F.max(geo.coverage(F.col("a"), F.col("b"))), 6).alias("coverage")).where("coverage > 0.5")


@query
def number_regex(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes found as whole numbers in part names with the size appended; unique matches and ambiguous ones."""
    parts = table(spark, sf, "part")
    tags = parts.select(F.col("p_partkey").alias("tag_key"), F.concat(F.lit("#"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_brand")).alias("tag"))
    numbers = parts.select(F.col("p_size").cast("string").alias("number")).distinct()
    hits = k.standalone_numbers(tags, "tag").join(numbers, "number")  # a number stands alone where it is a whole run of digits
    return hits.groupBy("number").agg(F.count("*").alias("matches"), F.min("tag_key").alias("first_match"))


@query
def fuzzy_names(spark: SparkSession, sf: str) -> DataFrame:
    return joins.one_letter_apart(table(spark, sf, "part"), "p_name")


@query
def roster_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """A query string names a tag first and a name second; ambiguous ones resolve to nobody."""
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("tag"), F.col("c_mktsegment").alias("name"))
    asked = table(spark, sf, "customer").select(F.col("c_name").alias("q")).union(table(spark, sf, "customer").select("c_mktsegment").distinct()).distinct()
    by_tag = asked.join(people, F.col("q") == F.col("tag")).select("q", F.lit(1).alias("p"), "id")
    by_name = asked.join(people, F.col("q") == F.col("name")).select("q", F.lit(2).alias("p"), "id")
    hits = by_tag.union(by_name).withColumn("__p", F.min("p").over(Window.partitionBy("q"))).where("p = __p")
    return hits.groupBy("q").agg(F.when(F.count("*") == 1, F.max("id")).alias("id"), F.max("p").cast("long").alias("rule"))


@query
def team_select(spark: SparkSession, sf: str) -> DataFrame:
    """Goals (orders) of players (customers) of one team (nation)."""
    orders, people = table(spark, sf, "orders"), table(spark, sf, "customer")
    goals = orders.select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("rejected").alias("status"), F.lit("").alias("scorer"))
    players = people.select(F.col("c_custkey").cast("string").alias("tag"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("team"))
    assigned = orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("tag"))
    return sessions.select_goals(goals, assigned, players, team="3").select("o_orderkey", "o_custkey")


@query
def hit_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Teams with a confirmed goal, in the order of their first player."""
    goals = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    hit = table(spark, sf, "customer").join(goals, "c_custkey", "left_semi")
    teams = hit.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first_player"), F.count("*").alias("players"))
    return teams.withColumn("position", F.row_number().over(Window.orderBy("first_player")).cast("long"))  # one row a nation


@query
def fact_diff(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2).cast("long").alias("quality"))
    b = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return joins.fact_diff(a, b, key="doc_id", columns=["quality"])


@query
def coverage_anti(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey")
    found = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    valid = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.coverage_split(c, found, valid, "c_custkey")


@query
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Answers keyed by conversation and turn, read by prefix."""
    said = table(spark, sf, "conversations")
    answer = F.when(F.length("text") % 5 == 0, "YES").when(F.length("text") % 5 == 1, "UNCLEAR").otherwise("NO")
    answers = said.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("@"), F.col("turn").cast("string")).alias("akey"), answer.alias("answer"))
    items = said.select("conv_id").distinct().withColumn("prefix", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("@")))
    return joins.verdicts(items, answers, item="conv_id", prefix="prefix", key="akey", answer="answer")


# --- vectors, votes, evaluation -------------------------------------------------------------------------------------


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    gallery = e.where("vec_id % 5 = 0").select(F.col("label").cast("long").alias("number"), F.col("embedding").alias("vec"))
    probes = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("vec"))
    return votes.max_similarity(probes, gallery, probe="probe", label="number", digits=5)


@query
def max_sim(spark: SparkSession, sf: str) -> DataFrame:
    return _probes(spark, sf)


@query
def max_sim_top2(spark: SparkSession, sf: str) -> DataFrame:
    out = votes.top_two(_probes(spark, sf), by="probe", label="number")
    return out.withColumn("margin", F.round("margin", 5))


@query
def adopted(spark: SparkSession, sf: str) -> DataFrame:
    return votes.adopted(votes.top_two(_probes(spark, sf), by="probe", label="number"), threshold=0.30).select("probe", "winner", "score")


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    top = votes.top_two(_probes(spark, sf), by="probe", label="number").select("probe", "winner")
    truth = table(spark, sf, "embeddings").select(F.col("vec_id").alias("probe"), F.col("label").cast("long").alias("truth"))
    return votes.confusion(top.join(truth, "probe"), truth="truth", predicted="winner")


@query
def rates(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return votes.rates(lab, positive=F.col("quality") == 1, adopted_=F.col("lang") == "en", right=F.col("toxic") == 0)


@query
def knn_components(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("block"), "embedding")
    return clustering.single_linkage(e, id_="vec_id", vec="embedding", threshold=0.62, block="block")


@query
def goal_mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("goal"), F.col("embedding").alias("vec"))
    out = votes.mean_vector(e, by=["goal"])
    return out.select("goal", F.posexplode("vec").alias("i", "x")).select("goal", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@query
def majority_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return votes.majority(det(spark, sf), by=["fid"], value="role", order="det")


@query
def purity(spark: SparkSession, sf: str) -> DataFrame:
    return votes.purity(votes.majority(table(spark, sf, "documents"), by=["source"], value="lang", order="doc_id"))


@query
def rule_vote(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).withColumn("day", F.floor(F.col("frame") / 120)).withColumn("guess", F.col("k") % 7)
    return votes.rule_vote(d, by=["fid", "day"], value="guess", high=F.col("conf") > 0.6, order="det")


@query
def seeded_propagation(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).withColumn("track", F.floor(F.col("frame") / 120)).withColumn("label", F.when(F.col("k") < 60, F.col("role")))
    return votes.seeded_evaluation(d, track=["fid", "track"], order="det", label="label")


@query
def track_prefill(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).withColumn("track", F.floor(F.col("frame") / 120)).withColumn("label", F.when(F.col("k") < 60, F.col("role")))
    return votes.propagate(d, track=["fid", "track"], key="det", label="label", mixed=F.col("track") % 9 == 0)


@query
def cluster_representatives(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).withColumn("s", F.when(F.col("k") % 4 > 0, k.rounded(F.col("conf"), 3)))
    return votes.representatives(d, cluster="fid", score="s", order="det").select("fid", "det")


@query
def unique_majority(spark: SparkSession, sf: str) -> DataFrame:
    return votes.unique_majority(det(spark, sf), by=["fid"], value="role")


@query
def color_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth frame of a track from its first votes black or white; mixed under a majority of 0.6."""
    d = det(spark, sf).withColumn("first", F.min("frame").over(Window.partitionBy("fid"))).where((F.col("frame") - F.col("first")) % 5 == 0)
    per = d.groupBy("fid").agg(F.count_if(F.col("role") == "view").alias("black"), F.count_if(F.col("role") == "click").alias("white"))
    return per.withColumn("mixed", (F.col("black") + F.col("white") > 0) & (F.greatest("black", "white") / (F.col("black") + F.col("white")) < 0.6))


# --- court ------------------------------------------------------------------------------------------------------------


def _court(spark: SparkSession, sf: str) -> DataFrame:
    goals = det(spark, sf, "purchase").withColumn("team", F.col("fid") % 3)
    mid = goals.agg(F.percentile("cx", F.lit(0.5)).alias("mid"))  # one row
    rows = goals.crossJoin(F.broadcast(mid))
    m = geo.to_court(F.col("cx"), F.col("cy"), F.lit(960), F.lit(250), F.lit(120) + F.col("k"), F.col("cx") > F.col("mid"))
    return rows.select("det", "team", (F.col("cx") > F.col("mid")).alias("flipped"), F.round(m["x"], 6).alias("x"), F.round(m["y"], 6).alias("y"))


@query
def median_flip(spark: SparkSession, sf: str) -> DataFrame:
    return _court(spark, sf).where(geo.in_court(F.col("x"), F.col("y")))


@query
def court_zones(spark: SparkSession, sf: str) -> DataFrame:
    return _court(spark, sf).select("det", geo.zone_of(F.col("x"), F.col("y")).alias("zone"))


@query
def zone_share(spark: SparkSession, sf: str) -> DataFrame:
    names = ["ra", "paint", "mid_l", "mid_c", "mid_r", "corner_l", "corner_r", "p45_l", "p45_r", "top"]
    zones = spark.range(1).select(F.explode(F.array(*[F.lit(z) for z in names])).alias("zone"))
    points = _court(spark, sf).where(geo.in_court(F.col("x"), F.col("y"))).select("team", geo.zone_of(F.col("x"), F.col("y")).alias("zone"))
    return landing.zone_shares(points, zones, by="team")


@query
def kde(spark: SparkSession, sf: str) -> DataFrame:
    grid = spark.range(-8, 9).select((F.col("id") * 1.0).alias("gx")).crossJoin(spark.range(-2, 13).select((F.col("id") * 1.0).alias("gy")))
    points = _court(spark, sf).where(geo.in_court(F.col("x"), F.col("y"))).select("team", "x", "y")
    return landing.density_grid(points, grid, by=["team"], digits=6)


# --- folds --------------------------------------------------------------------------------------------------------------


def _cands(spark: SparkSession, sf: str) -> DataFrame:
    return det(spark, sf).select("fid", (F.col("frame") * 2).alias("t0"), F.col("det").alias("ord"), "cx", "cy", F.when(F.col("k") % 3 == 0, F.col("cy")).alias("hx"), F.when(F.col("k") % 3 == 0, F.col("cx")).alias("hy"))


@query
def event_islands(spark: SparkSession, sf: str) -> DataFrame:
    return folds.cluster_events(_cands(spark, sf), keys=["fid"], gap=60, chain=1400, wide_gap=180, near=700, span=None).select("fid", F.col("ord").alias("det"), "event")


@query
def event_clusters(spark: SparkSession, sf: str) -> DataFrame:
    out = folds.cluster_events(_cands(spark, sf), keys=["fid"], gap=60, chain=1400, wide_gap=180, near=700, span=150)
    return out.groupBy("fid", "event").agg(F.count("*").alias("n"), F.min("t0").alias("first_ds"), F.max("t0").alias("last_ds"), F.max_by("ord", F.struct("t0", "ord")).alias("anchor"))


@query
def merge_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    static = segments.static_candidates(det(spark, sf), track=["fid"], max_move=900, dead_ds=3000).select("fid", F.col("t0_ds").alias("t0"), "cx", "cy")
    rejoin = rejoin_pairs(spark, sf).select("fid", F.col("t0_ds").alias("t0"), "cx", "cy", F.col("a").alias("rid"))
    return folds.merge_candidates(static, rejoin, keys=["fid"], time=150, reach=600.0)


@query
def pick_best_frames(spark: SparkSession, sf: str) -> DataFrame:
    best = segments.frame_best(det(spark, sf), keys=["fid", "frame"]).select("fid", "frame", k.rounded(F.col("conf"), 3).alias("score"), "k")
    out = folds.pick_spaced(best, keys=["fid"], n=3, spacing=100, gate=F.col("k") >= 10)
    return out.select("fid", F.col("rank").cast("long").alias("rank"), "frame")


@query
def opposite_guard(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).withColumn("seed_frame", F.min("frame").over(Window.partitionBy("fid")))
    return folds.drop_opposite(d, keys=["fid"], seed_frame="seed_frame", team="role", pairs={"view": "click", "click": "view"}).select("fid", "det")


@query
def bucket_pick(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).select("fid", "frame", "det", k.rounded(F.col("conf"), 3).alias("score"), "k")
    out = segments.bucket_pick(d, keys=["fid"], bucket=F.floor(F.col("frame") / 600), order=["-score", "frame", "det"], total=8, forced=F.col("k") == 7)
    return out.select("fid", "det")


@query
def same_track_fill(spark: SparkSession, sf: str) -> DataFrame:
    """An assignment reaches the unassigned rows of its track that have no prefill; the latest assignment counts."""
    d = det(spark, sf).withColumn("track", F.floor(F.col("frame") / 120)).withColumn("tag", F.when(F.col("k") < 20, F.col("role"))).withColumn("prefill", F.when(F.col("k") >= 70, F.lit("p")))
    newest = joins.nearest(d.where("tag IS NOT NULL"), by=["fid", "track"], order=[F.desc("det")]).select("fid", "track", F.col("tag").alias("given"))
    out = d.join(newest, ["fid", "track"], "left")
    return out.select("det", F.coalesce("tag", F.when(F.col("prefill").isNull(), F.col("given"))).alias("tag"))


@query
def union_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups merged by pointers from each part to the next of its brand and size."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("child"), "p_brand", "p_size")
    merged = parts.withColumn("parent", F.lead("child").over(Window.partitionBy("p_brand", "p_size").orderBy("child"))).where("parent IS NOT NULL").select("child", "parent")
    return merges.group_roots(merged, parts, child="child", parent="parent")


# --- merges --------------------------------------------------------------------------------------------------------------


def _halves(spark: SparkSession, sf: str) -> list[DataFrame]:
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.round(F.col("l_quantity") * 1_000_000 + F.col("l_partkey") * 7 + F.col("l_suppkey")).cast("long").alias("v"))
    rows = rows.groupBy("l_orderkey", "line", "v").agg(F.count("*").alias("n"))
    return [rows.where("v % 2 = 0"), rows.where("v % 2 <> 0")]


@query
def last_writer(spark: SparkSession, sf: str) -> DataFrame:
    return merges.last_writer(_halves(spark, sf), key=["l_orderkey", "line"], order="v").select("l_orderkey", "line", "v", F.col("part").cast("long").alias("part"))


def _statuses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    return o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("v")), o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("v"))


@query
def conflict_check(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _statuses(spark, sf)
    return merges.conflicts(a, b, key="o_orderkey", value="v")


@query
def priority_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _statuses(spark, sf)
    return merges.priority_union(a, b, key="o_orderkey", value="v")


@query
def overlay_merge(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _statuses(spark, sf)
    names = spark.sql("SELECT * FROM VALUES ('F', 'done'), ('O', 'open') AS n(v, new_tag)")
    return merges.overlay(a, b, names, key="o_orderkey", tag="v")


@query
def cache_rekey(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("long").alias("value"))
    mapping = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.md5(F.col("n_name").cast("binary")).alias("digest"))
    return merges.rekey(n, mapping, old="key", new="digest", value="value")


@query
def roster_export(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).select("det", F.when(F.col("k") < 50, F.col("role")).when(F.col("k") < 55, F.lit("SKIP")).when(F.col("k") < 60, F.lit("NOGOAL")).otherwise("late").alias("tag"))
    players = spark.sql("SELECT * FROM VALUES ('view'), ('bench'), ('opponent') AS p(tag)")
    return merges.roster_export(d, players, key="det", tag="tag", drop_tag="NOGOAL", skip_tag="SKIP", pseudo="opponent")


@query
def bulk_accept(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).select("det", "role", "k", F.when(F.col("k") < 20, F.lit("set")).alias("tag"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("p"), F.col("k").cast("string"))).alias("prefill"))
    return merges.bulk_accept(d, tag="tag", prefill="prefill", touched=F.col("k") > 90, team="role", black="error", opponent="opponent").select("det", "tag")


@query
def goal_export(spark: SparkSession, sf: str) -> DataFrame:
    marks = det(spark, sf).select(F.col("det").alias("event"), F.when(F.col("k") % 3 == 0, F.col("frame") * 2 + 3).alias("human_anchor"), (F.col("frame") * 2).alias("machine_anchor"), F.when(F.col("role") == "purchase", "goal").when(F.col("role") == "error", "practice").alias("mark"))
    return merges.goal_export(marks)


@query
def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).select("det", F.when(F.col("k") < 30, F.lit("x")).alias("tag"), F.when(F.col("k") < 80, F.col("fid")).alias("grp"), "k")
    groups = det(spark, sf).groupBy(F.col("fid").alias("grp")).agg(F.min("k").alias("least"))
    return merges.work_queue(d, groups, key="det", tag="tag", group="grp", ejected=F.col("k") % 11 == 0, pending=F.col("least") > 1)


@query
def multi_positive_groups(spark: SparkSession, sf: str) -> DataFrame:
    goals = det(spark, sf, "purchase")
    groups = segments.overlap_groups(goals, keys=["fid"], start=F.col("frame") - 10, end=F.col("frame") + 20, order=["frame", "det"])
    return groups.groupBy("fid", "grp").agg(F.count_if(F.col("k") < 70).alias("marked")).where("marked >= 2")


@query
def verbatim_concat(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _statuses(spark, sf)
    return sinks.concat_batches([a, b]).groupBy(F.col("batch").cast("long").alias("batch"), "v").agg(F.count("*").alias("n"))


# --- order, expectations, keys --------------------------------------------------------------------------------------------


@query
def nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf, "purchase").select("fid", "det", F.when(F.col("k") % 4 > 0, F.col("cx")).alias("dist"))
    return d.withColumn("position", F.row_number().over(Window.partitionBy("fid").orderBy(F.asc_nulls_last("dist"), "det")).cast("long"))


@query
def next_file(spark: SparkSession, sf: str) -> DataFrame:
    return segments.next_row(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), keys=["o_custkey"], order=["o_orderkey"], column="o_orderkey", name="next_key")


@query
def keymap(spark: SparkSession, sf: str) -> DataFrame:
    """Players (customers) of each team (nation) in order; the first ones have a key."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", k.player_key(F.row_number().over(w)).alias("key"))


@query
def summary_order(spark: SparkSession, sf: str) -> DataFrame:
    groups = det(spark, sf).groupBy("fid").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"))
    # one row a user: groups are ranked by size, then by their first frame
    return groups.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "first_frame", "fid")).cast("long"))


@query
def gt_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Goals as truth against views: HIT within 10 frames, WEAK within 20, else MISS; and precision."""
    views = det(spark, sf, "view").select("fid", F.col("frame").alias("vframe"), F.col("det").alias("view"))
    near = joins.asof(_goals(spark, sf), views, keys=["fid"], left_id="goal", at="anchor", right_at="vframe", right_order="view", tolerance=20).select("goal", F.abs(F.col("vframe") - F.col("anchor")).alias("dt"))
    status = F.when(F.col("dt") <= 10, "HIT").when(F.col("dt") <= 20, "WEAK").otherwise("MISS")
    return _goals(spark, sf).join(near, "goal", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query
def scale_check(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes beyond the image by more than one per cent, by user."""
    d = boxed(det(spark, sf, "click"))
    bad = (F.col("x1") < -19.2) | (F.col("y1") < -10.8) | (F.col("x2") > 1939.2) | (F.col("y2") > 1090.8)
    return d.groupBy("fid").agg(F.count_if(bad).alias("violations"), F.min(F.when(bad, F.col("det"))).alias("first_violation"))


@query
def stage_case(spark: SparkSession, sf: str) -> DataFrame:
    """The furthest stage of a session from the kinds of rows it has."""
    made = {"candidates": "click", "goals": "signup", "roster": "purchase", "roster_confirmed": "view", "output": "error"}
    seen = [F.max((F.col("role") == r) & (F.col("k") < 20 + 10 * n)).alias(stage) for n, (stage, r) in enumerate(made.items())]
    flags = det(spark, sf).groupBy(F.concat_ws("-", "fid", F.floor(F.col("frame") / 120)).alias("session")).agg(*seen)
    return sessions.stage_of(flags.select("session", *made))


@query
def key_parsing(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    name = F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1)
    return p.select("page_id", k.stem(name).alias("stem"), k.first_number(name).alias("number"), k.goal_key(name, F.col("page_id") * 7).alias("goal_key"))


@query
def json_numbers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", k.whole_number(raw).alias("number"), k.confidence(F.when(raw.cast("int") > 50, F.lit("high")).otherwise(F.lit("other"))).alias("confidence"))


@query
def cluster_letters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", k.letters(F.col("p_partkey")).alias("tag"))


@query
def landing_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by reason and path of the release probe."""
    return release_probe(spark, sf).groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("overlapped")).alias("overlapped"))


@query
def unique_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Stems that name exactly one file."""
    name = k.stem(F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1))
    return table(spark, sf, "pages").groupBy(name.alias("stem")).agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")).where("n = 1").select("stem", "page_id")


@query
def batch_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The summaries by role, by day part and over all in one pass."""
    d = det(spark, sf).withColumn("part", F.floor(F.col("frame") / 900))
    d.createOrReplaceTempView("framelake_rollup")
    return spark.sql("SELECT role, part, count(*) AS n, sum(k) AS k_sum, count(DISTINCT fid) AS users FROM framelake_rollup GROUP BY GROUPING SETS ((role), (part), (role, part), ())")


# --- the task log ----------------------------------------------------------------------------------------------------------


@query
def task_steps(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf)
    out = tasks.step_progress(d, task="fid", order=["frame", "det"], boundary=F.col("role") == "signup", total=F.lit(12))
    return out.select("det", F.col("step").cast("long").alias("step"), "progress")


@query
def task_best(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.running_best(det(spark, sf), task="fid", order=["frame", "det"], value="k").select("det", "best")


@query
def task_states(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).select("fid", "det", F.when(F.col("k") == 99, "failed").when(F.col("k") == 98, "done").when(F.col("k") == 97, "cancelled").otherwise("log").alias("kind"), F.col("role").alias("line"))
    return tasks.terminal_states(d, task="fid", order="det", kind="kind", line="line", tail=5)


# --- grouped Python ----------------------------------------------------------------------------------------------------------


@query
def ball_tracks(spark: SparkSession, sf: str) -> DataFrame:
    out = tracking.track_balls(det(spark, sf), gate=700.0, patience=60, least=3)
    return out.groupBy("fid", "track").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def _persons(spark: SparkSession, sf: str) -> DataFrame:
    return boxed(det(spark, sf)).select("fid", "frame", F.col("det").alias("box"), "x1", "y1", "x2", "y2")


@query
def person_tracks(spark: SparkSession, sf: str) -> DataFrame:
    out = tracking.track_persons(_persons(spark, sf), max_gap=120, least_iou=0.1)
    return out.groupBy("fid", "track").agg(F.count("*").alias("n"), F.min("box").alias("first_box"))


@query
def person_chains(spark: SparkSession, sf: str) -> DataFrame:
    seeds = boxed(det(spark, sf, "purchase")).select("fid", F.col("det").alias("seed"), "frame", "x1", "y1", "x2", "y2")
    return tracking.trace_persons(_persons(spark, sf), seeds, span=60, least_iou=0.05)


@query
def hoop_tracks(spark: SparkSession, sf: str) -> DataFrame:
    events = _goals(spark, sf).select("fid", F.col("goal").alias("event"), F.col("anchor").alias("at"), F.col("gx").alias("anchor_x"), F.col("gy").alias("anchor_y"), (F.col("anchor") - 300).alias("low"), (F.col("anchor") + 300).alias("high"))
    return tracking.track_hoops(det(spark, sf, "signup"), events, max_jump=900.0)


@query
def goal_clusters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 25).alias("session"), "embedding")
    return clustering.cluster_groups(e, group="session", id_="vec_id", vec="embedding", threshold=0.9, linkage="average")


def _cascade(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    goals = _goals(spark, sf).select("fid", "goal", "anchor", F.when(F.col("goal") % 3 > 0, F.col("gx")).alias("ax"), F.when(F.col("goal") % 3 > 0, F.col("gy")).alias("ay"))
    return goals, det(spark, sf, "view"), _persons(spark, sf)


@query
def scorer_location(spark: SparkSession, sf: str) -> DataFrame:
    return landing.locate_scorers(*_cascade(spark, sf), before=200, after=20, gate=900.0, most=900.0)


@query
def goal_landing(spark: SparkSession, sf: str) -> DataFrame:
    return landing.find_landings(*_cascade(spark, sf), before=200, after=20, gate=900.0, most=900.0, held_before=2, release=5, tolerance=40, start_before=4, span=60, least_iou=0.05)


@query
def release_probe(spark: SparkSession, sf: str) -> DataFrame:
    goals, balls, persons = _cascade(spark, sf)
    return landing.probe_releases(goals, balls, persons, low=2, high=120, max_gap=60, max_step=900.0)


@query
def mined_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """From detections to numbered candidates: tracks, static stretches, rejoins, merge."""
    tracks = tracking.track_balls(det(spark, sf), gate=900.0, patience=60, least=4)
    static = segments.static_candidates(tracks, track=["fid", "track"], max_move=900, dead_ds=3000).select("fid", F.col("t0_ds").alias("t0"), "cx", "cy")
    rejoin = rejoin_pairs(spark, sf).select("fid", F.col("t0_ds").alias("t0"), "cx", "cy", F.col("a").alias("rid"))
    merged = folds.merge_candidates(static, rejoin, keys=["fid"], time=150, reach=600.0)
    return merged.withColumn("label", F.concat(F.lit("#"), F.row_number().over(Window.partitionBy("fid").orderBy("t0", "src", "cx", "cy")).cast("string")))


# --- assembly, audits and reports --------------------------------------------------------------------------------------------


@query
def page_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed goals with what is known of their scorer; a number prefills before a photo match, that before a name."""
    goals = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("number"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("photo"))
    out = goals.join(people, "c_custkey", "left").join(nations, "c_nationkey", "left")
    return out.select("o_orderkey", F.coalesce("number", "photo", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.lit("")).alias("prefill"), F.when(F.col("c_nationkey").isNull(), "SKIP").otherwise("ok").alias("status"))


@query
def gallery_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).select(F.col("fid").alias("number"), F.floor(F.col("frame") / 60).alias("photo"), F.col("det").alias("face"), F.when(F.col("k") % 10 > 0, F.col("cx") % 300).alias("w"), F.when(F.col("k") % 10 > 0, F.col("cy") % 200).alias("h"))
    d = d.withColumn("vec", F.when(F.col("w").isNotNull(), F.array(F.col("face").cast("double"))))
    return plugins.register_gallery(d, number="number", photo="photo").select("number", "photo", "verdict", F.col("vec")[0].alias("face"))


@query
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id")
    cached = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("digest")
    return plugins.only_misses(docs.select("digest"), cache=cached, key=["digest"])


@query
def truth_classes(spark: SparkSession, sf: str) -> DataFrame:
    team = F.when(F.col("c_nationkey") < 8, "对手").when(F.col("c_nationkey") < 16, "主队").otherwise("便服")
    players = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("tag"), team.alias("team")).groupBy("tag").agg(F.min("team").alias("team"))
    assigned = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 10 == 0, F.lit("NOGOAL")).when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("tag"))
    return sessions.truth_of(assigned, players)


@query
def track_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf).withColumn("track", F.floor(F.col("frame") / 120))
    return d.groupBy("fid", "track").agg(F.count("*").alias("n"), (F.min("frame") * 2).alias("start_ds"), ((F.max("frame") - F.min("frame")) * 2).alias("dur_ds"), F.floor(F.sum("cx") / F.count("*")).alias("cx"), F.floor(F.sum("cy") / F.count("*")).alias("cy"))


@query
def cluster_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters cut to the keys on the page; the first cluster keeps a key listed twice, empty ones drop out."""
    d = det(spark, sf).select("det", (F.col("k") % 12).alias("cluster"), F.col("frame").alias("anchor"))
    twice = d.unionByName(d.where("det % 5 = 0").withColumn("cluster", F.col("cluster") + 3))
    page = det(spark, sf, "purchase").select("det")
    first = joins.nearest(twice.join(page, "det", "left_semi"), by=["det"], order=[F.col("cluster")])
    rolled = first.groupBy("cluster").agg(F.count("*").alias("n"), F.min("anchor").alias("first_anchor"))
    return rolled.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "first_anchor", "cluster")).cast("long"))  # a few clusters


@query
def goal_track_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Of the views that end near a goal, the longest within 300 pixels of the nearest."""
    ends = det(spark, sf, "view").select("fid", F.col("det").alias("track"), "cx", "cy", (F.col("k") % 9 + 1).alias("length"))
    pairs = joins.within(_goals(spark, sf), ends, keys=["fid"], at=("gx", "gy"), right_at=("cx", "cy"), reach=800.0)  # beyond the limit and the slack none can be chosen
    return landing.goal_tracks(pairs.select("goal", "track", "length", "dist"), longer=True, slack=300, most=500.0).select("goal", "track", "length")


@query
def consistency_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Goals probed again with the window moved both ways: consistent where all hit and land close together."""
    goals, balls, persons = _cascade(spark, sf)
    runs = None
    for shift in (0, -8, 8):
        r = landing.probe_releases(goals.withColumn("anchor", F.col("anchor") + shift), balls, persons, low=2, high=120, max_gap=60, max_step=900.0).select("goal", F.lit(shift).alias("shift"), "reason", "land_x", "land_y")
        runs = r if runs is None else runs.unionByName(r)
    base = F.max(F.when(F.col("shift") == 0, F.struct("land_x", "land_y"))).over(Window.partitionBy("goal"))
    runs = runs.withColumn("b", base).withColumn("ok", (F.col("reason") == "") & (geo.distance(F.col("land_x"), F.col("land_y"), F.col("b.land_x"), F.col("b.land_y")) <= 100))
    return runs.groupBy("goal").agg(F.bool_and("ok").alias("consistent"), F.count_if(F.col("reason") == "").alias("hits"))


@query
def numbered_clips(spark: SparkSession, sf: str) -> DataFrame:
    goals = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    out = sinks.numbered_clips(goals, order=["o_custkey", "o_orderkey"], present=F.col("o_custkey") % 7 > 0)
    return out.select("o_orderkey", F.col("number").cast("long").alias("number"), "clip", "present")


@query
def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Fifteen rows by a hash of their key: a fixed sample without a generator's state."""
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return rows.orderBy("h", "doc_id").limit(15)


@query
def selected_photos(spark: SparkSession, sf: str) -> DataFrame:
    chosen = det(spark, sf, "signup").select(F.col("det").alias("id")).unionByName(spark.range(10_000_000, 10_000_003).select("id"))
    photos = det(spark, sf).select(F.col("det").alias("id"), F.col("fid").alias("video_no"), (F.col("frame") * 2 + 1).alias("deciseconds"))
    named, unknown = sinks.selected_photos(chosen, photos, key="id")
    return named.select("id", "file_name").unionByName(unknown.select("id", F.lit("unknown").alias("file_name")))


@query
def nested_result(spark: SparkSession, sf: str) -> DataFrame:
    out = sinks.nested(det(spark, sf, "purchase"), by="fid", order=["frame", "det"], fields=["k"])
    return out.select("fid", F.concat_ws(",", F.transform("members", lambda m: F.concat_ws(":", m["frame"], m["det"], m["k"]))).alias("members"))


@query
def team_rules(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.concat(F.element_at(F.array(F.lit("黑"), F.lit("白"), F.lit("灰T恤-")), (F.col("c_nationkey") % 3 + 1).cast("int")), F.col("c_custkey").cast("string"))
    session = F.concat(F.lit("d"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("_"), F.col("c_mktsegment"), F.lit("_x"))).otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", k.team_of(tag).alias("team"), k.opponent_of(session).alias("opponent"), k.aspect(F.col("c_nationkey") * 16 + 160, F.col("c_nationkey") * 9 + F.when(F.col("c_custkey") % 2 == 0, 90).otherwise(120)).alias("aspect"))


@query
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = det(spark, sf, "click").withColumns({"x1": F.lit(0), "y1": F.lit(0), "x2": F.col("cx") + 1, "y2": F.col("cy") + 1})
    b = F.struct("x1", "y1", "x2", "y2")
    return d.select("det", F.coalesce(plugins.gate_reason(geo.ratio_reason(b), F.col("conf")), F.lit("")).alias("reason"), plugins.crop_team(F.col("k") / 100, F.col("conf")).alias("team"))


@query
def scaled_boxes(spark: SparkSession, sf: str) -> DataFrame:
    d = boxed(det(spark, sf, "click"), 100)
    s = geo.scaled(F.struct("x1", "y1", "x2", "y2"), 1.5, 2880, 1620)
    e = geo.expanded(F.struct("x1", "y1", "x2", "y2"), 0.25, 1920, 1080)
    return d.select("det", *[s[c].alias(c) for c in geo.BOX], *[e[c].cast("long").alias("e" + c) for c in geo.BOX], geo.center_x(s).alias("scx"))


@query
def event_hoop_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's day the smallest distance of a view to the hoop window that contains it, and the last view."""
    views = det(spark, sf, "view").select("fid", F.col("det").alias("goal"), F.col("frame").alias("anchor"), F.col("cx").alias("gx"), F.col("cy").alias("gy"))
    inside = joins.containing(views, _hoops(spark, sf), keys=["fid"], point_id="goal", at="anchor", low="w0", high="w1", order="hoop", width=60)
    rows = views.join(inside.select("goal", "hx", "hy"), "goal", "left").withColumn("day", F.floor(F.col("anchor") / 120))
    return rows.groupBy("fid", "day").agg(F.round(F.min(geo.distance(F.col("gx"), F.col("gy"), F.col("hx"), F.col("hy"))), 6).alias("hoop_dist"), F.max_by("anchor", F.struct("anchor", "goal")).alias("anchor"))


@query
def probe_report(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of the release probe and its pass flag."""
    hit = F.col("reason") == ""
    out = release_probe(spark, sf).agg(F.count("*").alias("goals"), F.count_if(hit).alias("hits"), F.count_if(F.col("at_edge")).alias("at_edge"), F.round(F.avg(hit.cast("double")), 6).alias("coverage"))
    return out.withColumn("passed", F.col("coverage") >= 0.7)


from . import contract_queries  # noqa: E402

QUERIES.update(contract_queries.QUERIES)
ORACLES = {**ORACLES, **contract_queries.ORACLES}
