"""Rules of geometry, votes, merges and text keys on literal rows."""

import pytest
from pyspark.sql import functions as F

from framelake.functions import geometry as geo
from framelake.functions import keys
from framelake.operators import merges, votes
from framelake.sources import scans
from framelake.streaming import tasks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def box(*v):
    return F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(v, geo.BOX, strict=True)])


def test_boxes(spark):
    a, b = box(0, 0, 10, 10), box(5, 0, 15, 10)
    assert one(spark, geo.iou(a, b)) == pytest.approx(50 / 150)
    assert one(spark, geo.coverage(a, b)) == 0.5
    assert one(spark, geo.center_x(box(-7, 0, 0, 2))) == -4
    assert one(spark, geo.distance_to_box(F.lit(13), F.lit(14), a)) == 5.0
    assert one(spark, geo.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None
    with pytest.raises(Exception, match="x2 > x1"):
        one(spark, geo.require_box(box(3, 0, 3, 1)))


def test_adaptive_crop(spark):
    points = F.array(*[F.struct(F.lit(x).alias("cx"), F.lit(y).alias("cy")) for x, y in ((100, 100), (200, 150))])
    c = one(spark, geo.adaptive_crop(points, F.lit(3840), F.lit(2160)))
    assert (c.crop_x, c.crop_y, c.side) == (0, 0, 1200)


@pytest.mark.parametrize(("x", "y", "zone"), [(0, 1, "ra"), (0, 3, "paint"), (0, 5, "mid_c"), (-4, 2, "mid_l"), (4, 2, "mid_r"), (-7, 0, "corner_l"), (7, 0, "corner_r"), (-7, 3, "p45_l"), (7, 3, "p45_r"), (0, 8, "top")])
def test_zones(spark, x, y, zone):
    assert one(spark, geo.zone_of(F.lit(float(x)), F.lit(float(y)))) == zone


def test_keys(spark):
    assert one(spark, keys.goal_key(F.lit("a.MP4"), F.lit(100))) == "a.MP4#10.0"
    assert one(spark, keys.stem(F.lit("a.b.mp4"))) == "a.b"
    assert [one(spark, keys.letters(F.lit(n))) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, keys.first_number(F.lit("no 007b"))) == "7"
    assert one(spark, keys.first_number(F.lit("none"))) is None
    assert one(spark, keys.first_crops(F.array(F.lit("")), F.lit("c.jpg"))) == ["c.jpg"]
    assert one(spark, keys.with_suffix(F.lit("game reel"), F.lit("-x"), " reel")) == "game-x reel"
    assert one(spark, keys.opponent_of(F.lit("0815_team"))) == "team"
    assert one(spark, keys.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    with pytest.raises(Exception, match="no direction"):
        one(spark, keys.unit(F.array(F.lit(0.0))))


def test_top_two_ties_and_single(spark):
    s = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.9), ("b", 2, 0.4), ("c", 1, 0.3)], "probe string, number long, score double")
    out = {r.probe: r for r in votes.top_two(s, by="probe", label="number").collect()}
    assert (out["a"].winner, out["a"].margin) == (None, 0.0)
    assert (out["b"].winner, out["b"].margin) == (1, 0.5)
    assert (out["c"].winner, out["c"].margin) == (1, float("inf"))
    assert votes.adopted(votes.top_two(s, by="probe", label="number"), threshold=0.3, margin=0.1).count() == 2


def test_votes(spark):
    v = spark.createDataFrame([(1, "x", 1), (1, "y", 0), (2, "x", 0), (2, "y", 1), (2, "y", 2)], "g long, v string, o long")
    assert {(r.g, r.v) for r in votes.majority(v, by=["g"], value="v", order="o").collect()} == {(1, "y"), (2, "y")}
    assert {(r.g, r.v) for r in votes.unique_majority(v, by=["g"], value="v").collect()} == {(1, None), (2, "y")}
    g = spark.createDataFrame([(1, "7", True, 0), (2, "7", False, 0), (3, "7", False, 0), (3, "7", False, 1), (3, "8", True, 2), (4, "7", True, 0), (4, "8", True, 1)], "goal long, n string, high boolean, o long")
    out = {r.goal: r.number for r in votes.rule_vote(g, by=["goal"], value="n", high=F.col("high"), order="o").collect()}
    assert out == {1: "7", 2: None, 3: "7", 4: None}


def test_propagation(spark):
    m = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 3, "a"), (2, 4, "b"), (2, 5, None), (3, 6, "a")], "track long, id long, tag string")
    out = {r.id: (r.tag, r.state) for r in votes.propagate(m, track=["track"], key="id", label="tag", mixed=F.lit(False)).collect()}
    assert out == {1: (None, "blank"), 2: ("a", "filled"), 3: ("b", "filled"), 4: ("a", "filled"), 5: (None, "conflict"), 6: (None, "blank")}


def test_checked_union(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    assert merges.checked_union(a, a, key="k", value="v").collect()[0].v == "x"
    with pytest.raises(Exception, match="different values"):
        merges.checked_union(a, a.withColumn("v", F.lit("y")), key="k", value="v").collect()


def test_cache_scan(spark, tmp_path):
    ball = '{"conf": 0.9, "box": [0, 0, 20, 20], "cx": 10, "cy": 10, "sec": 0.2, "frame_idx": 1}'
    good = '{"frames": 2, "balls": [[], [' + ball + ']], "persons": [[[0, 0, 5, 5]], []]}'
    (tmp_path / "v1.json").write_text(good)
    caches = scans.detection_caches(spark, str(tmp_path))
    assert [(r.fid, r.frame_idx, r.det_idx, r.cx) for r in scans.ball_detections(caches).collect()] == [("v1", 1, 0, 10)]
    assert scans.person_boxes(caches).count() == 1
    assert scans.frames(caches).count() == 2
    assert scans.hoop_detections(caches).count() == 0
    (tmp_path / "v2.json").write_text(good.replace('"frames": 2', '"frames": 3'))
    (tmp_path / "v3.json").write_text("{broken")
    expected = spark.createDataFrame([("v1", 2), ("v2", 3), ("v3", 2), ("v4", 1)], "fid string, frames int")
    assert [r.fid for r in scans.valid_caches(spark, str(tmp_path), expected).collect()] == ["v1"]
    (tmp_path / "v3.json").unlink()
    with pytest.raises(Exception, match="frame counts differ"):
        scans.detection_caches(spark, str(tmp_path)).collect()


def test_hoop_event_track_is_typed(spark, tmp_path):
    (tmp_path / "hoops.json").write_text('{"events": [{"fid": "a", "window": [2, 6], "anchor": [1, 2], "detected": true, "track": [[2.0, 10, 20, "det"], [2.2, 11, 21, "interp"]]}]}')
    r = scans.hoop_events(spark, str(tmp_path / "hoops.json")).collect()[0]
    assert (r.w0, r.w1, r.track[1].sec, r.track[1].cx, r.track[1].src) == (2.0, 6.0, 2.2, 11, "interp")


def test_progress_stream_equals_batch(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "state"
    log.mkdir()
    lines = ["a: 10 frames", "b: 10 frames", "a: frame 5/10", "b: cached", "a: frame 3/10", "a: frame 10/10"]
    (log / "t.jsonl").write_text("".join(f'{{"ts": "{k}", "task_id": "t", "type": "log", "line": "{x}"}}\n' for k, x in enumerate(lines)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = tasks.progress_stream(tasks.parsed_lines(tasks.read_log(spark, str(log), stream=True)))
    q = stream.writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", str(out)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.percent for r in spark.table("progress").collect()][-1] == 100.0
    assert tasks.read_log(spark, str(log)).count() == 6
