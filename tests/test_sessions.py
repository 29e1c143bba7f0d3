"""Chains and plug-ins on literal rows."""

import pytest
from pyspark.sql import functions as F

from framelake.errors import SchemaError
from framelake.functions import plugins
from framelake.plans import sessions


def test_a_static_ball_becomes_one_event(spark):
    det = spark.createDataFrame([(1, f, f, 300, 300, 0.5) for f in range(10)], "fid long, frame long, det long, cx long, cy long, conf double")
    cands = sessions.mine_candidates(det)
    assert [(r.t0, r.src, r.label) for r in cands.collect()] == [(0, "static", "#1")]
    hoops = spark.createDataFrame([(1, 4, 330, 340)], "fid long, t long, hx long, hy long")
    event = sessions.rank_events(cands, hoops).collect()[0]
    assert (event.anchor, event.hoop_dist, event.position) == (0, 50.0, 1)
    persons = spark.createDataFrame([(1, 3, 0, 0, 400, 400)], "fid long, frame long, x1 long, y1 long, x2 long, y2 long")
    assert sessions.mine_candidates(det, persons).count() == 0


@pytest.fixture(scope="module")
def roster(spark):
    goals = spark.createDataFrame([("a#10.0", "confirmed", "Ann"), ("b#3.0", "confirmed", "Bob"), ("c#1.0", "rejected", "Ann")], "key string, status string, scorer string")
    players = spark.createDataFrame([("黑21", "Ann", "对手"), ("白22", "Bob", "主队"), ("灰-A", "Cat", "便服")], "tag string, name string, team string")
    return goals, spark.createDataFrame([("a#10.0", "黑21"), ("b#3.0", "白22")], "key string, tag string"), players


def test_goal_selection(roster):
    goals, assigned, players = roster
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(sessions.select_goals(goals, None, None)) == ["a#10.0", "b#3.0"]
    assert keys(sessions.select_goals(goals, None, None, scorer="Ann")) == ["a#10.0"]
    assert keys(sessions.select_goals(goals, assigned, players, scorer="黑21")) == ["a#10.0"]
    assert keys(sessions.select_goals(goals, assigned, players, scorer="Bob")) == ["b#3.0"]
    assert keys(sessions.select_goals(goals, assigned, players, team="主队")) == ["b#3.0"]
    for bad in ({"scorer": "Ann", "team": "主队"}, {"scorer": "nobody"}):
        with pytest.raises(SchemaError):
            sessions.select_goals(goals, assigned, players, **bad)
    with pytest.raises(SchemaError):
        sessions.select_goals(goals, None, None, team="主队")
    with pytest.raises(SchemaError):
        sessions.require_confirmed(False)
    sessions.require_confirmed(False, waived=True)
    assert {r.key: r.truth for r in sessions.truth_of(assigned, players).collect()} == {"a#10.0": "unjudgeable", "b#3.0": "ours_numbered"}


def test_stage(spark):
    flags = spark.createDataFrame([("s", True, True, False, False, False), ("t", None, None, None, None, None)], "session string, candidates boolean, goals boolean, roster boolean, roster_confirmed boolean, output boolean")
    assert {r.session: r.stage for r in sessions.stage_of(flags).collect()} == {"s": "goals", "t": "init"}


def test_resume_makes_a_table_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sessions.resume(spark, str(tmp_path / "t"), make).count() == 3
    assert made == [1]


def lengths():
    return lambda paths: [len(p) for p in paths]


def test_model_seam_and_cache(spark):
    asked = spark.createDataFrame([("a.jpg", "m1"), ("bb.jpg", "m2"), ("bb2.jpg", "m2")], "path string, md5 string")
    cache = spark.createDataFrame([("m1",)], "md5 string")
    misses = plugins.only_misses(asked, cache, key=["md5"])
    assert [r.md5 for r in misses.collect()] == ["m2"]
    out = plugins.map_model(asked, lengths, column="path", keep=["md5"], result="score int")
    assert sorted(r.score for r in out.collect()) == [5, 6, 7]
    plugins.check_budget(asked, cache, key=["md5"], most=1)
    with pytest.raises(SchemaError):
        plugins.check_budget(asked, cache, key=["md5"], most=0)


def test_gallery_and_gates(spark):
    faces = spark.createDataFrame([("7", "p", 0, 100, 100, [1.0]), ("7", "p", 1, 130, 120, [2.0]), ("7", "q", None, None, None, None), ("8", "r", 0, 90, 90, [3.0])], "number string, photo string, face int, w int, h int, vec array<double>")
    out = {r.photo: (r.verdict, r.vec) for r in plugins.register_gallery(faces, number="number", photo="photo").collect()}
    assert out == {"p": ("kept", [2.0]), "q": ("no_face", None), "r": ("too_small", None)}
    r = spark.range(1).select(plugins.gate_reason(F.lit(None).cast("string"), F.lit(0.2)).alias("a"), plugins.gate_reason(F.lit("wide"), F.lit(0.9)).alias("b"), plugins.crop_team(F.lit(0.1), F.lit(0.2)).alias("c")).collect()[0]
    assert (r.a, r.b, r.c) == ("no_person", "wide", "白")


def test_digits(spark):
    parts = spark.createDataFrame([(1, 0, 0, 0, 50, 90, 900, 0.8), (1, 1, 10, 10, 20, 20, 50, 0.3), (1, 2, 60, 0, 90, 90, 800, 0.8), (1, 3, 95, 0, 96, 3, 4, 0.1)], "crop long, part long, x1 long, y1 long, x2 long, y2 long, area long, height double")
    assert sorted(r.part for r in plugins.digit_components(parts, by=["crop"]).collect()) == [0, 2]
    scores = spark.createDataFrame([(1, 2, 60, 1, 0.8), (1, 0, 0, 2, 0.9), (1, 0, 0, 7, 0.6), (2, 0, 0, 3, 0.5)], "crop long, part long, x1 long, digit long, score double")
    assert {r.crop: (r.number, r.confidence) for r in plugins.read_digits(scores, by=["crop"]).collect()} == {1: ("21", "high"), 2: (None, None)}
    samples = spark.createDataFrame([("a", "12", ["x", "y"]), ("b", "1", ["z"]), ("c", "1", ["w"]), ("d", "11", ["q"])], "key string, number string, parts array<string>")
    assert {r.digit: r.templates for r in plugins.digit_library(samples).collect()} == {"1": ["w", "x", "z"]}
