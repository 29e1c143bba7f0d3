"""Scans and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from framelake.errors import SchemaError
from framelake.sources import scans, sinks


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_media_listing(spark, tmp_path):
    for name in ("a/2.mp4", "a/1.MP4", "b/x.txt"):
        put(tmp_path / name, "x")
    assert [(r.fid, r.ordinal) for r in scans.source_media(spark, str(tmp_path)).orderBy("ordinal").collect()] == [("1", 1), ("2", 2)]
    put(tmp_path / "b/2.mp4", "y")
    with pytest.raises(Exception, match="two files"):
        scans.source_media(spark, str(tmp_path)).collect()


def test_session_facts(spark, tmp_path):
    good = put(tmp_path / "f.json", {"files": {"b.mp4": {"width": 1920, "height": 1080, "fps": 59.94, "duration": 10.0}, "a.mp4": {"width": 1920, "height": 1080, "fps": 59.94, "duration": 5.0}}})
    assert sorted((r.fid, r.width) for r in scans.session_facts(spark, good).collect()) == [("a", 1920), ("b", 1920)]
    bad = put(tmp_path / "g.json", {"files": {"b.mp4": {"width": 0, "height": 1080, "fps": 59.94, "duration": 10.0}}})
    with pytest.raises(Exception, match="not positive"):
        scans.session_facts(spark, bad).collect()


def test_candidates_keep_file_order(spark, tmp_path):
    one = {"fid": "a", "label": "#1", "t0": 1.0, "dur": 0.6, "ac": 0.5, "cx": 1, "cy": 2, "src": "static"}
    paths = [put(tmp_path / f"c{k}.json", [one | {"cx": k}]) for k in range(2)]
    assert [(r.file_idx, r.cx) for r in scans.candidates(spark, paths).orderBy("file_idx").collect()] == [(0, 0), (1, 1)]
    with pytest.raises(SchemaError):
        scans.candidates(spark, [])


def test_goals_and_roster(spark, tmp_path):
    goals = put(tmp_path / "goals.json", {"goals": [{"file": "a.MP4", "anchor_time": 10.0, "clip_start": 6.0, "clip_end": 12.0, "status": s, "scorer": None} for s in ("confirmed", "rejected")]})
    assert scans.goals(spark, goals).count() == 1 and scans.goals(spark, goals, confirmed=False).count() == 2
    roster = {"session": "s", "confirmed": True, "players": [{"tag": "黑21", "name": "n", "team": "对手"}], "assignments": {"a.MP4#10.0": "黑21"}}
    players, assigned = scans.roster(spark, put(tmp_path / "roster.json", roster))
    assert [(r.tag, r.ordinal) for r in players.collect()] == [("黑21", 0)] and [(r.key, r.tag) for r in assigned.collect()] == [("a.MP4#10.0", "黑21")]
    roster["players"] *= 2
    with pytest.raises(Exception, match="occurs twice"):
        scans.roster(spark, put(tmp_path / "twice.json", roster))[0].collect()
    text = spark.createDataFrame([("黑21=Ann, 白22 = Bob,=x",)], "t string")
    assert [(r.tag, r.name) for r in scans.players_from_text(text, "t").orderBy("ordinal").collect()] == [("黑21", "Ann"), ("白22", "Bob")]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "vectors")
    spark.createDataFrame([("m1", "a", [1.0])], "model_tag string, md5 string, vec array<double>").write.partitionBy("model_tag").parquet(path)
    assert scans.embedding_cache(spark, path, "m1").count() == 1
    with pytest.raises(SchemaError):
        scans.embedding_cache(spark, path, "m2")
    log = str(tmp_path / "log")
    sinks.upsert(log, spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), key=["k"])
    view = sinks.upsert(log, spark.createDataFrame([(1, "z")], "k long, v string"), key=["k"])
    assert {(r.k, r.v) for r in view.collect()} == {(1, "z"), (2, "y")}


def test_gallery_and_batches(spark, tmp_path):
    for name in ("photos/07/a.jpg", "photos/8/b.png", "photos/8/c.gif"):
        put(tmp_path / name, name)
    assert sorted(r.number for r in scans.photo_gallery(spark, str(tmp_path / "photos")).collect()) == ["7", "8"]
    put(tmp_path / "photos/7/d.jpg", "d")
    with pytest.raises(Exception, match="collide"):
        scans.photo_gallery(spark, str(tmp_path / "photos")).collect()
    for name in ("goals.json", "goals_batch2.json", "goals_old.json"):
        put(tmp_path / "s" / name, "{}")
    assert sorted(r.batch for r in scans.batches(spark, str(tmp_path / "s")).collect()) == [1, 2]
    put(tmp_path / "s/goals_batch1.json", "{}")
    with pytest.raises(Exception, match="two files for batch"):
        scans.batches(spark, str(tmp_path / "s")).collect()


def test_hoop_detections_are_strict_and_cut(spark, tmp_path):
    cache = {"frames": 1, "balls": [[]], "persons": [[]], "hoops": [[{"conf": 0.25, "cx": 1.0, "cy": 1.0}, {"conf": 0.26, "cx": 9.9, "cy": 8.1}]]}
    put(tmp_path / "v.json", cache)
    assert [(r.det_idx, r.cx, r.cy) for r in scans.hoop_detections(scans.detection_caches(spark, str(tmp_path))).collect()] == [(1, 9, 8)]


def test_document_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "doc.json")
    for n in (2, 3):
        sinks.write_document(spark.range(n), path)
        assert len(json.loads(open(path).read())["rows"]) == n


def test_concat_and_numbers(spark):
    a = spark.createDataFrame([(1,), (1,)], "k long")
    assert [r.batch for r in sinks.concat_batches([a, a]).orderBy("batch").collect()] == [1, 1, 2, 2]
    named = sinks.numbered_clips(spark.createDataFrame([("b",), ("a",)], "f string"), order=["f"], present=F.col("f") == "a")
    assert [(r.f, r.clip, r.present) for r in named.orderBy("f").collect()] == [("a", "001", True), ("b", "002", False)]
