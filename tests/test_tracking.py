"""Trackers, cascades and clustering on literal cases and against plain loops."""

import random

import numpy as np
import pytest

from framelake.operators import clustering, landing, merges, tracking


def flight(n, step, y=500):
    return np.arange(n), np.array([100 + step * k for k in range(n)]), np.full(n, y)


def test_default_gate_breaks_a_flight():
    f, x, y = flight(10, 100)
    assert len(set(tracking.link_nearest(f, x, y, gate=80, patience=2))) == 10
    assert len(set(tracking.link_nearest(f, x, y, gate=250, patience=2))) == 1


def test_static_ball_is_one_track(spark):
    d = spark.createDataFrame([(1, f, f, 300, 300, 0.5) for f in range(10)], "fid long, frame long, det long, cx long, cy long, conf double")
    assert tracking.track_balls(d).groupBy("track").count().collect()[0]["count"] == 10


def loop_tracks(frames, gate, patience, last):
    """The rule by counting missed frames one by one."""
    live, number, made = [], {}, 0
    for f in range(last + 1):
        free = list(frames.get(f, []))
        for t in live:
            best = None
            for d in free:
                dist = ((d[1] - t["x"]) ** 2 + (d[2] - t["y"]) ** 2) ** 0.5
                if dist < gate and (best is None or dist < best[0]):
                    best = (dist, d)
            if best:
                free.remove(best[1])
                t.update(x=best[1][1], y=best[1][2], missed=0)
                number[best[1][0]] = t["id"]
            else:
                t["missed"] += 1
        for d in free:
            live.append({"id": made, "x": d[1], "y": d[2], "missed": 0})
            number[d[0]] = made
            made += 1
        live = [t for t in live if t["missed"] <= patience]
    return number


@pytest.mark.parametrize("seed", range(6))
def test_ball_tracker_against_a_loop(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(60), k, rng.randrange(300), rng.randrange(300)) for k in range(90))
    frames = {}
    for f, k, x, y in rows:
        frames.setdefault(f, []).append((k, x, y))
    got = tracking.link_nearest(*(np.array([r[c] for r in rows]) for c in (0, 2, 3)), gate=80, patience=2)
    want = loop_tracks(frames, 80, 2, 60)
    pairs = {(int(g), want[r[1]]) for g, r in zip(got, rows, strict=True)}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_person_tracker_prefers_the_recent_track_and_takes_one_box():
    boxes = np.array([[0, 0, 100, 100], [0, 0, 100, 100], [5, 0, 105, 100], [0, 0, 100, 100]])
    assert tracking.link_boxes(np.array([0, 1, 2, 2]), boxes, max_gap=10, least_iou=0.3).tolist() == [1, 1, 2, 1]
    assert tracking.link_boxes(np.array([0, 11]), boxes[:2], max_gap=10, least_iou=0.3).tolist() == [1, 2]
    assert tracking.link_boxes(np.array([0, 10]), boxes[:2], max_gap=10, least_iou=0.3).tolist() == [1, 1]


def test_person_tracker_arguments(spark):
    with pytest.raises(ValueError):
        tracking.track_persons(spark.range(1), max_gap=0)


def test_hoop_walk_stops_at_a_jump():
    frames = [(0, [(0, 0)]), (1, []), (2, [(100, 0), (500, 0)]), (3, [(120, 0)]), (4, [(600, 0)]), (5, [(130, 0)])]
    assert tracking.walk_hoop(frames, (100, 0), 2, 150) == [(0, 0, 0), (2, 100, 0), (3, 120, 0)]
    assert tracking.walk_hoop([], (0, 0), 0, 150) == []


def shot(spark):
    det = spark.createDataFrame([(1, f, f, 50 + 20 * (f - 10), 50) for f in range(10, 21)], "fid long, frame long, det long, cx long, cy long")
    persons = spark.createDataFrame([(1, f, 0, 0, 0, 100, 100) for f in range(30)], "fid long, frame long, box long, x1 long, y1 long, x2 long, y2 long")
    goals = spark.createDataFrame([(1, 7, 20, None, None), (2, 8, 20, None, None)], "fid long, goal long, anchor long, ax double, ay double")
    return goals, det, persons


def test_landing_of_a_shot(spark):
    out = {r.goal: r for r in landing.find_landings(*shot(spark)).collect()}
    assert (out[7].path, out[7].frame, out[7].x2) == ("trace", 15, 100)
    assert (out[8].path, out[8].reason, out[8].frame) == ("", "no_track", -1)


def test_scorer_of_a_shot(spark):
    out = {r.goal: r for r in landing.locate_scorers(*shot(spark)).collect()}
    assert (out[7].path, out[7].frame) == ("held", 12)


def test_choice_of_a_track(spark):
    ends = [(0, 10.0, 1), (1, 60.0, 9), (2, 300.0, 20)]
    assert landing.choose_track(ends, longer=False, slack=100, most=200) == 0
    assert landing.choose_track(ends, longer=True, slack=100, most=200) == 1
    assert landing.choose_track([(0, 250.0, 3)], longer=False, slack=0, most=200) is None
    df = spark.createDataFrame([(1, *e) for e in ends], "goal long, track long, dist double, length long")
    assert landing.goal_tracks(df, longer=True).collect()[0].track == 1


def test_agglomeration_by_linkage():
    v = np.array([[1, 0], [0.9, 0.4359], [0.6, 0.8], [-1, 0]])
    assert clustering.agglomerate(v, 0.3, "single") == [[0, 1, 2], [3]]
    assert clustering.agglomerate(v, 0.3, "complete") == [[0, 1], [2], [3]]
    assert clustering.agglomerate(v[:1], 0.3) == [[0]]


def test_components_and_roots(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 9)] + [(20, 21)], "a long, b long")
    assert {(r.v, r.root) for r in clustering.components(edges).collect()} == {(k, 1) for k in range(1, 10)} | {(20, 20), (21, 20)}
    pointers = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "child long, parent long")
    members = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6)], "child long")
    assert {(r.child, r.root) for r in merges.group_roots(pointers, members, child="child", parent="parent").collect()} == {(1, 3), (2, 3), (3, 3), (4, 4), (5, 5), (6, 5)}


def test_single_linkage_in_parts_by_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(clustering, "LINK_BLOCK", 7)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(90):
        v = rng.standard_normal(3)
        rows.append((k, int(k % 2) if k % 11 else None, [float(x) for x in v / np.linalg.norm(v)]))
    rows += [(90, 0, rows[2][2]), (91, 0, rows[2][2]), (92, 1, [0.1, 0.0, 0.0]), (93, 1, [0.1, 0.0, 0.0]), (94, 0, None), (95, 0, [1.0, None, 0.0]), (96, 0, [1.0, 0.0]), (97, 0, [1.0, 0.0]), (98, 0, [float("nan")] * 3)]
    df = spark.createDataFrame(rows, "id long, b int, v array<double>")
    for threshold in (0.003, 0.02, 0.1):
        close = [
            (i, j) for i, b, x in rows for j, c, y in rows
            if i != j and b is not None and b == c and x and y and len(x) == len(y) and None not in x + y and 1.0 - sum(p * q for p, q in zip(x, y, strict=True)) < threshold
        ]
        root, before = {r[0]: r[0] for r in rows}, None
        while root != before:
            before = dict(root)
            for i, j in close:
                root[i] = root[j] = min(root[i], root[j])
        parts = clustering.single_linkage(df, id_="id", vec="v", threshold=threshold, block="b")
        assert {r.id: r.cluster for r in parts.collect()} == root
    crowd = df.select("id").limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(399))).alias("id")).select("id", F.array(F.lit(1.0), F.col("id") / 1e6).alias("v"))
    assert {r.cluster for r in clustering.single_linkage(crowd, id_="id", vec="v", threshold=0.01).collect()} == {0}
    x = np.ones((300, 2))
    assert len(clustering.close_links(x, x, True, 0.5)[0]) == 300 + 299  # each row with itself and a tree, not 90,000 pairs
