"""Readers under contract on sound and malformed documents, and the operators that replaced joins of all pairs."""

import random

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framelake.errors import SchemaError
from framelake.functions import keys
from framelake.operators import joins, segments, votes
from framelake.plans import sessions
from framelake.sources import contracts

from .test_sources import put


def goal(**changes):
    return {"file": "a.mp4", "anchor_time": 10.0, "clip_start": 8.0, "clip_end": 14.0, "status": "confirmed", "scorer": "Ann", **changes}


@pytest.mark.parametrize(
    ("bad", "refuse"),
    [
        ({"file": ""}, {"clips", "probe", "crops", "page", "keys", "anchors"}),
        ({"anchor_time": None}, {"clips", "probe", "crops", "page", "keys", "anchors"}),
        ({"status": None}, {"clips", "probe", "keys", "anchors"}),
        ({"clip_end": 9.0}, {"clips"}),
        ({"clip_start": None}, {"clips"}),
        ({"anchor_time": -1.0}, {"clips", "probe"}),
        ({"status": "rejected", "file": ""}, {"probe", "anchors"}),
    ],
)
def test_each_goal_reader_refuses_its_own_defects(spark, tmp_path, bad, refuse):
    put(tmp_path / "goals.json", {"goals": [goal(anchor_time=9.5), goal(**bad)]})
    for name in contracts.goal_contracts():
        rows = contracts.goals(spark, str(tmp_path / "goals.json"), name)
        if name in refuse:
            with pytest.raises(PySparkException):
                rows.collect()
        else:
            assert rows.collect()[0].key == "a.mp4#9.5", name


def test_repeats_and_missing_lists(spark, tmp_path):
    put(tmp_path / "goals.json", {"goals": [goal(), goal()]})
    with pytest.raises(PySparkException):
        contracts.goals(spark, str(tmp_path / "goals.json"), "probe").collect()
    assert contracts.goals(spark, str(tmp_path / "goals.json"), "clips").count() == 2
    put(tmp_path / "none.json", {"other": []})
    with pytest.raises(PySparkException):
        contracts.goals(spark, str(tmp_path / "none.json"), "budget").collect()
    put(tmp_path / "odd.json", {"goals": [goal(status="confrimed"), goal()]})
    assert [(r.ordinal, r.status) for r in contracts.unknown_statuses(spark, str(tmp_path / "odd.json")).collect()] == [(0, "confrimed")]


def test_candidates_of_batches_follow_one_another(spark, tmp_path):
    item = lambda n, **x: {"fid": "a", "label": f"#{n}", "t0": n / 2, "dur": 0.2, "ac": 0.5, "cx": 1, "cy": 2, "src": "static", **x}
    put(tmp_path / "a.json", [item(3), item(1)])
    put(tmp_path / "b.json", [item(2, label=None)])
    paths = [str(tmp_path / f"{x}.json") for x in "ab"]
    rows = contracts.candidates(spark, paths, "index").orderBy("file_idx", "ordinal").collect()
    assert [(r.file_idx, r.ordinal, r.label) for r in rows] == [(0, 0, "#3"), (0, 1, "#1"), (1, 0, None)]
    with pytest.raises(PySparkException):
        contracts.candidates(spark, paths, "review").collect()
    with pytest.raises(SchemaError):
        contracts.candidates(spark, [], "index")
    put(tmp_path / "c.json", [item(1, t0="soon")])
    with pytest.raises(PySparkException):
        contracts.candidates(spark, [str(tmp_path / "c.json")], "index").collect()


def test_hoop_readers(spark, tmp_path):
    event = {"fid": "a", "window": [1.0, 3.0], "anchor": [5.9, 6.1], "detected": True, "track": [[1.5, 7, 8, "det"], [2.0, 9, 8, "interp"]]}
    put(tmp_path / "h.json", {"events": [event, {"fid": None}]})
    row = contracts.hoop_events(spark, str(tmp_path / "h.json"), "review").collect()
    assert len(row) == 1 and row[0].track[1].sec == 2.0 and row[0].track[1].src == "interp" and row[0].anchor_cx == 5
    for name in ("heat", "rank"):
        with pytest.raises(PySparkException):
            contracts.hoop_events(spark, str(tmp_path / "h.json"), name).collect()
    put(tmp_path / "i.json", {"events": [{**event, "anchor": None}]})
    assert contracts.hoop_events(spark, str(tmp_path / "i.json"), "rank").count() == 1
    with pytest.raises(PySparkException):
        contracts.hoop_events(spark, str(tmp_path / "i.json"), "heat").collect()


def test_scorer_readers_and_derived_documents(spark, tmp_path):
    old = {"key": "a#1.0", "file": "a", "anchor_time": 1.0, "status": "OK", "crop": "x.jpg", "team_guess": "黑"}
    put(tmp_path / "s.json", {"candidates": [old, {"key": "b#1.0", "file": "b", "anchor_time": 1.0, "status": "SKIP"}]})
    path = str(tmp_path / "s.json")
    assert [(r.key, r.images) for r in contracts.scorer_candidates(spark, path, "cluster").collect()] == [("a#1.0", ["x.jpg"])]
    assert contracts.scorer_candidates(spark, path, "propagate").count() == 2
    assert [r.team_guess for r in contracts.scorer_candidates(spark, path, "votes").collect()] == ["黑"]
    put(tmp_path / "t.json", {"candidates": [{**old, "status": "odd"}]})
    with pytest.raises(PySparkException):
        contracts.scorer_candidates(spark, str(tmp_path / "t.json"), "propagate").collect()
    put(tmp_path / "c.json", {"clusters": [{"cluster_id": 1, "keys": ["a"]}, {"cluster_id": 1, "keys": ["b"]}]})
    with pytest.raises(PySparkException):
        contracts.clusters(spark, str(tmp_path / "c.json")).collect()
    put(tmp_path / "r.json", {"version": 1, "entries": {"m:1": {"number": "7", "confidence": "high"}}})
    value = "struct<number:string,confidence:string>"
    assert contracts.result_cache(spark, str(tmp_path / "r.json"), value, 1).count() == 1
    assert contracts.result_cache(spark, str(tmp_path / "r.json"), value, 2).count() == 0


def test_selection_without_a_team(spark):
    goals = spark.createDataFrame([("a", "confirmed", "Ann")], "key string, status string, scorer string")
    players = spark.createDataFrame([("t", "Ann", "便服")], "tag string, name string, team string")
    with pytest.raises(SchemaError):
        sessions.select_goals(goals, goals.selectExpr("key", "'t' AS tag"), players, team="便服")
    assert sessions.select_goals(goals, spark.createDataFrame([], "key string, tag string"), players).count() == 0


def test_player_keys(spark):
    got = [r.k for r in spark.range(1, 31).orderBy("id").select(keys.player_key(F.col("id")).alias("k")).collect()]
    assert "".join(got) == "123456789QWERTYUIADFHJKLCVB" and got[27:] == ["", "", ""]


def test_ranks_over_ranges(spark):
    rows = [((k * 7919) % 500, k) for k in range(2000)]
    got = segments.ranks(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a", "b"], "place").collect()
    assert {(r.a, r.b): r.place for r in got} == {x: n for n, x in enumerate(sorted(rows), 1)}
    assert segments.ranks(spark.createDataFrame([], "a long"), ["a"], "place").count() == 0


def test_pairs_within_reach_and_one_letter_apart(spark):
    rng = random.Random(3)
    spots = [(k, rng.randrange(-2000, 2000), rng.randrange(-2000, 2000)) for k in range(200)]
    left = spark.createDataFrame([(1, *s) for s in spots[:100]], "g int, a long, x long, y long")
    right = spark.createDataFrame([(1, *s) for s in spots[100:]], "g int, b long, u long, v long")
    got = {(r.a, r.b) for r in joins.within(left, right, keys=["g"], at=("x", "y"), right_at=("u", "v"), reach=300.0).collect()}
    assert got == {(a, b) for a, x, y in spots[:100] for b, u, v in spots[100:] if (x - u) ** 2 + (y - v) ** 2 <= 300**2}
    names = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(120)}
    got = {(r.a, r.b) for r in joins.one_letter_apart(spark.createDataFrame([(n,) for n in names] * 2, "n string"), "n").collect()}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    assert got == {(a, b) for a in names for b in names if a < b and near(a, b)}


def test_similarity_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    probes, gallery = [(k, vec()) for k in range(30)], [(k % 4, vec()) for k in range(20)]
    want = {(p, n): max(sum(x * y for x, y in zip(v, g, strict=True)) for m, g in gallery if m == n) for p, v in probes for n in range(4)}
    monkeypatch.setattr(votes, "PROBE_BLOCK", 7)
    monkeypatch.setattr(votes, "GALLERY_BLOCK", 6)
    rows = votes.max_similarity(spark.createDataFrame(probes, "p long, vec array<double>"), spark.createDataFrame(gallery, "n long, vec array<double>"), probe="p", label="n").collect()
    assert {(r.p, r.n): r.score for r in rows} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


@pytest.mark.parametrize("name", ["max_sim", "fuzzy_names", "number_regex", "goal_track_choice", "window_degrade", "verdict"])
def test_no_join_of_all_pairs(spark, sf_dir, name):
    from framelake.plans import catalogue

    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bucket_pick_rounds_as_its_sql(spark, tmp_path):
    from framelake.plans import catalogue

    # 81.1 / 200 is 0.40549999999999997: times a thousand it is 405.5, so the row ties with 0.406 and comes first by its frame
    rows = [(1, "2024-01-01 00:00:00", 81.1), (2, "2024-01-01 12:00:00", 81.2), *((k, "2024-01-01 00:00:00", 100.0 + k) for k in range(3, 10))]
    spark.createDataFrame(rows, "event_id long, ts string, value double").selectExpr("event_id", "to_timestamp_ntz(ts) AS ts", "1L AS user_id", "'view' AS event_type", "value", "'{\"k\": 1}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(r[0], r[1]) for r in con.execute(catalogue.ORACLES["bucket_pick"]).fetchall()}
    got = {(r.fid, r.det) for r in catalogue.QUERIES["bucket_pick"](spark, str(tmp_path)).collect()}
    assert got == want and (1, 1) in got and (1, 2) not in got
    values = [11.7 / 200, 81.1 / 200, 102.1 / 200, 0.0005, 0.0015, -81.1 / 200, 0.0, 1.0]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", keys.rounded(F.col("v"), 3).alias("r")).collect()
    assert [r.r for r in found] == [duckdb.execute("SELECT round(?, 3)", [r.v]).fetchone()[0] for r in found]


def test_a_file_without_guesses_has_no_count_of_them(spark, tmp_path):
    from framelake.plans import contract_queries

    rows = [(1, 1, 12), (2, 1, 24), (3, 2, 12), (4, 2, 15)]  # k divisible by six: no guess
    spark.createDataFrame(rows, "event_id long, user_id long, k long").selectExpr("event_id", "to_timestamp_ntz('2024-01-02 00:00:00') AS ts", "user_id", "'purchase' AS event_type", "1.0D AS value", "concat('{\"k\": ', k, '}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = set(con.execute(contract_queries.ORACLES["scorer_contracts"]).fetchall())
    got = {tuple(x) for x in contract_queries.QUERIES["scorer_contracts"](spark, str(tmp_path)).select("contract", "file", "n", "images", "seeds", "width", "black").collect()}
    assert got == want
    assert {x[-1] for x in got if x[1] == "1"} == {None}
