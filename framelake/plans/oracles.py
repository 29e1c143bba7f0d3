"""Independent DuckDB SQL for the registered queries."""

from __future__ import annotations

PLAYER_KEYS = "123456789QWERTYUIADFHJKLCVB"
DET = """det AS (
    SELECT CAST(user_id AS BIGINT) AS fid, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 720000000.0) AS BIGINT) AS frame, CAST(event_id AS BIGINT) AS det,
           CAST((event_id * 7919) % 1920 AS BIGINT) AS cx, CAST((event_id * 104729) % 1080 AS BIGINT) AS cy, least(value / 200, 1.0) AS conf,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS role
    FROM events
)"""
GOALS = "goals AS (SELECT fid, det AS goal, frame AS anchor, cx AS gx, cy AS gy FROM det WHERE role = 'purchase')"
HOOPS = "hoops AS (SELECT fid, det AS hoop, frame - 30 AS w0, frame + 30 AS w1, cx AS hx, cy AS hy FROM det WHERE role = 'signup')"
DAY = "CAST(floor(frame / 120.0) AS BIGINT)"
PERSONS = f"persons AS (SELECT fid, {DAY} AS day, det AS box, cx - 300 AS x1, cy - 300 AS y1, cx + 300 AS x2, cy + 300 AS y2 FROM det WHERE role = 'click')"
RALLY = """flagged AS (
    SELECT fid, det, frame, k, frame - 10 AS s, max(frame + 20) OVER (PARTITION BY fid ORDER BY frame, det ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM det WHERE role = 'purchase'
), grouped AS (
    SELECT *, CAST(sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY frame, det) AS BIGINT) AS grp FROM flagged
), sized AS (SELECT *, count(*) OVER (PARTITION BY fid, grp) AS members FROM grouped)"""
STATIC = """pos AS (
    SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS c4,
           max(cx) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - min(cx) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS dx,
           max(cy) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - min(cy) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS dy
    FROM det WINDOW w AS (PARTITION BY fid ORDER BY frame, det)
), raw AS (SELECT fid, pos, lag(pos) OVER (PARTITION BY fid ORDER BY pos) AS before FROM pos WHERE c4 = 4 AND dx < 900 AND dy < 900),
runs AS (SELECT fid, pos, CAST(sum(CASE WHEN before IS NULL OR pos - before > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY pos) AS BIGINT) AS seg FROM raw),
segs AS (SELECT fid, seg, min(pos) AS a, max(pos) + 3 AS b FROM runs GROUP BY fid, seg),
static AS (
    SELECT p.fid, s.seg, min(frame) * 2 AS t0_ds, (max(frame) - min(frame)) * 2 AS dur_ds, CAST(floor(CAST(sum(cx) AS DOUBLE) / count(*)) AS BIGINT) AS cx,
           CAST(floor(CAST(sum(cy) AS DOUBLE) / count(*)) AS BIGINT) AS cy, floor(avg(conf) * 1000 + 1e-6) / 1000 AS ac, count(*) AS n
    FROM pos p JOIN segs s ON p.fid = s.fid AND p.pos BETWEEN s.a AND s.b GROUP BY p.fid, s.seg HAVING (max(frame) - min(frame)) * 2 <= 3000
)"""
D = lambda a, b: f"sqrt(CAST(({a}.cx - {b}.cx) * ({a}.cx - {b}.cx) + ({a}.cy - {b}.cy) * ({a}.cy - {b}.cy) AS DOUBLE))"
REJOIN = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY frame, det) AS ord FROM det),
seeds AS (SELECT * FROM ranked a WHERE EXISTS (SELECT 1 FROM ranked p WHERE p.fid = a.fid AND p.ord < a.ord AND p.frame >= a.frame - 60 AND {D("p", "a")} <= 900)),
pairs AS (
    SELECT a.fid, a.det AS a, b.det AS b, a.cx AS acx, a.cy AS acy, b.cx AS bcx, b.cy AS bcy, a.frame AS af, b.frame AS bf, row_number() OVER (PARTITION BY a.fid, a.ord ORDER BY b.ord) AS pick
    FROM seeds a JOIN ranked b ON b.fid = a.fid AND b.frame BETWEEN a.frame + 15 AND a.frame + 70 AND b.conf >= 0.1 AND {D("a", "b")} <= 800
    WHERE EXISTS (SELECT 1 FROM ranked c WHERE c.fid = b.fid AND c.ord > b.ord AND c.frame <= b.frame + 60 AND {D("b", "c")} <= 900)
      AND NOT EXISTS (SELECT 1 FROM ranked m WHERE m.fid = a.fid AND m.ord > a.ord AND m.ord < b.ord AND {D("a", "m")} < 250)
), rejoin AS (
    SELECT fid, a, b, CAST(floor((acx + bcx) / 2.0) AS BIGINT) AS cx, CAST(floor((acy + bcy) / 2.0) AS BIGINT) AS cy, af + bf AS t0_ds FROM pairs WHERE pick = 1
)"""
COURT = """mid AS (SELECT quantile_cont(cx, 0.5) AS mid FROM det WHERE role = 'purchase'),
court AS (
    SELECT det, fid % 3 AS team, cx > mid AS flipped, round(CASE WHEN cx > mid THEN -((cx - 960) * (1.75 / (120 + k))) ELSE (cx - 960) * (1.75 / (120 + k)) END, 6) AS x, round((cy - 250) * (1.75 / (120 + k)), 6) AS y
    FROM det, mid WHERE role = 'purchase'
), inside AS (SELECT * FROM court WHERE abs(x) <= 8.0 AND y BETWEEN -2.075 AND 12.925)"""
ZONE = """CASE WHEN sqrt(x * x + y * y) <= 1.25 THEN 'ra'
    WHEN abs(x) <= 6.6 AND sqrt(x * x + y * y) <= 6.75 AND abs(x) <= 2.45 AND y <= 4.225 THEN 'paint'
    WHEN abs(x) <= 6.6 AND sqrt(x * x + y * y) <= 6.75 THEN CASE WHEN abs(x) <= 2.45 THEN 'mid_c' WHEN x < 0 THEN 'mid_l' ELSE 'mid_r' END
    WHEN abs(x) > 6.6 AND y <= sqrt(6.75 * 6.75 - 6.6 * 6.6) THEN CASE WHEN x < 0 THEN 'corner_l' ELSE 'corner_r' END
    WHEN degrees(atan2(abs(x), greatest(y, 1e-6))) > 50.0 THEN CASE WHEN x < 0 THEN 'p45_l' ELSE 'p45_r' END ELSE 'top' END"""
SIM = """gallery AS (SELECT CAST(label AS BIGINT) AS number, CAST(embedding AS DOUBLE[]) AS g FROM embeddings WHERE vec_id % 5 = 0),
sims AS (
    SELECT vec_id AS probe, number, round(max(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), g), lambda z: z[1] * z[2]))), 5) AS score
    FROM embeddings, gallery WHERE vec_id % 5 <> 0 GROUP BY vec_id, number
), placed AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, number) AS pick FROM sims),
top AS (
    SELECT probe, max(CASE WHEN pick = 1 THEN number END) AS first, max(CASE WHEN pick = 1 THEN score END) AS score, max(CASE WHEN pick = 2 THEN score END) AS second FROM placed WHERE pick <= 2 GROUP BY probe
), winners AS (
    SELECT probe, CASE WHEN second IS NOT NULL AND score = second THEN NULL ELSE first END AS winner, score, CASE WHEN second IS NULL THEN CAST('inf' AS DOUBLE) ELSE round(score - second, 5) END AS margin FROM top
)"""
LINKS = """cands AS (SELECT fid, frame * 2 AS t0, det AS ord, cx, cy, CASE WHEN k % 3 = 0 THEN cy END AS hx, CASE WHEN k % 3 = 0 THEN cx END AS hy FROM det),
prev AS (SELECT *, lag(t0) OVER w AS pt, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(hx) OVER w AS phx, lag(hy) OVER w AS phy FROM cands WINDOW w AS (PARTITION BY fid ORDER BY t0, ord)),
gaps AS (
    SELECT *, t0 - pt AS gap, coalesce(sqrt(CAST((hx - phx) * (hx - phx) + (hy - phy) * (hy - phy) AS DOUBLE)), sqrt(CAST((cx - px) * (cx - px) + (cy - py) * (cy - py) AS DOUBLE))) AS d FROM prev
), linked AS (SELECT *, coalesce((gap <= 60 AND d <= 1400) OR (gap <= 180 AND d <= 700), false) AS linked, row_number() OVER (PARTITION BY fid ORDER BY t0, ord) AS i FROM gaps)"""
HALVES = """items AS (
    SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(round(l_quantity * 1000000 + l_partkey * 7 + l_suppkey) AS BIGINT) AS v FROM lineitem
)"""
STATUSES = """a AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 2 = 0)"""
LABELLED = f"labelled AS (SELECT *, {DAY} AS track, CASE WHEN k < 60 THEN role END AS label FROM det)"
PAGE = "regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1)"
PROBE = f"""goal AS (SELECT fid, det AS goal, frame AS anchor FROM det WHERE role = 'purchase'),
seen AS (
    SELECT g.goal, d.fid, d.frame, d.det, d.cx, d.cy, row_number() OVER (PARTITION BY g.goal, d.frame ORDER BY d.conf DESC, d.det) AS pick
    FROM goal g JOIN det d ON d.fid = g.fid AND d.role = 'view' AND d.frame BETWEEN g.anchor - 120 AND g.anchor - 2
), best AS (SELECT *, lag(frame) OVER w AS pf, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM seen WHERE pick = 1 WINDOW w AS (PARTITION BY goal ORDER BY frame, det)),
marked AS (SELECT *, sum(CASE WHEN pf IS NULL OR frame - pf > 60 OR sqrt(CAST((cx - px) * (cx - px) + (cy - py) * (cy - py) AS DOUBLE)) > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY goal ORDER BY frame, det) AS seg FROM best),
counted AS (SELECT *, count(*) OVER (PARTITION BY goal, seg) AS n FROM marked),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY seg DESC, frame DESC) AS r FROM counted WHERE n >= 2) WHERE r = 1),
people AS (SELECT fid, frame, det AS box, cx - 300 AS x1, cy - 300 AS y1, cx + 300 AS x2, cy + 300 AS y2 FROM det),
held AS (
    SELECT * FROM (SELECT l.goal, l.fid, l.frame, p.box, p.x1, p.y1, p.x2, p.y2, row_number() OVER (PARTITION BY l.goal ORDER BY p.box) AS r
    FROM last l JOIN people p ON p.fid = l.fid AND p.frame = l.frame AND l.cx BETWEEN p.x1 AND p.x2 AND l.cy BETWEEN p.y1 AND p.y2) WHERE r = 1
), crowd AS (
    SELECT DISTINCT h.goal FROM held h JOIN people o ON o.fid = h.fid AND o.frame = h.frame AND o.box <> h.box
    WHERE greatest(least(h.x2, o.x2) - greatest(h.x1, o.x1), 0) * greatest(least(h.y2, o.y2) - greatest(h.y1, o.y1), 0) >= 0.1 * (720000 - greatest(least(h.x2, o.x2) - greatest(h.x1, o.x1), 0) * greatest(least(h.y2, o.y2) - greatest(h.y1, o.y1), 0))
), probe AS (
    SELECT g.goal, CASE WHEN NOT EXISTS (SELECT 1 FROM seen s WHERE s.goal = g.goal) THEN 'no_ball' WHEN l.goal IS NULL THEN 'no_stable_segment' WHEN h.goal IS NULL THEN 'no_holder' ELSE '' END AS reason,
           CASE WHEN h.goal IS NULL THEN -1 ELSE l.frame END AS frame, coalesce(h.box, -1) AS box, CASE WHEN h.goal IS NULL THEN -1.0 ELSE (h.x1 + h.x2) / 2.0 END AS land_x, CASE WHEN h.goal IS NULL THEN -1.0 ELSE CAST(h.y2 AS DOUBLE) END AS land_y,
           coalesce(h.x1 <= 8 OR h.y1 <= 8 OR h.x2 >= 1912 OR h.y2 >= 1072, false) AS at_edge, c.goal IS NOT NULL AS overlapped
    FROM goal g LEFT JOIN last l ON l.goal = g.goal LEFT JOIN held h ON h.goal = g.goal LEFT JOIN crowd c ON c.goal = g.goal
)"""


def asof(side: str, gap: int, order: str) -> str:
    return f"""met AS (SELECT g.goal, v.*, abs(v.frame - g.anchor) AS dt, row_number() OVER (PARTITION BY g.goal ORDER BY abs(v.frame - g.anchor), v.{order} DESC) AS pick
        FROM goals g JOIN det v ON v.fid = g.fid AND v.role = '{side}' AND abs(v.frame - g.anchor) <= {gap})"""


ORACLES: dict[str, str] = {
    "static_segments": f"WITH {DET}, {STATIC} SELECT fid, seg, t0_ds, dur_ds, cx, cy, ac, n FROM static",
    "stable_segments": f"""WITH {DET}, prev AS (SELECT *, lag(frame) OVER w AS pf, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM det WINDOW w AS (PARTITION BY fid ORDER BY frame, det)),
        cut AS (SELECT *, CAST(sum(CASE WHEN pf IS NULL OR frame - pf > 30 OR sqrt(CAST((cx - px) * (cx - px) + (cy - py) * (cy - py) AS DOUBLE)) > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY frame, det) AS BIGINT) AS seg FROM prev)
        SELECT fid, seg, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM cut GROUP BY fid, seg HAVING count(*) >= 2""",
    "frame_argmax": f"""WITH {DET}, r AS (SELECT fid, {DAY} AS day, det, conf, row_number() OVER (PARTITION BY fid, {DAY} ORDER BY conf DESC, det) AS pick FROM det)
        SELECT fid, day, det, round(conf, 6) AS conf FROM r WHERE pick = 1 AND conf >= 0.35""",
    "rally_groups": f"WITH {DET}, {RALLY} SELECT fid, det, grp, members FROM sized WHERE members > 1",
    "impact_score": f"""WITH {DET}, d AS (SELECT *, {DAY} AS day FROM det),
        ball AS (SELECT fid, day, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY fid, day ORDER BY conf DESC, det) AS pick FROM d WHERE role = 'view') WHERE pick = 1 AND conf >= 0.05),
        spine AS (SELECT fid, unnest(generate_series(min(day), max(day))) AS day FROM d GROUP BY fid),
        rows_ AS (SELECT s.fid, s.day, b.cx, b.cy, lag(b.cx) OVER (PARTITION BY s.fid ORDER BY s.day) AS px, lag(b.cy) OVER (PARTITION BY s.fid ORDER BY s.day) AS py FROM spine s LEFT JOIN ball b ON b.fid = s.fid AND b.day = s.day),
        {PERSONS},
        near AS (SELECT r.fid, r.day, min(sqrt(CAST(pow(greatest(p.x1 - r.cx, 0, r.cx - p.x2), 2) + pow(greatest(p.y1 - r.cy, 0, r.cy - p.y2), 2) AS DOUBLE))) AS gap, max((p.x2 - p.x1) * (p.y2 - p.y1)) AS area
                 FROM rows_ r JOIN persons p ON p.fid = r.fid AND p.day = r.day GROUP BY r.fid, r.day),
        hoop AS (SELECT r.fid, r.day, max(greatest(0.0, 1 - sqrt(CAST((r.cx - h.cx) * (r.cx - h.cx) + (r.cy - h.cy) * (r.cy - h.cy) AS DOUBLE)) / 400)) AS hoop
                 FROM rows_ r JOIN d h ON h.fid = r.fid AND h.role = 'signup' AND r.day BETWEEN h.day - 1 AND h.day + 1 WHERE r.cx IS NOT NULL GROUP BY r.fid, r.day)
        SELECT r.fid, r.day, round(0.35 * coalesce(h.hoop, 0.0) + 0.20 * CASE WHEN n.area IS NULL THEN 0.0 ELSE least(n.area / (0.12 * 1920 * 1080), 1.0) END
            + 0.20 * coalesce(CASE WHEN px IS NULL OR cx IS NULL THEN NULL ELSE least(sqrt(CAST((cx - px) * (cx - px) + (cy - py) * (cy - py) AS DOUBLE)) / 300, 1.0) END, 0.0)
            + 0.15 * coalesce(CASE WHEN n.gap IS NULL THEN NULL ELSE greatest(0.0, 1 - n.gap / 400) END, 0.0) + 0.10 * CASE WHEN cy IS NULL THEN 0.0 ELSE greatest(0.0, least(1 - cy / 1080, 1.0)) END, 6) AS score
        FROM rows_ r LEFT JOIN near n ON n.fid = r.fid AND n.day = r.day LEFT JOIN hoop h ON h.fid = r.fid AND h.day = r.day""",
    "running_offset": """SELECT o_orderkey, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM orders""",
    "batches": "SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 50.0) + 1 AS BIGINT) AS batch FROM documents",
    "even_sample": """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
        s AS (SELECT source, n, unnest(generate_series(0, least(n, 7) - 1)) AS slot FROM (SELECT DISTINCT source, n FROM r))
        SELECT r.source, r.doc_id, CAST(s.slot AS BIGINT) AS slot FROM s JOIN r ON r.source = s.source AND r.i = CASE WHEN s.n <= 7 THEN s.slot ELSE CAST(round_even(s.slot * (s.n - 1) / 6.0, 0) AS BIGINT) END""",
    "gap_interpolation": f"""WITH {DET}, best AS (SELECT fid, frame, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY fid, frame ORDER BY conf DESC, det) AS pick FROM det) WHERE pick = 1),
        n AS (SELECT *, lead(frame) OVER w AS f2, lead(cx) OVER w AS x2, lead(cy) OVER w AS y2 FROM best WINDOW w AS (PARTITION BY fid ORDER BY frame)),
        m AS (SELECT *, unnest(generate_series(frame + 1, f2 - 1)) AS f FROM n WHERE f2 - frame > 1 AND f2 - frame - 1 <= 3)
        SELECT fid, frame, cx, cy, 'det' AS src FROM best UNION ALL
        SELECT fid, f, CAST(round_even(cx + (x2 - cx) * ((f - frame) / CAST(f2 - frame AS DOUBLE)), 0) AS BIGINT), CAST(round_even(cy + (y2 - cy) * ((f - frame) / CAST(f2 - frame AS DOUBLE)), 0) AS BIGINT), 'interp' FROM m""",
    "clip_windows": f"WITH {DET} SELECT det, greatest(0, frame * 2 - 20) AS start_ds, frame * 2 + 45 AS end_ds, greatest(0, frame * 2 - 40) AS preview_start, frame * 2 + 20 AS preview_end FROM det WHERE role = 'purchase'",
    "clip_segment_plan": f"""WITH {DET}, f AS (SELECT fid, lead(fid) OVER (ORDER BY fid) AS nxt FROM (SELECT DISTINCT CAST(user_id AS BIGINT) AS fid FROM events)),
        c AS (SELECT det, d.fid, nxt, frame * 2 - 20 AS s, frame * 2 + 40 AS e FROM det d JOIN f ON f.fid = d.fid WHERE role = 'purchase')
        SELECT det, CAST(1 AS BIGINT) AS part, fid, s AS start, least(e, 7000) AS "end" FROM c UNION ALL
        SELECT det, CAST(2 AS BIGINT), nxt, CAST(0 AS BIGINT), least(greatest(e - 7000, 0), 40) FROM c WHERE e > 7000 AND nxt IS NOT NULL""",
    "crop_boxes": f"""WITH {DET}, g AS (SELECT fid, min(cx) * 2 AS l, max(cx) * 2 AS r, min(cy) * 2 AS t, max(cy) * 2 AS b FROM det GROUP BY fid),
        s AS (SELECT *, least(greatest(greatest(r - l, b - t) + 600, 1200), 2160) AS side FROM g),
        best AS (SELECT fid, cx * 2 AS cx, cy * 2 AS cy FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY conf DESC, det) AS pick FROM det) WHERE pick = 1)
        SELECT s.fid, CAST(least(greatest(floor((l + r) / 2.0) - floor(side / 2.0), 0), 3840 - side) AS BIGINT) AS ax, CAST(least(greatest(floor((t + b) / 2.0) - floor(side / 2.0), 0), 2160 - side) AS BIGINT) AS ay, side,
               least(greatest(best.cx - 600, 0), 2640) AS bx, least(greatest(best.cy - 600, 0), 960) AS by FROM s JOIN best ON best.fid = s.fid""",
    "rejoin_pairs": f"WITH {DET}, {REJOIN} SELECT fid, a, b, cx, cy, t0_ds FROM rejoin",
    "asof_candidate": f"WITH {DET}, {GOALS}, {asof('view', 10, 'det')} SELECT goal, det AS view, dt FROM met WHERE pick = 1",
    "asof_clip": f"WITH {DET}, {GOALS}, {asof('click', 40, 'det')} SELECT goal, CASE WHEN k % 2 = 0 THEN 'wide-' ELSE 'clip-' END || det AS file FROM met WHERE pick = 1",
    "containing_window": f"WITH {DET}, {GOALS}, {HOOPS} SELECT goal, min(hoop) AS hoop FROM goals g JOIN hoops h ON h.fid = g.fid AND anchor BETWEEN w0 AND w1 GROUP BY goal",
    "window_degrade": f"""WITH {DET}, {GOALS}, {HOOPS}, p AS (SELECT *, anchor BETWEEN w0 - 5 AND w1 + 5 AS inw FROM goals g JOIN hoops h ON h.fid = g.fid),
        q AS (SELECT *, bool_or(inw) OVER (PARTITION BY goal) AS anyw FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY greatest(w0 - anchor, anchor - w1, 0), sqrt(CAST((gx - hx) * (gx - hx) + (gy - hy) * (gy - hy) AS DOUBLE)), hx, hy, hoop) AS pick FROM q WHERE inw = anyw)
        SELECT goal, hoop, NOT anyw AS degraded FROM r WHERE pick = 1""",
    "goal_boost": f"""WITH {DET}, {GOALS}, v AS (SELECT * FROM det WHERE role = 'view'), p AS (SELECT v.det, g.goal, row_number() OVER (PARTITION BY g.goal ORDER BY conf DESC, v.frame, v.det) AS pick FROM v JOIN goals g ON g.fid = v.fid AND abs(v.frame - g.anchor) <= 10)
        SELECT det AS "row", round(CASE WHEN det IN (SELECT det FROM p) THEN conf * 1.5 ELSE conf END, 6) AS score, det IN (SELECT det FROM p WHERE pick = 1) AS forced FROM v""",
    "last_holder": f"""WITH {DET}, {PERSONS}, h AS (SELECT d.fid, d.det, p.box, row_number() OVER (PARTITION BY d.fid ORDER BY d.frame DESC, d.det, p.box) AS pick FROM det d JOIN persons p ON p.fid = d.fid AND p.day = CAST(floor(d.frame / 120.0) AS BIGINT) AND d.cx BETWEEN p.x1 AND p.x2 AND d.cy BETWEEN p.y1 AND p.y2 WHERE d.role = 'view')
        SELECT fid, det, box FROM h WHERE pick = 1""",
    "unique_majority": f"""WITH {DET}, c AS (SELECT fid, role, count(*) AS n FROM det GROUP BY fid, role), t AS (SELECT *, max(n) OVER (PARTITION BY fid) AS top FROM c)
        SELECT fid, CASE WHEN count(*) = 1 THEN max(role) END AS role, max(n) AS n FROM t WHERE n = top GROUP BY fid""",
    "number_regex": """WITH tags AS (SELECT p_partkey AS tag_key, '#' || p_size || ' ' || p_brand AS tag FROM part), numbers AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS number FROM part)
        SELECT number, count(*) AS matches, min(tag_key) AS first_match FROM numbers JOIN tags ON regexp_matches(tag, '(^|[^0-9])' || number || '([^0-9]|$)') GROUP BY number""",
    "fuzzy_names": "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT x.p_name AS a, y.p_name AS b FROM n x JOIN n y ON x.p_name < y.p_name AND levenshtein(x.p_name, y.p_name) <= 1",
    "roster_resolve": """WITH asked AS (SELECT c_name AS q FROM customer UNION SELECT c_mktsegment FROM customer),
        hits AS (SELECT q, 1 AS p, c_custkey AS id FROM asked JOIN customer ON q = c_name UNION ALL SELECT q, 2, c_custkey FROM asked JOIN customer ON q = c_mktsegment),
        best AS (SELECT *, min(p) OVER (PARTITION BY q) AS m FROM hits)
        SELECT q, CASE WHEN count(*) = 1 THEN max(id) END AS id, CAST(max(p) AS BIGINT) AS rule FROM best WHERE p = m GROUP BY q""",
    "team_select": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "hit_budget": """WITH t AS (SELECT c_nationkey, min(c_custkey) AS first_player, count(*) AS players FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY c_nationkey)
        SELECT *, row_number() OVER (ORDER BY first_player) AS position FROM t""",
    "fact_diff": """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.doc_id % 2 <> b.quality""",
    "coverage_anti": """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'zero' ELSE 'missing' END AS verdict FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
    "verdict": """SELECT conv_id, CASE WHEN bool_or(length(text) % 5 = 0) THEN 'Y' WHEN bool_or(length(text) % 5 = 1) THEN '?' ELSE 'N' END AS verdict FROM conversations GROUP BY conv_id""",
    "max_sim": f"WITH {SIM} SELECT probe, number, score FROM sims",
    "max_sim_top2": f"WITH {SIM} SELECT probe, winner, score, margin FROM winners",
    "adopted": f"WITH {SIM} SELECT probe, winner, score FROM winners WHERE winner IS NOT NULL AND score >= 0.30",
    "confusion": f"WITH {SIM} SELECT CAST(label AS BIGINT) AS truth, coalesce(CAST(winner AS VARCHAR), 'none') AS winner, count(*) AS n FROM winners JOIN embeddings ON vec_id = probe GROUP BY 1, 2",
    "rates": """WITH l AS (SELECT quality = 1 AS pos, lang = 'en' AS ad, toxic = 0 AS ok FROM labels JOIN documents USING (doc_id))
        SELECT CAST(count_if(pos) AS BIGINT) AS positives, round(count_if(pos AND ad AND ok) / nullif(CAST(count_if(pos) AS DOUBLE), 0), 6) AS hit_rate, round(count_if(NOT pos AND ad) / nullif(CAST(count_if(NOT pos) AS DOUBLE), 0), 6) AS mishit_rate,
               round(count_if(ad) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS coverage, round(count_if(ad AND NOT ok) / nullif(CAST(count_if(ad) AS DOUBLE), 0), 6) AS error_rate, CAST(count_if(NOT ad) AS BIGINT) AS burden FROM l""",
    "knn_components": """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE 1.0 - list_sum(list_transform(list_zip(x.v, y.v), lambda z: z[1] * z[2])) < 0.62),
        reach AS (SELECT vec_id AS v, vec_id AS r FROM e UNION SELECT reach.v, edges.b FROM reach JOIN edges ON edges.a = reach.r)
        SELECT v AS vec_id, min(r) AS cluster FROM reach GROUP BY v""",
    "goal_mean_vector": """WITH u AS (SELECT CAST(floor(vec_id / 3.0) AS BIGINT) AS goal, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
        m AS (SELECT goal, i, avg(x) AS x FROM u GROUP BY goal, i) SELECT goal, CAST(i AS BIGINT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY goal)), 5) AS x FROM m""",
    "majority_first_seen": f"""WITH {DET}, c AS (SELECT fid, role, count(*) AS votes, min(det) AS f FROM det GROUP BY fid, role),
        r AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY fid) AS BIGINT) AS total, row_number() OVER (PARTITION BY fid ORDER BY votes DESC, f) AS pick FROM c) SELECT fid, role, votes, total FROM r WHERE pick = 1""",
    "purity": """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), m AS (SELECT source, max(n) AS votes, sum(n) AS total FROM c GROUP BY source)
        SELECT CAST(sum(votes) AS BIGINT) AS agreeing, CAST(sum(total) AS BIGINT) AS assigned, round(CAST(sum(votes) AS DOUBLE) / CAST(sum(total) AS DOUBLE), 6) AS purity FROM m""",
    "rule_vote": f"""WITH {DET}, p AS (SELECT fid, {DAY} AS day, k % 7 AS guess, count(*) AS n, min(det) AS f, max(CASE WHEN conf > 0.6 THEN 1 ELSE 0 END) AS high FROM det GROUP BY 1, 2, 3)
        SELECT fid, day, CASE WHEN max(n) >= 2 THEN arg_min(guess, f) FILTER (WHERE n >= 2) WHEN sum(high) = 1 THEN min(guess) FILTER (WHERE high = 1) END AS number, max(n) >= 2 AS agreed FROM p GROUP BY fid, day""",
    "seeded_propagation": f"""WITH {DET}, {LABELLED}, s AS (SELECT *, first_value(label) OVER (PARTITION BY fid, track ORDER BY det) AS seed, row_number() OVER (PARTITION BY fid, track ORDER BY det) AS r FROM labelled WHERE label IS NOT NULL),
        t AS (SELECT fid, track, count(*) AS n, count(DISTINCT label) AS labels, CAST(count_if(r > 1 AND label = seed) AS BIGINT) AS same FROM s GROUP BY fid, track)
        SELECT count(*) AS seeds, CAST(sum(n - 1) AS BIGINT) AS prefilled, CAST(sum(same) AS BIGINT) AS correct, CAST(count_if(labels > 1) AS BIGINT) AS conflicts FROM t""",
    "track_prefill": f"""WITH {DET}, {LABELLED}, o AS (
            SELECT a.det, a.track, count(DISTINCT b.label) AS n, min(b.label) AS tag FROM labelled a LEFT JOIN labelled b ON b.fid = a.fid AND b.track = a.track AND b.det <> a.det AND b.label IS NOT NULL GROUP BY a.det, a.track)
        SELECT det, CASE WHEN track % 9 <> 0 AND n = 1 THEN tag END AS tag, CASE WHEN track % 9 = 0 THEN 'mixed' WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN 'filled' ELSE 'blank' END AS state FROM o""",
    "cluster_representatives": f"""WITH {DET}, r AS (SELECT fid, det, row_number() OVER (PARTITION BY fid ORDER BY coalesce(CASE WHEN k % 4 > 0 THEN round(conf, 3) END, 0.0) DESC, det) AS pick FROM det) SELECT fid, det FROM r WHERE pick = 1""",
    "color_guard": f"""WITH {DET}, f AS (SELECT *, min(frame) OVER (PARTITION BY fid) AS first FROM det), c AS (SELECT fid, CAST(count_if(role = 'view') AS BIGINT) AS black, CAST(count_if(role = 'click') AS BIGINT) AS white FROM f WHERE (frame - first) % 5 = 0 GROUP BY fid)
        SELECT fid, black, white, CASE WHEN black + white = 0 THEN false ELSE greatest(black, white) / CAST(black + white AS DOUBLE) < 0.6 END AS mixed FROM c""",
    "median_flip": f"WITH {DET}, {COURT} SELECT det, team, flipped, x, y FROM inside",
    "court_zones": f"WITH {DET}, {COURT} SELECT det, {ZONE} AS zone FROM court",
    "zone_share": f"""WITH {DET}, {COURT}, z AS (SELECT unnest(['ra', 'paint', 'mid_l', 'mid_c', 'mid_r', 'corner_l', 'corner_r', 'p45_l', 'p45_r', 'top']) AS zone), t AS (SELECT DISTINCT team FROM inside),
        c AS (SELECT team, {ZONE} AS zone, count(*) AS n FROM inside GROUP BY 1, 2), f AS (SELECT t.team, z.zone, coalesce(c.n, 0) AS n FROM t CROSS JOIN z LEFT JOIN c ON c.team = t.team AND c.zone = z.zone),
        s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY team) AS DOUBLE) AS share FROM f)
        SELECT team, zone, n, round(share, 6) AS share, round(CASE WHEN n > 0 THEN 0.25 + 0.75 * sqrt(share / max(share) OVER (PARTITION BY team)) ELSE 0.0 END, 6) AS shade FROM s""",
    "kde": f"""WITH {DET}, {COURT} SELECT team, CAST(gx AS DOUBLE) AS gx, CAST(gy AS DOUBLE) AS gy, round(sum(exp(-((gx - x) * (gx - x) + (gy - y) * (gy - y)) / (2 * 0.9 * 0.9))), 6) AS density
        FROM inside, generate_series(-8, 8) AS a(gx), generate_series(-2, 12) AS b(gy) GROUP BY team, gx, gy""",
    "event_islands": f"WITH {DET}, {LINKS} SELECT fid, ord AS det, CAST(sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY fid ORDER BY i) AS BIGINT) AS event FROM linked",
    "event_clusters": f"""WITH RECURSIVE {DET}, {LINKS}, walk AS (
            SELECT fid, i, ord, t0, t0 AS start, CAST(1 AS BIGINT) AS event FROM linked WHERE i = 1 UNION ALL
            SELECT l.fid, l.i, l.ord, l.t0, CASE WHEN l.linked AND l.t0 - w.start <= 150 THEN w.start ELSE l.t0 END, CASE WHEN l.linked AND l.t0 - w.start <= 150 THEN w.event ELSE w.event + 1 END FROM walk w JOIN linked l ON l.fid = w.fid AND l.i = w.i + 1)
        SELECT fid, event, count(*) AS n, min(t0) AS first_ds, max(t0) AS last_ds, arg_max(ord, i) AS anchor FROM walk GROUP BY fid, event""",
    "merge_dedupe": f"""WITH RECURSIVE {DET}, {STATIC}, {REJOIN},
        free AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY t0_ds, a) AS i FROM rejoin r WHERE NOT EXISTS (SELECT 1 FROM static s WHERE s.fid = r.fid AND abs(s.t0_ds - r.t0_ds) <= 150 AND {D("s", "r")} <= 600)),
        walk AS (
            SELECT fid, i, [{{'t': t0_ds, 'x': cx, 'y': cy}}] AS kept FROM free WHERE i = 1 UNION ALL
            SELECT f.fid, f.i, CASE WHEN len(list_filter(w.kept, lambda z: abs(z.t - f.t0_ds) <= 150 AND sqrt(CAST((z.x - f.cx) * (z.x - f.cx) + (z.y - f.cy) * (z.y - f.cy) AS DOUBLE)) <= 600)) > 0 THEN w.kept ELSE list_append(w.kept, {{'t': f.t0_ds, 'x': f.cx, 'y': f.cy}}) END
            FROM walk w JOIN free f ON f.fid = w.fid AND f.i = w.i + 1
        ), ends AS (SELECT fid, arg_max(kept, i) AS kept FROM walk GROUP BY fid), opened AS (SELECT fid, unnest(kept) AS z FROM ends)
        SELECT fid, t0_ds AS t0, cx, cy, 'static' AS src FROM static UNION ALL SELECT fid, z.t, z.x, z.y, 'rejoin' FROM opened""",
    "pick_best_frames": f"""WITH RECURSIVE {DET}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid, frame ORDER BY conf DESC, det) AS pick FROM det) WHERE pick = 1 AND k >= 10),
        o AS (SELECT fid, frame, row_number() OVER (PARTITION BY fid ORDER BY round(conf, 3) DESC, frame) AS i FROM best),
        walk AS (SELECT fid, i, [frame] AS kept FROM o WHERE i = 1 UNION ALL
            SELECT o.fid, o.i, CASE WHEN len(w.kept) < 3 AND len(list_filter(w.kept, lambda z: abs(z - o.frame) < 100)) = 0 THEN list_append(w.kept, o.frame) ELSE w.kept END FROM walk w JOIN o ON o.fid = w.fid AND o.i = w.i + 1),
        ends AS (SELECT fid, arg_max(kept, i) AS kept FROM walk GROUP BY fid)
        SELECT fid, CAST(generate_subscripts(kept, 1) - 1 AS BIGINT) AS rank, unnest(kept) AS frame FROM ends""",
    "opposite_guard": f"""WITH {DET}, s AS (SELECT *, min(frame) OVER (PARTITION BY fid) AS f0 FROM det), t AS (SELECT *, max(CASE WHEN frame = f0 THEN role END) OVER (PARTITION BY fid) AS seed FROM s)
        SELECT fid, det FROM t WHERE NOT ((seed = 'view' AND role = 'click') OR (seed = 'click' AND role = 'view'))""",
    "bucket_pick": f"""WITH {DET}, r AS (SELECT *, k = 7 AS forced, row_number() OVER (PARTITION BY fid, CAST(floor(frame / 600.0) AS BIGINT), k = 7 ORDER BY round(conf, 3) DESC, frame, det) AS b FROM det),
        s AS (SELECT *, forced OR b = 1 AS sure FROM r), t AS (SELECT *, count_if(sure) OVER (PARTITION BY fid) AS have, row_number() OVER (PARTITION BY fid, sure ORDER BY round(conf, 3) DESC, frame, det) AS i FROM s)
        SELECT fid, det FROM t WHERE sure OR i <= 8 - have""",
    "same_track_fill": f"""WITH {DET}, t AS (SELECT *, {DAY} AS track, CASE WHEN k < 20 THEN role END AS tag, k >= 70 AS pre FROM det),
        g AS (SELECT fid, track, arg_max(tag, det) AS given FROM t WHERE tag IS NOT NULL GROUP BY fid, track)
        SELECT det, coalesce(tag, CASE WHEN NOT pre THEN given END) AS tag FROM t LEFT JOIN g USING (fid, track)""",
    "union_groups": "SELECT p_partkey AS child, max(p_partkey) OVER (PARTITION BY p_brand, p_size) AS root FROM part",
    "last_writer": f"""WITH {HALVES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, line ORDER BY v % 2 DESC, v DESC) AS pick FROM items) SELECT l_orderkey, line, v, v % 2 AS part FROM r WHERE pick = 1""",
    "conflict_check": f"WITH {STATUSES} SELECT o_orderkey, a.v AS left_value, b.v AS right_value FROM a JOIN b USING (o_orderkey) WHERE a.v <> b.v",
    "priority_union": f"WITH {STATUSES} SELECT o_orderkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'a' ELSE 'b' END AS source FROM a FULL JOIN b USING (o_orderkey)",
    "overlay_merge": f"WITH {STATUSES} SELECT o_orderkey, CASE coalesce(b.v, a.v) WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE coalesce(b.v, a.v) END AS v FROM a FULL JOIN b USING (o_orderkey)",
    "cache_rekey": "SELECT n_name AS key, CAST(n_regionkey AS BIGINT) AS value FROM nation UNION ALL SELECT md5(n_name), CAST(n_regionkey AS BIGINT) FROM nation",
    "roster_export": f"""WITH {DET}, t AS (SELECT CASE WHEN k < 50 THEN role WHEN k < 55 THEN 'SKIP' WHEN k < 60 THEN 'NOGOAL' ELSE 'late' END AS tag FROM det),
        u AS (SELECT tag, count(*) AS uses FROM t WHERE tag NOT IN ('SKIP', 'NOGOAL') GROUP BY tag), p AS (SELECT unnest(['view', 'bench', 'opponent']) AS tag)
        SELECT coalesce(p.tag, u.tag) AS tag, coalesce(uses, 0) AS uses, true AS confirmed FROM p FULL JOIN u ON u.tag = p.tag WHERE NOT (coalesce(p.tag, u.tag) = 'opponent' AND coalesce(uses, 0) = 0)""",
    "bulk_accept": f"""WITH {DET}, t AS (SELECT det, role, k, CASE WHEN k < 20 THEN 'set' END AS tag, CASE WHEN k % 2 = 0 THEN 'p' || k END AS pre FROM det)
        SELECT det, CASE WHEN k <= 90 AND tag IS NULL AND pre IS NOT NULL THEN pre WHEN k <= 90 AND tag IS NULL AND role = 'error' THEN 'opponent' ELSE tag END AS tag FROM t""",
    "goal_export": f"""WITH {DET}, t AS (SELECT det AS event, frame * 2 + CASE WHEN k % 3 = 0 THEN 3 ELSE 0 END AS anchor, role FROM det WHERE role IN ('purchase', 'error'))
        SELECT event, anchor, greatest(0, anchor - 40) AS clip_start, anchor + 20 AS clip_end, CASE WHEN role = 'purchase' THEN 'confirmed' ELSE 'rejected' END AS status FROM t""",
    "work_queue": f"""WITH {DET}, g AS (SELECT fid, min(k) AS least FROM det GROUP BY fid) SELECT det FROM det LEFT JOIN g USING (fid) WHERE k >= 30 AND (k % 11 = 0 OR k >= 80 OR least <= 1)""",
    "multi_positive_groups": f"WITH {DET}, {RALLY} SELECT fid, grp, CAST(count_if(k < 70) AS BIGINT) AS marked FROM sized WHERE members > 1 GROUP BY fid, grp HAVING count_if(k < 70) >= 2",
    "verbatim_concat": f"WITH {STATUSES} SELECT CAST(1 AS BIGINT) AS batch, v, count(*) AS n FROM a GROUP BY v UNION ALL SELECT CAST(2 AS BIGINT), v, count(*) FROM b GROUP BY v",
    "nulls_last": f"""WITH {DET}, t AS (SELECT fid, det, CASE WHEN k % 4 > 0 THEN cx END AS dist FROM det WHERE role = 'purchase') SELECT *, row_number() OVER (PARTITION BY fid ORDER BY dist ASC NULLS LAST, det) AS position FROM t""",
    "next_file": "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key FROM orders",
    "keymap": f"""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)
        SELECT c_custkey, c_nationkey, CASE WHEN i <= 27 THEN substr('{PLAYER_KEYS}', i, 1) ELSE '' END AS key FROM r""",
    "summary_order": f"WITH {DET}, g AS (SELECT fid, count(*) AS n, min(frame) AS first_frame FROM det GROUP BY fid) SELECT *, row_number() OVER (ORDER BY n DESC, first_frame, fid) AS position FROM g",
    "gt_eval": f"""WITH {DET}, {GOALS}, n AS (SELECT goal, min(abs(v.frame - anchor)) AS dt FROM goals g LEFT JOIN det v ON v.fid = g.fid AND v.role = 'view' AND abs(v.frame - anchor) <= 20 GROUP BY goal)
        SELECT CASE WHEN dt <= 10 THEN 'HIT' WHEN dt <= 20 THEN 'WEAK' ELSE 'MISS' END AS status, count(*) AS n FROM n GROUP BY 1""",
    "scale_check": f"""WITH {DET}, b AS (SELECT fid, det, cx - 300 < -19.2 OR cy - 300 < -10.8 OR cx + 300 > 1939.2 OR cy + 300 > 1090.8 AS bad FROM det WHERE role = 'click')
        SELECT fid, CAST(count_if(bad) AS BIGINT) AS violations, min(CASE WHEN bad THEN det END) AS first_violation FROM b GROUP BY fid""",
    "stage_case": f"""WITH {DET} SELECT concat(fid, '-', {DAY}) AS session, CASE WHEN bool_or(role = 'error' AND k < 60) THEN 'output' WHEN bool_or(role = 'view' AND k < 50) THEN 'roster_confirmed' WHEN bool_or(role = 'purchase' AND k < 40) THEN 'roster'
            WHEN bool_or(role = 'signup' AND k < 30) THEN 'goals' WHEN bool_or(role = 'click' AND k < 20) THEN 'candidates' ELSE 'init' END AS stage FROM det GROUP BY 1""",
    "key_parsing": f"""WITH p AS (SELECT page_id, {PAGE} AS name FROM pages)
        SELECT page_id, regexp_replace(name, '\\.[^.]+$', '') AS stem, CASE WHEN regexp_extract(name, '(\\d+)', 1) <> '' THEN coalesce(nullif(ltrim(regexp_extract(name, '(\\d+)', 1), '0'), ''), '0') END AS number,
               name || '#' || (page_id * 7 // 10) || '.' || (page_id * 7 % 10) AS goal_key FROM p""",
    "json_numbers": """SELECT event_id, json_extract_string(props, '$.k') AS number, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 50 THEN 'high' ELSE 'low' END AS confidence FROM events""",
    "cluster_letters": """WITH RECURSIVE w AS (SELECT p_partkey, p_partkey AS left_, '' AS tag FROM part UNION ALL SELECT p_partkey, (left_ - 1) // 26, chr(CAST(65 + (left_ - 1) % 26 AS INT)) || tag FROM w WHERE left_ > 0) SELECT p_partkey, tag FROM w WHERE left_ = 0""",
    "unique_sources": f"SELECT regexp_replace({PAGE}, '\\.[^.]+$', '') AS stem, min(page_id) AS page_id FROM pages GROUP BY 1 HAVING count(*) = 1",
    "batch_rollup": f"""WITH {DET}, d AS (SELECT *, CAST(floor(frame / 900.0) AS BIGINT) AS part FROM det) SELECT role, part, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum, count(DISTINCT fid) AS users FROM d GROUP BY GROUPING SETS ((role), (part), (role, part), ())""",
    "task_steps": f"""WITH {DET}, s AS (SELECT det, CAST(sum(CASE WHEN role = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY frame, det) AS BIGINT) AS step FROM det) SELECT det, step, round(least(step / 12.0, 1.0), 6) AS progress FROM s""",
    "task_best": f"WITH {DET} SELECT det, max(k) OVER (PARTITION BY fid ORDER BY frame, det) AS best FROM det",
    "task_states": f"""WITH {DET}, t AS (SELECT fid, det, CASE k WHEN 99 THEN 'failed' WHEN 98 THEN 'done' WHEN 97 THEN 'cancelled' ELSE 'log' END AS kind, role, row_number() OVER (PARTITION BY fid ORDER BY det DESC) AS r FROM det),
        g AS (SELECT fid, coalesce(arg_max(kind, det) FILTER (WHERE kind <> 'log'), 'running') AS state, count(*) AS n, string_agg(CASE WHEN r <= 5 THEN role END, '|' ORDER BY det) AS lines FROM t GROUP BY fid)
        SELECT fid, state, n, CASE WHEN state = 'failed' THEN lines END AS tail FROM g""",
    "release_probe": f"WITH {DET}, {PROBE} SELECT * FROM probe",
    "landing_counts": f"WITH {DET}, {PROBE} SELECT reason, count(*) AS n, CAST(count_if(overlapped) AS BIGINT) AS overlapped FROM probe GROUP BY reason",
}

_IOU = """pairs AS (SELECT d.det, p.box, greatest(least(d.cx + {h}, p.x2) - greatest(d.cx - {h}, p.x1), 0) * greatest(least(d.cy + {h}, p.y2) - greatest(d.cy - {h}, p.y1), 0) AS common
    FROM det d JOIN persons p ON p.fid = d.fid AND p.day = CAST(floor(d.frame / 120.0) AS BIGINT) WHERE d.role = 'view')"""
_BEST = f"""WITH {DET}, {PERSONS}, {_IOU.format(h=300)}, scored AS (SELECT det, box, common / CAST(720000 - common AS DOUBLE) AS iou FROM pairs),
    best AS (SELECT *, row_number() OVER (PARTITION BY det ORDER BY iou DESC, box) AS pick FROM scored WHERE iou >= 0.3)"""
ORACLES |= {
    "box_iou_argmax": f"{_BEST} SELECT det, box, round(iou, 6) AS iou FROM best WHERE pick = 1",
    "unlinked_boxes": f"{_BEST} SELECT det FROM det WHERE role = 'view' AND det NOT IN (SELECT det FROM best)",
    "held_coverage": f"WITH {DET}, {PERSONS}, {_IOU.format(h=10)} SELECT det, round(max(common / 400.0), 6) AS coverage FROM pairs GROUP BY det HAVING max(common / 400.0) > 0.5",
}


def _probe(shift: int) -> str:
    """The probe's SQL with every anchor moved."""
    moved = PROBE.replace("frame AS anchor FROM det WHERE role = 'purchase'", f"frame + {shift} AS anchor FROM det WHERE role = 'purchase'")
    return f"SELECT goal, {shift} AS shift, reason, land_x, land_y FROM (WITH {DET}, {moved} SELECT * FROM probe)"


ORACLES |= {
    "page_assembly": """SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_name END, CASE WHEN n_regionkey > 1 THEN n_name END, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, '') AS prefill,
        CASE WHEN c_nationkey IS NULL THEN 'SKIP' ELSE 'ok' END AS status FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F'""",
    "gallery_audit": f"""WITH {DET}, f AS (SELECT fid AS number, CAST(floor(frame / 60.0) AS BIGINT) AS photo, det AS face, CASE WHEN k % 10 > 0 THEN cx % 300 END AS w, CASE WHEN k % 10 > 0 THEN cy % 200 END AS h FROM det),
        r AS (SELECT *, row_number() OVER (PARTITION BY number, photo ORDER BY w * h DESC NULLS LAST, face) AS pick FROM f)
        SELECT number, photo, CASE WHEN w IS NULL THEN 'no_face' WHEN w < 120 THEN 'too_small' ELSE 'kept' END AS verdict, CASE WHEN w >= 120 THEN CAST(face AS DOUBLE) END AS face FROM r WHERE pick = 1""",
    "cache_misses": "SELECT DISTINCT md5(text) AS digest FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
    "truth_classes": """WITH p AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS tag, min(CASE WHEN c_nationkey < 8 THEN '对手' WHEN c_nationkey < 16 THEN '主队' ELSE '便服' END) AS team FROM customer GROUP BY 1),
        a AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS tag FROM customer WHERE c_custkey % 10 <> 0)
        SELECT key, CASE WHEN team IN ('对手', '便服') THEN 'unjudgeable' WHEN regexp_matches(a.tag, '[0-9]') THEN 'ours_numbered' ELSE 'no_number' END AS truth FROM a JOIN p ON p.tag = a.tag""",
    "track_summary": f"""WITH {DET} SELECT fid, {DAY} AS track, count(*) AS n, min(frame) * 2 AS start_ds, (max(frame) - min(frame)) * 2 AS dur_ds, CAST(floor(CAST(sum(cx) AS DOUBLE) / count(*)) AS BIGINT) AS cx, CAST(floor(CAST(sum(cy) AS DOUBLE) / count(*)) AS BIGINT) AS cy FROM det GROUP BY 1, 2""",
    "cluster_rollup": f"""WITH {DET}, t AS (SELECT det, k % 12 AS cluster, frame, role FROM det UNION ALL SELECT det, k % 12 + 3, frame, role FROM det WHERE det % 5 = 0),
        f AS (SELECT det, min(cluster) AS cluster, min(frame) AS anchor FROM t WHERE role = 'purchase' GROUP BY det), r AS (SELECT cluster, count(*) AS n, min(anchor) AS first_anchor FROM f GROUP BY cluster)
        SELECT *, row_number() OVER (ORDER BY n DESC, first_anchor, cluster) AS position FROM r""",
    "goal_track_choice": f"""WITH {DET}, {GOALS}, p AS (SELECT goal, v.det AS track, v.k % 9 + 1 AS length, sqrt(CAST((v.cx - gx) * (v.cx - gx) + (v.cy - gy) * (v.cy - gy) AS DOUBLE)) AS dist FROM goals g JOIN det v ON v.fid = g.fid AND v.role = 'view'),
        q AS (SELECT *, min(dist) OVER (PARTITION BY goal) AS low FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY length DESC, dist, track) AS pick FROM q WHERE dist <= low + 300)
        SELECT goal, track, length FROM r WHERE pick = 1 AND dist <= 500""",
    "consistency_probe": f"""WITH runs AS ({_probe(0)} UNION ALL {_probe(-8)} UNION ALL {_probe(8)}),
        b AS (SELECT *, max(CASE WHEN shift = 0 THEN land_x END) OVER (PARTITION BY goal) AS bx, max(CASE WHEN shift = 0 THEN land_y END) OVER (PARTITION BY goal) AS by_ FROM runs)
        SELECT goal, bool_and(reason = '' AND sqrt((land_x - bx) * (land_x - bx) + (land_y - by_) * (land_y - by_)) <= 100) AS consistent, CAST(count_if(reason = '') AS BIGINT) AS hits FROM b GROUP BY goal""",
    "numbered_clips": "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS number, printf('%03d', row_number() OVER (ORDER BY o_custkey, o_orderkey)) AS clip, o_custkey % 7 > 0 AS present FROM orders WHERE o_orderstatus = 'P'",
    "audit_sample": "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY h, doc_id LIMIT 15",
    "selected_photos": f"""WITH {DET}, c AS (SELECT det AS id, fid, frame * 2 + 1 AS ds FROM det WHERE role = 'signup')
        SELECT id, printf('%03d_v%03d_t%04d.%d.jpg', row_number() OVER (ORDER BY fid, ds, id), fid, ds // 10, ds % 10) AS file_name FROM c UNION ALL SELECT unnest([10000000, 10000001, 10000002]), 'unknown'""",
    "nested_result": f"WITH {DET} SELECT fid, string_agg(frame || ':' || det || ':' || k, ',' ORDER BY frame, det) AS members FROM det WHERE role = 'purchase' GROUP BY fid",
    "team_rules": """WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, CAST(c_nationkey * 16 + 160 AS DOUBLE) / (c_nationkey * 9 + CASE WHEN c_custkey % 2 = 0 THEN 90 ELSE 120 END) AS ratio FROM customer)
        SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN '对手' WHEN 1 THEN '主队' ELSE '便服' END AS team, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '_x' ELSE '对手' END AS opponent,
               CASE WHEN abs(ratio / (16 / 9.0) - 1) <= 0.01 THEN '16:9' WHEN abs(ratio / (4 / 3.0) - 1) <= 0.01 THEN '4:3' END AS aspect FROM c""",
    "quality_gate": f"""WITH {DET}, r AS (SELECT det, conf, k, (cx + 1) / CAST(cy + 1 AS DOUBLE) AS ratio FROM det WHERE role = 'click')
        SELECT det, CASE WHEN ratio < 0.15 THEN 'narrow' WHEN ratio > 1.2 THEN 'wide' WHEN conf < 0.25 THEN 'no_person' ELSE '' END AS reason, CASE WHEN k / 100.0 >= 0.25 THEN '黑' WHEN conf >= 0.20 THEN '白' ELSE '便服' END AS team FROM r""",
    "scaled_boxes": f"""WITH {DET}, b AS (SELECT det, cx - 100 AS x1, cy - 100 AS y1, cx + 100 AS x2, cy + 100 AS y2 FROM det WHERE role = 'click'),
        s AS (SELECT *, greatest(0, least(CAST(round_even(x1 * 1.5, 0) AS BIGINT), 2880)) AS a1, greatest(0, least(CAST(round_even(y1 * 1.5, 0) AS BIGINT), 1620)) AS b1, greatest(0, least(CAST(round_even(x2 * 1.5, 0) AS BIGINT), 2880)) AS a2, greatest(0, least(CAST(round_even(y2 * 1.5, 0) AS BIGINT), 1620)) AS b2 FROM b)
        SELECT det, a1 AS x1, b1 AS y1, a2 AS x2, b2 AS y2, greatest(x1 - 50, 0) AS ex1, greatest(y1 - 50, 0) AS ey1, least(x2 + 50, 1920) AS ex2, least(y2 + 50, 1080) AS ey2, CAST(floor((a1 + a2) / 2.0) AS BIGINT) AS scx FROM s""",
    "event_hoop_distance": f"""WITH {DET}, {HOOPS}, v AS (SELECT fid, det, frame, cx, cy FROM det WHERE role = 'view'), h AS (SELECT v.det, min(hoop) AS hoop FROM v JOIN hoops ON hoops.fid = v.fid AND v.frame BETWEEN w0 AND w1 GROUP BY v.det)
        SELECT v.fid, {DAY} AS day, round(min(sqrt(CAST((v.cx - hx) * (v.cx - hx) + (v.cy - hy) * (v.cy - hy) AS DOUBLE))), 6) AS hoop_dist, max(v.frame) AS anchor FROM v LEFT JOIN h ON h.det = v.det LEFT JOIN hoops ON hoops.hoop = h.hoop GROUP BY 1, 2""",
    "probe_report": f"""WITH {DET}, {PROBE}, c AS (SELECT count(*) AS goals, CAST(count_if(reason = '') AS BIGINT) AS hits, CAST(count_if(at_edge) AS BIGINT) AS at_edge, round(avg(CASE WHEN reason = '' THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM probe) SELECT *, coverage >= 0.7 AS passed FROM c""",
}
