"""Where a goal was shot from: cascades over ball tracks, person boxes and chains.

A group is one file, whose rows are sorted once for all its goals; only files with goals are shuffled.  The release probe
needs no group and is a chain of joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions.geometry import inside, iou
from framelake.session import ship_package

from .joins import nearest, range_join
from .segments import frame_best, stable_segments
from .tracking import link_nearest, trace

RESULT = "goal long, path string, reason string, frame long, x1 long, y1 long, x2 long, y2 long, track_length long, n_tracks long"


def choose_track(ends: list[tuple[int, float, int]], *, longer: bool, slack: float, most: float | None) -> int | None:
    """Of (track, distance, length) the nearest, or with ``longer`` the longest within ``slack`` of the nearest; the first
    on ties; none if its distance exceeds ``most``."""
    if not ends:
        return None
    best = min(ends, key=lambda e: e[1])
    if longer:
        best = max((e for e in ends if e[1] <= best[1] + slack), key=lambda e: (e[2], -e[1]))
    return None if most is not None and best[1] > most else best[0]


def goal_tracks(tracks: DataFrame, *, longer: bool = False, slack: int = 100, most: float | None = 200.0) -> DataFrame:
    """The chosen track of every goal from (goal, track, dist, length), relationally: pool, then rank."""
    low = F.min("dist").over(Window.partitionBy("goal"))
    pool = tracks.withColumn("__low", low).where(F.col("dist") <= F.col("__low") + (slack if longer else 0)).drop("__low")
    order = [F.desc("length"), F.col("dist"), F.col("track")] if longer else [F.col("dist"), F.col("track")]
    best = nearest(pool, by=["goal"], order=order)
    return best if most is None else best.where(F.col("dist") <= most)


@dataclass
class File:
    """The detections and person boxes of one file, by frame and ordinal."""

    frame: np.ndarray
    x: np.ndarray
    y: np.ndarray
    boxes: dict[int, list[tuple[int, np.ndarray]]]

    def tracks(self, low: int, high: int, gate: float) -> list[np.ndarray]:
        """Row numbers of the tracks that the window's detections form."""
        a, b = np.searchsorted(self.frame, [low, high + 1])
        numbers = link_nearest(self.frame[a:b], self.x[a:b], self.y[a:b], gate=gate, patience=2)
        order = np.argsort(numbers, kind="stable")
        return [a + part for part in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)] if b > a else []

    def holder(self, track: np.ndarray) -> tuple[int, np.ndarray] | None:
        """The last point of the track inside a box of its frame."""
        for r in track[::-1]:
            for _, b in self.boxes.get(int(self.frame[r]), []):
                if b[0] <= self.x[r] <= b[2] and b[1] <= self.y[r] <= b[3]:
                    return int(self.frame[r]), b
        return None

    def start(self, track: np.ndarray) -> tuple[int, np.ndarray] | None:
        """The box nearest to the track's first point."""
        r = track[0]
        found = self.boxes.get(int(self.frame[r]), [])
        if not found:
            return None
        return int(self.frame[r]), min(found, key=lambda kb: np.hypot(self.x[r] - (kb[1][0] + kb[1][2]) // 2, self.y[r] - (kb[1][1] + kb[1][3]) // 2))[1]

    def pick(self, tracks: list[np.ndarray], anchor: int, xy: tuple[float, float] | None, longer: bool, slack_px: float, slack_f: float, most: float) -> np.ndarray | None:
        ends = [t[-1] for t in tracks]
        if xy is None:
            chosen = choose_track([(k, abs(float(self.frame[r]) - anchor), len(tracks[k])) for k, r in enumerate(ends)], longer=longer, slack=slack_f, most=None)
        else:
            chosen = choose_track([(k, float(np.hypot(self.x[r] - xy[0], self.y[r] - xy[1])), len(tracks[k])) for k, r in enumerate(ends)], longer=longer, slack=slack_px, most=most)
        return None if chosen is None else tracks[chosen]


def locate(file: File, anchor: int, xy: tuple | None, *, before: int, after: int, gate: float, most: float) -> tuple:
    """(path, reason, frame, box or None, track length, tracks): the last holder on the goal's track, else the box nearest
    to where the track starts."""
    tracks = file.tracks(anchor - before, anchor + after, gate)
    if not tracks:
        return "", "no_track", -1, None, 0, 0
    track = file.pick(tracks, anchor, xy, False, 0, 0, most)
    if track is None:
        return "", "no_track_near_anchor", -1, None, 0, len(tracks)
    held = file.holder(track)
    if held:
        return "held", "", *held, len(track), len(tracks)
    start = file.start(track)
    return ("start", "start_fallback", *start, len(track), len(tracks)) if start else ("", "no_person", -1, None, len(track), len(tracks))


def land(file: File, anchor: int, xy: tuple | None, *, before: int, after: int, gate: float, most: float, held_before: int, release: int, tolerance: int, start_before: int, span: int, least_iou: float) -> tuple:
    """The shooter's box one second before the anchor: by the chain from the last holder, else where the track starts."""
    tracks = file.tracks(anchor - before, anchor + after, gate)
    if not tracks:
        return "", "no_track", -1, None, 0, 0
    track = file.pick(tracks, anchor, xy, True, 100, 5, most)
    if track is None and xy is not None:
        track = file.pick(tracks, anchor, None, True, 100, 5, most)
    if track is None:
        return "", "no_track_near_anchor", -1, None, 0, len(tracks)
    size = (len(track), len(tracks))
    early = track[file.frame[track] <= anchor - held_before]
    seed = (file.holder(early) or file.start(early)) if len(early) else None
    if seed:
        chain = trace(file.boxes, *seed, span=span, least_iou=least_iou)
        frame = min(sorted(chain), key=lambda f: abs(f - (anchor - release)))
        if abs(frame - (anchor - release)) <= tolerance:
            return "trace", "", frame, chain[frame], *size
    first = int(file.frame[track[0]])
    if anchor - first >= start_before and file.boxes.get(first):
        return "track_start", "", first, file.start(track)[1], *size
    return "", "no_landing", -1, None, *size


def _per_goal(goals: DataFrame, det: DataFrame, persons: DataFrame, judge: Callable[[File, int, tuple | None], tuple]) -> DataFrame:
    ship_package(goals.sparkSession)
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    whole = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
    rows = goals.select(*whole("fid"), F.lit(0).alias("kind"), F.col("anchor").cast("long").alias("frame"), F.col("goal").cast("long").alias("ord"), F.col("ax").cast("long").alias("a"), F.col("ay").cast("long").alias("b"), *none("c", "d"))
    rows = rows.unionByName(det.select(*whole("fid"), F.lit(1).alias("kind"), *whole("frame"), F.col("det").cast("long").alias("ord"), F.col("cx").cast("long").alias("a"), F.col("cy").cast("long").alias("b"), *none("c", "d")))
    rows = rows.unionByName(persons.select(*whole("fid"), F.lit(2).alias("kind"), *whole("frame"), F.col("box").cast("long").alias("ord"), F.col("x1").cast("long").alias("a"), F.col("y1").cast("long").alias("b"), F.col("x2").cast("long").alias("c"), F.col("y2").cast("long").alias("d")))
    rows = rows.join(goals.select(*whole("fid")).distinct(), "fid", "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "frame", "ord"], kind="stable")
        kind, frame, ordinal = (pdf[c].to_numpy() for c in ("kind", "frame", "ord"))
        a, b, c, d = (pdf[n].to_numpy(dtype=np.float64) for n in "abcd")
        boxes: dict[int, list] = {}
        for k in np.flatnonzero(kind == 2):
            boxes.setdefault(int(frame[k]), []).append((int(ordinal[k]), np.array([a[k], b[k], c[k], d[k]])))
        balls = kind == 1
        file, out = File(frame[balls], a[balls], b[balls], boxes), []
        for k in np.flatnonzero(kind == 0):
            path, reason, at, box, length, n = judge(file, int(frame[k]), None if np.isnan(a[k]) else (a[k], b[k]))
            out.append((int(ordinal[k]), path, reason, int(at), *([-1] * 4 if box is None else map(int, box)), length, n))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return rows.groupBy("fid").applyInPandas(run, RESULT)


def locate_scorers(goals: DataFrame, det: DataFrame, persons: DataFrame, *, before: int = 20, after: int = 2, gate: float = 80.0, most: float = 200.0) -> DataFrame:
    """One row for every goal (fid, goal, anchor, ax, ay): who held the ball last."""
    return _per_goal(goals, det, persons, lambda file, anchor, xy: locate(file, anchor, xy, before=before, after=after, gate=gate, most=most))


def find_landings(goals: DataFrame, det: DataFrame, persons: DataFrame, *, before: int = 20, after: int = 2, gate: float = 250.0, most: float = 200.0, held_before: int = 2, release: int = 5, tolerance: int = 1, start_before: int = 4, span: int = 10, least_iou: float = 0.3) -> DataFrame:
    """One row for every goal: where the shot was released."""
    rules = {"before": before, "after": after, "gate": gate, "most": most, "held_before": held_before, "release": release, "tolerance": tolerance, "start_before": start_before, "span": span, "least_iou": least_iou}
    return _per_goal(goals, det, persons, lambda file, anchor, xy: land(file, anchor, xy, **rules))


def probe_releases(goals: DataFrame, det: DataFrame, persons: DataFrame, *, low: int = 2, high: int = 12, max_gap: int = 2, max_step: float = 60.0, edge: int = 8, width: int = 1920, height: int = 1080, least_iou: float = 0.1) -> DataFrame:
    """The last frame of the last stable ball segment before a goal and the box that holds it there.

    (goal, reason, frame, box, land_x, land_y, at_edge, overlapped); entirely relational.
    """
    seen = range_join(det, goals.select("fid", "goal", "anchor"), keys=["fid"], at="frame", low=F.col("anchor") - high, high=F.col("anchor") - low, width=high - low + 1)
    best = frame_best(seen, keys=["goal", "frame"])
    segs = stable_segments(best, keys=["goal"], max_gap=max_gap, max_step=max_step)
    last = nearest(segs, by=["goal"], order=[F.desc("seg"), F.desc("frame")]).select("goal", "fid", "frame", "cx", "cy")
    corner = F.struct("x1", "y1", "x2", "y2")
    boxes = persons.select("fid", "frame", "box", corner.alias("b"))
    held = nearest(last.join(boxes, ["fid", "frame"]).where(inside(F.col("cx"), F.col("cy"), F.col("b"))), by=["goal"], order=[F.col("box")]).select("goal", "fid", "frame", "box", "b")
    others = boxes.select("fid", "frame", F.col("box").alias("other"), F.col("b").alias("o"))
    crowded = held.join(others, ["fid", "frame"]).where((F.col("other") != F.col("box")) & (iou(F.col("b"), F.col("o")) >= least_iou)).select("goal").distinct().withColumn("over", F.lit(True))
    found = held.join(crowded, "goal", "left").select("goal", "box", "b", F.coalesce("over", F.lit(False)).alias("overlapped"))
    out = goals.select("goal").join(seen.select("goal").distinct().withColumn("seen", F.lit(True)), "goal", "left").join(last.select("goal", "frame"), "goal", "left").join(found, "goal", "left")
    reason = F.when(F.col("seen").isNull(), "no_ball").when(F.col("frame").isNull(), "no_stable_segment").when(F.col("box").isNull(), "no_holder").otherwise("")
    at_edge = (F.col("b.x1") <= edge) | (F.col("b.y1") <= edge) | (F.col("b.x2") >= width - edge) | (F.col("b.y2") >= height - edge)
    hit = reason == ""
    return out.select(
        "goal", reason.alias("reason"), F.when(hit, F.col("frame")).otherwise(-1).alias("frame"), F.when(hit, F.col("box")).otherwise(-1).alias("box"),
        F.when(hit, (F.col("b.x1") + F.col("b.x2")) / 2.0).otherwise(-1.0).alias("land_x"), F.when(hit, F.col("b.y2").cast("double")).otherwise(-1.0).alias("land_y"),
        F.coalesce(at_edge, F.lit(False)).alias("at_edge"), F.coalesce("overlapped", F.lit(False)).alias("overlapped"),
    )


def density_grid(points: DataFrame, grid: DataFrame, *, by: list[str], sigma: float = 0.9, digits: int = 9) -> DataFrame:
    """(by..., gx, gy, density): the sum of Gaussians of all points (x, y) at every grid cell (gx, gy)."""
    dx, dy = F.col("gx") - F.col("x"), F.col("gy") - F.col("y")
    pairs = points.join(grid)  # every cell feels every point; the grid is the fixed, small side
    return pairs.groupBy(*by, "gx", "gy").agg(F.round(F.sum(F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))), digits).alias("density"))


def zone_shares(points: DataFrame, zones: DataFrame, *, by: str, zone: str = "zone") -> DataFrame:
    """(by, zone, n, share, shade) for every zone of every group, empty ones too."""
    counts = points.groupBy(by, zone).agg(F.count("*").alias("n"))
    frame = points.select(by).distinct().join(zones.select(zone))  # ten zones for each group
    full = frame.join(counts, [by, zone], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    top = F.max("share").over(Window.partitionBy(by))
    return full.withColumn("shade", F.round(F.when(F.col("n") > 0, 0.25 + 0.75 * F.sqrt(F.col("share") / top)).otherwise(0.0), 6)).withColumn("share", F.round("share", 6))
