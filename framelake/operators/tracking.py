"""Greedy trackers: each file is one group, its frames in order; what matched before decides what can match next.

A group is one video file (some ten thousand rows), so a task holds a file and a cluster works on as many files at once
as it has cores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import ship_package


def link_nearest(frame: np.ndarray, x: np.ndarray, y: np.ndarray, *, gate: float, patience: int) -> np.ndarray:
    """Track number of every detection, which come by frame and then ordinal; -1 never occurs.

    Tracks, oldest first, take the nearest unclaimed detection strictly within ``gate``; one that found nothing in more
    than ``patience`` frames in a row, counting frames without detections, is over.
    """
    track = np.full(len(frame), -1, dtype=np.int64)
    live: list[tuple[int, int, int]] = []  # (track, last detection, last frame)
    made = 0
    bounds = np.flatnonzero(np.concatenate(([True], frame[1:] != frame[:-1], [True]))) if len(frame) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        now, free = int(frame[a]), list(range(a, b))
        kept = []
        for t, last, seen in live:
            if now - seen - 1 > patience:
                continue
            best, least = -1, gate
            for k in free:
                d = float(np.hypot(x[k] - x[last], y[k] - y[last]))
                if d < least:
                    best, least = k, d
            if best >= 0:
                free.remove(best)
                track[best] = t
                kept.append((t, best, now))
            else:
                kept.append((t, last, seen))
        for k in free:
            track[k] = made
            kept.append((made, k, now))
            made += 1
        live = kept
    return track


def track_balls(det: DataFrame, *, gate: float = 80.0, patience: int = 2, least: int = 4, file: str = "fid") -> DataFrame:
    """(fid, track, frame, det, cx, cy, conf) of tracks with ``least`` detections or more."""
    ship_package(det.sparkSession)
    schema = f"{file} long, track long, frame long, det long, cx long, cy long, conf double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "det"], kind="stable")
        numbers = link_nearest(pdf.frame.to_numpy(), pdf.cx.to_numpy(), pdf.cy.to_numpy(), gate=gate, patience=patience)
        pdf = pdf.assign(track=numbers)
        return pdf[pdf.groupby("track")["track"].transform("size") >= least][[file, "track", "frame", "det", "cx", "cy", "conf"]]

    return det.select(F.col(file).cast("long"), *[F.col(c).cast("long") for c in ("frame", "det", "cx", "cy")], F.col("conf").cast("double")).groupBy(file).applyInPandas(run, schema)


def _iou(a: np.ndarray, b: np.ndarray) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(w, 0) * max(h, 0)
    return common / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common)


def link_boxes(frame: np.ndarray, boxes: np.ndarray, *, max_gap: int, least_iou: float) -> np.ndarray:
    """Track number, from 1, of every box.

    A box chooses the live track seen last, then of larger overlap, then older; a track chosen by several boxes keeps the
    one of largest overlap, the first on ties, and the others open tracks of their own.
    """
    out = np.zeros(len(frame), dtype=np.int64)
    last: dict[int, tuple[int, int]] = {}  # track -> (frame, row)
    made = 0
    bounds = np.flatnonzero(np.concatenate(([True], frame[1:] != frame[:-1], [True]))) if len(frame) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        now = int(frame[a])
        last = {t: (f, r) for t, (f, r) in last.items() if now - f <= max_gap}
        winner: dict[int, tuple[float, int]] = {}
        for row in range(a, b):
            ranked = [(f, s, -t) for t, (f, r) in last.items() if (s := _iou(boxes[r], boxes[row])) >= least_iou]
            if ranked:
                _, s, t = max(ranked)
                if -t not in winner or s > winner[-t][0]:
                    winner[-t] = (s, row)
        for t, (_, row) in winner.items():
            out[row] = t
            last[t] = (now, row)
        for row in range(a, b):
            if not out[row]:
                made += 1
                out[row] = made
                last[made] = (now, row)
    return out


def track_persons(boxes: DataFrame, *, max_gap: int = 10, least_iou: float = 0.3, file: str = "fid") -> DataFrame:
    """(fid, track, frame, box, x1, y1, x2, y2) of every box."""
    if max_gap < 1 or not 0 < least_iou <= 1:
        raise ValueError("max_gap is at least 1 and least_iou within (0, 1]")
    ship_package(boxes.sparkSession)
    names = ["frame", "box", "x1", "y1", "x2", "y2"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "box"], kind="stable")
        numbers = link_boxes(pdf.frame.to_numpy(), pdf[["x1", "y1", "x2", "y2"]].to_numpy(), max_gap=max_gap, least_iou=least_iou)
        return pdf.assign(track=numbers)[[file, "track", *names]]

    schema = f"{file} long, track long, " + ", ".join(f"{n} long" for n in names)
    return boxes.select(F.col(file).cast("long"), *[F.col(c).cast("long") for c in names]).groupBy(file).applyInPandas(run, schema)


def trace(frames: dict[int, list[tuple[int, np.ndarray]]], seed_frame: int, seed: np.ndarray, *, span: int, least_iou: float) -> dict[int, np.ndarray]:
    """The chain of best-overlapping boxes from a seed, ``span`` frames each way, up to the first break."""
    chain = {seed_frame: seed}
    for step in (-1, 1):
        link = seed
        for f in range(seed_frame + step, seed_frame + step * (span + 1), step):
            scored = [(_iou(b, link), -k) for k, b in frames.get(f, [])]
            if not scored or max(scored)[0] < least_iou:
                break
            link = dict(frames[f])[-max(scored)[1]]
            chain[f] = link
    return chain


def trace_persons(boxes: DataFrame, seeds: DataFrame, *, span: int = 10, least_iou: float = 0.3, file: str = "fid") -> DataFrame:
    """(fid, seed, frame, x1, y1, x2, y2): the chain of every seed (fid, seed, frame, x1, y1, x2, y2)."""
    ship_package(boxes.sparkSession)
    cols = ["x1", "y1", "x2", "y2"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames: dict[int, list] = {}
        for r in left.sort_values(["frame", "box"]).itertuples():
            frames.setdefault(r.frame, []).append((r.box, np.array([r.x1, r.y1, r.x2, r.y2])))
        out = []
        for s in right.itertuples():
            chain = trace(frames, s.frame, np.array([s.x1, s.y1, s.x2, s.y2]), span=span, least_iou=least_iou)
            out += [(key[0], s.seed, f, *map(int, chain[f])) for f in sorted(chain)]
        return pd.DataFrame(out, columns=[file, "seed", "frame", *cols])

    a = boxes.select(F.col(file).cast("long"), *[F.col(c).cast("long") for c in ["frame", "box", *cols]])
    b = seeds.select(F.col(file).cast("long"), *[F.col(c).cast("long") for c in ["seed", "frame", *cols]])
    schema = f"{file} long, seed long, frame long, x1 long, y1 long, x2 long, y2 long"
    return a.groupBy(file).cogroup(b.groupBy(file)).applyInPandas(run, schema)


def walk_hoop(frames: list[tuple[int, list[tuple[int, int]]]], anchor: tuple[int, int], at: int, max_jump: float) -> list[tuple[int, int, int]]:
    """Hoop positions from the detected frame nearest in time, followed both ways until a jump."""
    seen = [(f, ps) for f, ps in frames if ps]
    if not seen:
        return []
    near = lambda ps, p: min(ps, key=lambda q: (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2)
    start = min(range(len(seen)), key=lambda k: abs(seen[k][0] - at))
    found = {start: near(seen[start][1], anchor)}
    for way in (range(start + 1, len(seen)), range(start - 1, -1, -1)):
        here = found[start]
        for k in way:
            nxt = near(seen[k][1], here)
            if np.hypot(nxt[0] - here[0], nxt[1] - here[1]) > max_jump:
                break
            found[k] = here = nxt
    return [(seen[k][0], *found[k]) for k in sorted(found)]


def track_hoops(hoops: DataFrame, events: DataFrame, *, max_jump: float = 150.0, file: str = "fid") -> DataFrame:
    """(fid, event, frame, cx, cy): the hoop track of every event (fid, event, at, anchor_x, anchor_y, low, high)."""
    ship_package(hoops.sparkSession)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = left.sort_values(["frame", "det"])
        out = []
        for e in right.itertuples():
            part = rows[(rows.frame >= e.low) & (rows.frame <= e.high)]
            frames = [(int(f), list(zip(g.cx, g.cy, strict=True))) for f, g in part.groupby("frame")]
            out += [(key[0], e.event, *map(int, p)) for p in walk_hoop(frames, (e.anchor_x, e.anchor_y), e.at, max_jump)]
        return pd.DataFrame(out, columns=[file, "event", "frame", "cx", "cy"])

    a = hoops.select(F.col(file).cast("long"), *[F.col(c).cast("long") for c in ("frame", "det", "cx", "cy")])
    b = events.select(F.col(file).cast("long"), *[F.col(c).cast("long") for c in ("event", "at", "anchor_x", "anchor_y", "low", "high")])
    return a.groupBy(file).cogroup(b.groupBy(file)).applyInPandas(run, f"{file} long, event long, frame long, cx long, cy long")
