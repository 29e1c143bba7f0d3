"""Repeated byte strings by a run-length compressed Burrows-Wheeler index.

Bytes covered by a string of ``need`` bytes that starts anywhere else are removed.

1. Winnowing.  Of the k-grams in every window of ``need`` bytes the one with the smallest hash is its anchor, so equal
   windows have equal anchors at equal offsets.  The windows of one anchor form a context.  Windows that equal an earlier
   one of the same document (found through anchors that recur) are marked at once and give no context.
2. Contexts whose anchor occurs once in the corpus cannot repeat.  Equal contexts are collapsed with a count before they
   are shuffled; a context counted twice is repeated whole.
3. Anchors with several different contexts are indexed: the contexts' bytes are fetched and dealt to shards by anchor.
   A shard builds the suffix order of its contexts and keeps the Burrows-Wheeler transform by its runs: the text positions
   at run heads and run ends, and the match length with the neighbouring row there.  Within a run the match length of a
   text position is that of the position before it less one, so matching statistics stream along the text from those
   samples, and starts with ``need`` or more are marked.  An anchor with over ``ALONE`` contexts is a shard of its own, so
   frequent anchors do not gather in one task; one with more contexts than ``crowd`` is not put in one shard: its windows
   are hashed (128 bits) and counted instead.
4. The marks of each text are joined with it again and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import ship_package

from .common import staged

NEED, GRAM = 200, 48
BASE = 0x9E3779B97F4A7C15 | 1
SHARD_BYTES, PART, ALONE = 2 << 20, 1 << 21, 200


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a buffer, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.down = _powers(n, pow(BASE, -1, 1 << 64))
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n - 1, BASE), out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of the substring of ``size`` bytes at every place."""
        return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def contexts(texts: list[bytes], need: int = NEED, gram: int = GRAM) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """([text number, anchor hash, context hash, first window, last window], [text number, first, last window]):
    the contexts to compare with other texts, and the runs of windows found repeated within their text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    kept = np.flatnonzero(sizes >= need)
    empty = [np.empty(0, dtype=np.int64)] * 5
    if not len(kept):
        return empty, empty[:3]
    data = np.frombuffer(b"".join(texts[k] for k in kept), dtype=np.uint8)
    ends = np.cumsum(sizes[kept])
    starts = ends - sizes[kept]
    hashes, width = Hashes(data), need - gram + 1
    grams = _mixed(hashes.all(gram))
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = _sliding_min((grams & ~low) | place, width)  # by hash, then leftmost; a part has under 2**24 bytes
    owner = (least & low).astype(np.int64)
    inside = np.zeros(len(owner) + 1, dtype=np.int64)  # windows that lie within one text
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - need + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]))
    owner = owner[window]
    text = np.searchsorted(ends, window, side="right")
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]))))
    anchor, of = owner[first], text[first]
    run = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(window)]))))
    # the earlier anchor with the same hash in the same text, if any
    order = np.lexsort((anchor, grams[anchor], of))
    same = (grams[anchor][order][1:] == grams[anchor][order][:-1]) & (of[order][1:] == of[order][:-1])
    back = np.zeros(len(anchor), dtype=np.int64)
    back[order[1:][same]] = (anchor[order][1:] - anchor[order][:-1])[same]
    shift = back[run]
    again = np.zeros(len(window), dtype=bool)
    ask = np.flatnonzero((shift > 0) & (window - shift >= starts[text]))
    if len(ask):
        w, s = window[ask], shift[ask]
        again[ask] = hashes.some(w, w + need) == hashes.some(w - s, w - s + need)
    repeated = np.zeros(len(data), dtype=bool)
    repeated[window[again]] = True
    repeated[window[again] - shift[again]] = True
    marks = _runs(repeated, ends)
    # a context spans the windows of an anchor that are new to the text
    new = np.flatnonzero(~again)
    head = np.flatnonzero(np.concatenate(([True], run[new][1:] != run[new][:-1]))) if len(new) else new
    tail = np.concatenate((head[1:], [len(new)])) - 1 if len(new) else new
    a, b = window[new[head]], window[new[tail]]
    at = anchor[run[new[head]]]
    t = text[new[head]]
    code = hashes.some(a, b + need) ^ _mixed((at - a).astype(np.uint64) + np.uint64(7))
    rows = [kept[t], grams[at].view(np.int64), code.view(np.int64), a - starts[t], b - starts[t]]
    of_mark = np.searchsorted(ends, marks[0], side="right")
    return rows, [kept[of_mark], marks[0] - starts[of_mark], marks[1] - starts[of_mark]]


def _runs(flags: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of every run of true flags; a run ends where a text ends."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (np.searchsorted(ends, at[1:], side="right") != np.searchsorted(ends, at[:-1], side="right")))
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling from three symbols on; only suffixes not yet told apart are sorted again."""
    n = len(symbols)
    s = np.concatenate((symbols.astype(np.int64) + 1, [0, 0]))
    key = s[:-2] << 42 | s[1:-1] << 21 | s[2:]
    order = np.argsort(key)
    rank, size = np.empty(n, dtype=np.int64), 3
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    slots = np.arange(n)
    while True:
        alone = fresh & np.concatenate((fresh[1:], [True]))
        slots = slots[~alone]
        if not len(slots):
            return order
        open_ = order[slots]
        after = np.where(open_ + size < n, rank[np.minimum(open_ + size, n - 1)] + 1, 0)
        key = rank[open_] << 32 | after
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        order[slots] = open_
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[open_] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        size *= 2


def matching_statistics(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(for every place of the joined pieces the length of its longest match at another place, starts of the pieces).

    The index holds the transform by its runs: positions and match lengths are known at run heads and ends only.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    data = np.frombuffer(b"\0".join(pieces) + b"\0" * 9, dtype=np.uint8)
    n = int(sizes.sum()) + len(pieces)
    symbols = data[:n].astype(np.int64)
    closing = starts + sizes
    symbols[closing] = 256 + np.arange(len(pieces))  # every piece ends with a symbol of its own
    room = np.repeat(closing, sizes + 1) - np.arange(n)
    order = suffix_order(symbols)
    transform = symbols[order - 1]
    change = np.flatnonzero(transform[1:] != transform[:-1])  # between rows j and j + 1
    eight = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        eight |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    lengths = _common_prefix(order[change], order[change + 1], eight, room)
    best = np.zeros(n, dtype=np.int64)
    # run heads against the row above, run ends against the row below; beyond the first and last row nothing matches
    for places, border in ((order[change + 1], order[0]), (order[change], order[-1])):
        sample = np.full(n, -1, dtype=np.int64)
        sample[places], sample[border] = lengths, 0
        last = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), -1))
        value = np.where(last >= 0, sample[last] - (np.arange(n) - last), 0)
        best = np.maximum(best, value)
    return best, starts


def _common_prefix(a: np.ndarray, b: np.ndarray, eight: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, eight bytes a step."""
    most = np.minimum(room[a], room[b])
    out, active = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    while len(active):
        x, y = a[active] + out[active], b[active] + out[active]
        differ = eight[x] ^ eight[y]
        lowest = differ & (~differ + np.uint64(1))
        step = np.where(differ == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        out[active] += step
        active = active[(step == 8) & (out[active] < most[active])]
    return np.minimum(out, most)


MARKED = "k1 long, k2 long, h long, c long, first int, last int"


def find_contexts(docs: DataFrame, need: int) -> DataFrame:
    """Contexts of every row (h and c given) and runs of windows repeated within it (h null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, first = [], 0, at
                while at < batch.num_rows:
                    body = (batch.column(2)[at].as_py() or "").encode()
                    if texts and size + len(body) > PART:
                        break
                    texts.append(body)
                    size += len(body)
                    at += 1
                for lo, rows, marks in _pieces(texts, need):
                    k1, k2 = (batch.column(k).slice(first, len(texts)).to_numpy(zero_copy_only=False) for k in (0, 1))
                    t = np.concatenate((rows[0], marks[0])).astype(np.int64)
                    null = np.concatenate((np.zeros(len(rows[0]), bool), np.ones(len(marks[0]), bool)))
                    h, c = (pa.array(np.concatenate((rows[k], np.zeros(len(marks[0]), np.int64))), pa.int64(), mask=null) for k in (1, 2))
                    ints = [pa.array((np.concatenate((rows[3 + k], marks[1 + k])) + lo).astype(np.int32)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(k1[t]), pa.array(k2[t]), h, c, *ints], [x.split()[0] for x in MARKED.split(", ")])

    return docs.select("k1", "k2", "text").mapInArrow(run, MARKED)


def _pieces(texts: list[bytes], need: int) -> Iterator[tuple[int, list, list]]:
    """A single text beyond the part size is taken in overlapping stretches, so that every window is in one."""
    if len(texts) > 1 or len(texts[0]) < 2 * PART - need:
        yield 0, *contexts(texts, need)
        return
    for lo in range(0, len(texts[0]) - need + 1, PART):
        yield lo, *contexts([texts[0][lo : lo + PART + need - 1]], need)


def remove_repeats(docs: DataFrame, *, need: int = NEED, crowd: int = 2500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    A null text is empty and a text of under ``need`` bytes keeps all; repeated rows are each other's copies, so texts of
    ``need`` bytes or more among them go whole; a null id is kept; an empty table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), F.col(text)).alias("k2"))
    found = staged(find_contexts(keyed, need), "suffix-contexts")
    rows = found.where("h IS NOT NULL")
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = staged(rows.join(often, "h", "left_semi"), "suffix-shared")
    groups = staged(shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "last")).alias("at")), "suffix-groups")
    whole = shared.join(groups.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("k1", "k2", "first", "last")
    # anchors with several contexts, of which at least one stands alone
    mixed = groups.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("h", "m")
    asked = groups.join(mixed, "h").select("h", "m", "n", "at.*")
    wanted = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "m", "n", "first", "last")).alias("asked"))
    bodies = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"])
    cut = f"transform(asked, a -> struct(a.h AS h, a.m AS m, a.n AS n, a.first AS first, substring(cast(text AS binary), a.first + 1, a.last - a.first + {need}) AS bytes))"
    pieces = bodies.select("k1", "k2", F.explode(F.expr(cut)).alias("p")).select("k1", "k2", "p.*").dropDuplicates(["k1", "k2", "h", "first"])
    pieces = staged(pieces, "suffix-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))

    def index(batch: pa.Table) -> pa.Table:
        bytes_ = batch.column("bytes").to_pylist()
        lengths, starts = matching_statistics(bytes_)
        flags = lengths >= need
        first, last = _runs(flags, np.concatenate((starts[1:], [len(flags)])))
        piece_ = np.searchsorted(starts, first, side="right") - 1
        alone = batch.column("n").to_numpy()[piece_] == 1
        piece_, first, last = piece_[alone], first[alone], last[alone]
        offset = batch.column("first").to_numpy()[piece_] - starts[piece_]
        return pa.table({"k1": batch.column("k1").to_numpy()[piece_], "k2": batch.column("k2").to_numpy()[piece_], "first": (first + offset).astype(np.int32), "last": (last + offset).astype(np.int32)})

    few = pieces.where(F.col("m") <= crowd).withColumn("shard", F.when(F.col("m") > ALONE, F.col("h")).otherwise(F.pmod("h", F.lit(shards))))
    marks = found.where("h IS NULL").select("k1", "k2", "first", "last").unionByName(whole)
    marks = marks.unionByName(few.groupBy("shard").applyInArrow(index, "k1 long, k2 long, first int, last int"))
    hot = pieces.where(F.col("m") > crowd)
    if not hot.isEmpty():
        opened = hot.select("k1", "k2", "n", "first", "bytes", F.explode(F.expr(f"sequence(0, octet_length(bytes) - {need})")).alias("o"))
        opened = opened.select("k1", "k2", "n", (F.col("first") + F.col("o")).cast("int").alias("first"), F.expr(f"substring(bytes, o + 1, {need})").alias("w"))
        opened = opened.select("k1", "k2", "n", "first", F.xxhash64("w").alias("w1"), F.xxhash64(F.lit("second"), "w").alias("w2"))
        seen = opened.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1")
        marks = marks.unionByName(opened.join(seen, ["w1", "w2"], "left_semi").select("k1", "k2", "first", F.col("first").alias("last")))
    gathered = staged(marks.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("marks")), "suffix-marks")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, m in zip(batch.column(1), batch.column(2), strict=True):
                out.append(without((x.as_py() or "").encode(), [(r["first"], r["last"]) for r in m.as_py() or []], need))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return keyed.join(gathered, ["k1", "k2"], "left").select("doc_id", "text", "marks").mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without(data: bytes, marks: list[tuple[int, int]], need: int) -> tuple[int, int, int, str]:
    """(bytes, removed, runs removed, digest of the rest); marks are runs of windows, by their first bytes."""
    kept, at, removed, spans, end = hashlib.sha256(), 0, 0, 0, -1
    for first, last in sorted(marks):
        if first > end:
            kept.update(data[max(at, 0) : first])
            spans += 1
            removed += last + need - first
        else:
            removed += max(0, last + need - end)
        end = max(end, last + need)
        at = end
    kept.update(data[at:])
    return len(data), removed, spans, kept.hexdigest()
