"""Language identification by a bidirectional gated recurrent network over bytes.

A document is cut into segments of ``STEPS`` bytes, so its whole text is read with bounded state; both directions run
over every segment and ``WARM`` bytes of the text before and after it, which only warm up the state, so that labels hang on
what surrounds a byte and not on where a segment ends.  Every byte position is labelled with a distribution over languages,
and the distributions of all letter bytes of a document are pooled to its probabilities.  The network is trained in numpy
by backpropagation through time on a bounded sample: at most ``per_lang`` documents of each language, chosen by a hash of id
and text, of which ``windows`` windows of ``WINDOW`` characters spread over the whole text are read (all of it, up to 1,920
characters).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.session import ship_package

HIDDEN, STEPS, WARM, LANES, WINDOW = 8, 128, 16, 2048, 240


def byte_map() -> np.ndarray:
    """A-Z are read as a-z and all digits alike."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[48:58] = 48
    return out


def counted_bytes() -> np.ndarray:
    """1 for bytes whose positions count: ASCII letters and all bytes beyond ASCII."""
    out = np.zeros(256, dtype=np.float32)
    out[65:91] = out[97:123] = out[128:] = 1
    return out


@dataclass
class Network:
    """Weights of both directions and of the label layer; gates stand in the order update, reset, candidate."""

    langs: list[str]
    inputs: list[np.ndarray]  # (3H, 256) for each direction
    states: list[np.ndarray]  # (3H, H)
    biases: list[np.ndarray]  # (H, 1), of the candidate's state part
    labels: list[np.ndarray]  # (C, H)
    label_bias: np.ndarray  # (C, 1)

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, *self.biases, *self.labels, self.label_bias]


def _start(langs: list[str], seed: int) -> Network:
    rng = np.random.default_rng(seed)
    h, c = HIDDEN, len(langs)
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    zero = lambda *s: np.zeros(s, dtype=np.float32)
    return Network(langs, [draw(3 * h, 256), draw(3 * h, 256)], [draw(3 * h, h), draw(3 * h, h)], [zero(h, 1), zero(h, 1)], [draw(c, h), draw(c, h)], zero(c, 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(net: Network, d: int, data: np.ndarray) -> list[tuple]:
    """Forward through time in direction ``d`` (0 onwards, 1 backwards); what backpropagation needs of every step."""
    h, trace = np.zeros((HIDDEN, data.shape[1]), dtype=np.float32), []
    for t in range(len(data)) if d == 0 else range(len(data) - 1, -1, -1):
        x, q = net.inputs[d][:, data[t]], net.states[d] @ h
        z, r = _sigmoid(x[:HIDDEN] + q[:HIDDEN]), _sigmoid(x[HIDDEN : 2 * HIDDEN] + q[HIDDEN : 2 * HIDDEN])
        s = q[2 * HIDDEN :] + net.biases[d]
        n = np.tanh(x[2 * HIDDEN :] + r * s)
        trace.append((t, h, z, r, s, n))
        h = n + z * (h - n)
        trace[-1] += (h,)
    return trace


def _gradients(net: Network, data: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Cross-entropy over counted positions and its gradient by backpropagation through time."""
    traces = [_run(net, d, data) for d in (0, 1)]
    outs = [{step[0]: step[6] for step in trace} for trace in traces]
    total, loss = float(weight.sum()) or 1.0, 0.0
    errors = {}
    g = [np.zeros_like(w) for w in net.weights()]
    lanes = np.arange(data.shape[1])
    for t in range(len(data)):
        logits = net.labels[0] @ outs[0][t] + net.labels[1] @ outs[1][t] + net.label_bias
        p = np.exp(logits - logits.max(axis=0))
        p /= p.sum(axis=0)
        loss -= float((np.log(p[target, lanes] + 1e-9) * weight[t]).sum())
        p[target, lanes] -= 1
        p *= weight[t] / total
        errors[t] = p
        g[6] += p @ outs[0][t].T
        g[7] += p @ outs[1][t].T
        g[8] += p.sum(axis=1, keepdims=True)
    for d in (0, 1):
        back = np.zeros((HIDDEN, data.shape[1]), dtype=np.float32)
        for t, before, z, r, s, n, _ in reversed(traces[d]):
            dh = back + net.labels[d].T @ errors[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr = dh * (before - n) * z * (1 - z), dn * s * r * (1 - r)
            ds = dn * r
            dx, dq = np.concatenate((dz, dr, dn)), np.concatenate((dz, dr, ds))
            np.add.at(g[d].T, data[t], dx.T)
            g[2 + d] += dq @ before.T
            g[4 + d] += ds.sum(axis=1, keepdims=True)
            back = dh * z + net.states[d].T @ dq
    return loss / total, g


def train(texts: list[bytes], langs: list[str], *, rounds: int = 240, batch: int = 96, steps: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on random windows of ``steps`` bytes, languages drawn evenly."""
    known = sorted(set(langs))
    net, rng = _start(known, seed), np.random.default_rng(seed)
    by = [[t for t, x in zip(texts, langs, strict=True) if x == k] for k in known]
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    mapped, counted = byte_map(), counted_bytes()
    for k in range(1, rounds + 1):
        target = rng.integers(len(known), size=batch)
        data = np.zeros((steps, batch), dtype=np.uint8)
        for lane, c in enumerate(target):
            text = by[c][rng.integers(len(by[c]))]
            at = int(rng.integers(max(1, len(text) - steps + 1)))
            piece = np.frombuffer(text[at : at + steps], dtype=np.uint8)
            data[: len(piece), lane] = piece
        _, g = _gradients(net, mapped[data], target, counted[data])
        for w, m, v, x in zip(weights, first, second, g, strict=True):
            np.clip(x, -1, 1, out=x)
            m += 0.1 * (x - m)
            v += 0.01 * (x * x - v)
            w -= rate * (1 - 0.9 * k / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return net


class Labeller:
    """Inference over lanes: weights are scaled so that a gate needs one tanh, and every array is reused."""

    def __init__(self, net: Network):
        h, half = HIDDEN, np.ones((3 * HIDDEN, 1), dtype=np.float32)
        half[: 2 * h] = 0.5
        self.net = net
        self.inputs = [np.ascontiguousarray(w * half) for w in net.inputs]
        self.states = [np.ascontiguousarray(w * 0.5) for w in net.states]
        self.biases = [b * 0.5 for b in net.biases]

    def positions(self, data: np.ndarray) -> np.ndarray:
        """(C, T, N) label probabilities of every position; ``data`` is (T, N) mapped bytes."""
        steps, lanes = data.shape
        h2 = 2 * HIDDEN
        out = np.empty((len(self.net.langs), steps, lanes), dtype=np.float32)
        logits = np.empty((len(self.net.langs), lanes), dtype=np.float32)
        x, q = (np.empty((3 * HIDDEN, lanes), dtype=np.float32) for _ in range(2))
        for d in (0, 1):
            h = np.zeros((HIDDEN, lanes), dtype=np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(self.inputs[d], data[t], axis=1, out=x, mode="clip")
                np.matmul(self.states[d], h, out=q)
                gates, n, s = x[:h2], x[h2:], q[h2:]
                gates += q[:h2]
                np.tanh(gates, out=gates)
                gates += 1  # twice the gate
                s += self.biases[d]
                s *= gates[HIDDEN:]
                n += s
                np.tanh(n, out=n)
                h -= n
                z = gates[:HIDDEN]
                z *= 0.5
                h *= z
                h += n
                np.matmul(self.net.labels[d], h, out=logits)
                if d == 0:
                    out[:, t] = logits
                else:
                    out[:, t] += logits
        out += self.net.label_bias[:, :, None]
        np.exp(out, out=out)
        out /= out.sum(axis=0)
        return out

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(documents, C): probabilities pooled over the counted positions; zeros where none counts."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        segments = -(-sizes // STEPS)
        starts = np.concatenate(([0], np.cumsum(segments)))
        room = segments * STEPS + 2 * WARM  # zeros stand around a text
        begins = np.concatenate(([0], np.cumsum(room)[:-1])) if len(texts) else sizes
        flat = np.zeros(int(room.sum()), dtype=np.uint8)
        for at, t in zip(begins + WARM, texts, strict=True):
            flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        heads = np.repeat(begins - starts[:-1] * STEPS, segments) + np.arange(starts[-1]) * STEPS
        pooled = np.zeros((len(heads), len(self.net.langs) + 1))
        mapped, counted, steps = byte_map(), counted_bytes(), np.arange(STEPS + 2 * WARM)[:, None]
        for at in range(0, len(heads), LANES):
            data = flat[heads[at : at + LANES] + steps]
            mask = counted[data[WARM:-WARM]]
            p = self.positions(mapped[data])[:, WARM:-WARM]
            pooled[at : at + LANES, :-1] = np.einsum("ctn,tn->nc", p, mask)
            pooled[at : at + LANES, -1] = mask.sum(axis=0)
        sums = np.zeros((len(texts), pooled.shape[1]))
        full = segments > 0
        if full.any():
            sums[full] = np.add.reduceat(pooled, starts[:-1][full], axis=0)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_lang: int, windows: int, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[bytes], list[str]]:
    """Windows of at most ``per_lang`` learnable documents of each language, chosen by a hash of id and text; repeated rows count once."""
    draw = F.xxhash64(F.col(key), F.col(text), F.lit("langid"))
    known = docs.where(~held_out(key)).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.col(text).alias("t"), draw.alias("u"))
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.approx_count_distinct("u", 0.02).alias("n")).collect()}  # as many rows as languages
    if not counts:
        return [], []
    share = F.pmod("u", F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(1.5 * per_lang / max(n, 1)))]), F.col("l"))
    part = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.substring("t", F.floor(k * F.greatest(F.length("t") - WINDOW, F.lit(0)) / max(windows - 1, 1)).cast("int") + 1, F.lit(WINDOW)))
    rows = known.where(share < rate).select("l", "u", F.array_distinct(part).alias("w")).dropDuplicates(["l", "u"]).collect()
    texts, langs = [], []
    for k in sorted(counts):
        mine = sorted((r.u, r.w) for r in rows if r.l == k)[:per_lang]
        found = [w.encode() for _, ws in mine for w in ws if w]
        texts += found
        langs += [k] * len(found)
    return texts, langs


def identify(docs: DataFrame, *, per_lang: int = 400, windows: int = 8, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned.  A null id is not held out;
    repeated rows are labelled alike; an empty table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    texts, langs = sample(docs, per_lang, windows, key=key, text=text, lang=lang)
    net = train(texts, langs) if texts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net) if net else None
        for batch in batches:
            for part in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
                bodies = [x.as_py() or "" for x in part.column(2)]
                lettered = [bool(net) and any(map(str.isalpha, b)) for b in bodies]
                best, score = ["und"] * len(bodies), [0.0] * len(bodies)
                if any(lettered):
                    p = labeller.documents([b.encode() for b in bodies])
                    top = p.argmax(axis=1)
                    best = [net.langs[k] if ok else "und" for k, ok in zip(top, lettered, strict=True)]
                    score = [float(min(1.0, row[k])) if ok else 0.0 for row, k, ok in zip(p, top, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
