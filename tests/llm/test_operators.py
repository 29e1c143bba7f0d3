"""Each operator against brute force, and on awkward rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import decontam, kneser_ney, langid, media, packing, pii, queries, sharding, simhash, suffix_index, url_filter
from framelake.session import settle, staged

from .edge import LONG, ROWS, documents, nothing

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- 1: near-duplicates ----------------------------------------------------------------------------------------------


def slow_fingerprint(text, k):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abAB é\t\n\x0b ") for _ in range(rng.randrange(60)))
        assert simhash.fingerprint(text) == slow_fingerprint(text, 4)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def groups_by_force(fps, radius=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize(("blocks", "crowd"), [(3, 64), (3, 2), (1, 64), (2, 4)])
def test_links_find_every_component(spark, blocks, crowd):
    rng, fps = random.Random(blocks), set()
    for _ in range(12):
        base = rng.getrandbits(64) - (1 << 63)
        fps.add(base)
        for _ in range(rng.randrange(14)):
            x = base
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= simhash._signed(1 << b)
            fps.add(x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.v: r.root for r in simhash.components(simhash.links(df, blocks=blocks, crowd=crowd)).collect()}
    assert {f: got.get(f, f) for f in fps} == groups_by_force(fps)


def test_links_broadcast_no_more_than_their_bound(spark, monkeypatch):
    rng, sent, broadcast = random.Random(12), [], simhash.F.broadcast
    fps = {x ^ simhash._signed(1 << rng.randrange(64)) for x in (rng.getrandbits(64) - (1 << 63) for _ in range(40)) for _ in range(5)}
    monkeypatch.setattr(simhash, "LINK_ROWS", 30)
    monkeypatch.setattr(simhash.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    got = {r.v: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    assert all(n <= 30 for n in sent)
    assert {f: got.get(f, f) for f in fps} == groups_by_force(fps)


def test_links_of_a_crowd_broadcast_no_ball(spark):
    rng = random.Random(13)
    base = rng.getrandbits(64) - (1 << 63)
    fps = {base ^ simhash._signed(1 << a ^ 1 << b) for a, b in (rng.sample(range(64), 2) for _ in range(100))} | {rng.getrandbits(64) - (1 << 63) for _ in range(40)}
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd=8)
    rows = found.collect()
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()  # the plan as it ran
    got = {r.v: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert {f: got.get(f, f) for f in fps} == groups_by_force(fps)


def test_near_duplicates_of_awkward_rows(spark):
    out = simhash.near_duplicates(documents(spark)).collect()
    assert len(out) == len(ROWS)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    assert by[(2, f"{slow_fingerprint(ROWS[1][1], 4):016x}")] == 1
    assert by[(5, "0" * 16)] == by[(4, "0" * 16)] == by[(None, "0" * 16)] == 3
    assert by[(7, f"{slow_fingerprint(LONG, 4):016x}")] == 6
    assert simhash.near_duplicates(nothing(spark)).collect() == []


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect())
    assert ids == [(False, k) for k in (1, 3, 6, 8, 9, 10, 11)] + [(True, 0)]
    assert simhash.drop_near_duplicates(nothing(spark)).count() == 0


def similar_texts(rng, lengths, words=5):
    """Pairs of texts with random words changed whose shingles have a Jaccard similarity of 0.8 to 0.9."""
    rows = []
    for length in lengths:
        while True:
            first = [f"w{rng.randrange(100_000)}" for _ in range(length)]
            second = list(first)
            for k in rng.sample(range(length), max(1, length // 50 + rng.randrange(2))):
                second[k] = f"x{rng.randrange(100_000)}"
            x, y = ({tuple(t[i : i + words]) for i in range(len(t) - words + 1)} for t in (first, second))
            if 0.8 <= len(x & y) / len(x | y) < 0.9:
                rows += [" ".join(first), " ".join(second)]
                break
    return rows


def test_similar_short_texts_are_one_group(spark):
    rng = random.Random(4)
    rows = similar_texts(rng, [length for length in (60, 80, 100, 150, 200) for _ in range(40)])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(range(0, len(rows), 2))


def test_sampled_counts_of_shingles_change_no_result(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    pairs = []
    for sets, seen in ((20_000, 5), (20_000, 1), (40, 1), (0, 1)):
        monkeypatch.setattr(simhash, "SAMPLE_SETS", sets)
        monkeypatch.setattr(simhash, "LEAST_SEEN", seen)
        marked = staged(simhash._sketched(docs, 5, 0.8, "doc_id", "text"), "test-marked")
        found = simhash.similar_pairs(marked, docs, words=5, similarity=0.8, crowd=10_000, key="doc_id", text="text")
        pairs.append({(r.a, r.b) for r in found.collect()})
    assert pairs[0] and all(p == pairs[0] for p in pairs)


def test_parities_differ_at_most_as_the_sets(spark):
    rng = np.random.default_rng(11)
    rows, true = [], []
    for n in (1, 2, 30, 32, 33, 60, 63, 64, 65, 100, 128, 129, 500, 4000):
        for share in (0.0, 0.05, 0.2, 0.5):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            more = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
            y = np.unique(np.concatenate([x[: max(1, n - int(n * share / 2))], more]))
            rows.append((len(rows), simhash.parity(x).tolist(), simhash.parity(y).tolist()))
            true.append(len(np.setxor1d(x, y)))
    asked = spark.createDataFrame(rows, "k int, x array<long>, y array<long>").selectExpr("k", f"{simhash._differing('x', 'y')} AS d", f"{simhash._differing('y', 'x')} AS e")
    found = {r.k: (r.d, r.e) for r in asked.collect()}
    assert all(found[k][0] == found[k][1] <= d and (d - found[k][0]) % 2 == 0 for k, d in enumerate(true))
    assert any(found[k][0] > 0.9 * d > 100 for k, d in enumerate(true))


def test_similar_texts_in_a_crowd_are_one_group(spark):
    # every text joins two passages that many others hold; the words that meet there differ, so only common shingles are shared
    rows = []
    for i in range(4):
        for j in range(4):
            head, tail = [f"a{i}w{k}" for k in range(29)], [f"b{j}w{k}" for k in range(30)]
            rows += [" ".join([*head, f"x{i}{j}", *tail]), " ".join([*head, f"y{i}{j}", *tail])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[a] if r == root[b] else r for r in root]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, crowd=4).collect()}
    assert len(set(root)) == 16
    assert kept == {min(k for k, r in enumerate(root) if r == x) for x in set(root)}


# --- 2: languages ----------------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    net = langid._start(["a", "b", "c"], 1)
    for w in net.weights():
        w.setflags(write=True)
    data, target, weight = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((6, 4), dtype=np.float32)
    _, g = langid._gradients(net, data, target, weight)
    for w, d in zip(net.weights(), g, strict=True):
        k = int(np.abs(d).argmax())
        old = w.flat[k]
        w.flat[k] = old + 1e-2
        up = langid._gradients(net, data, target, weight)[0]
        w.flat[k] = old - 1e-2
        down = langid._gradients(net, data, target, weight)[0]
        w.flat[k] = old
        assert (up - down) / 2e-2 == pytest.approx(float(d.flat[k]), rel=0.05, abs=1e-4)


def test_fast_inference_equals_the_training_pass():
    net = langid._start(["a", "b"], 2)
    data = np.random.default_rng(0).integers(0, 256, (20, 5)).astype(np.uint8)
    outs = [{s[0]: s[6] for s in langid._run(net, d, data)} for d in (0, 1)]
    p = langid.Labeller(net).positions(data)
    for t in range(20):
        logits = net.labels[0] @ outs[0][t] + net.labels[1] @ outs[1][t] + net.label_bias
        e = np.exp(logits)
        assert np.allclose(p[:, t], e / e.sum(axis=0), atol=1e-4)


def test_languages_of_awkward_rows(spark):
    out = langid.identify(documents(spark)).collect()
    assert len(out) == len(ROWS)
    assert {r.lang_pred for r in out if r.doc_id in (3, 4, 5, 9)} == {"und"}
    assert all(not r.held_out for r in out if r.doc_id is None)
    assert langid.identify(nothing(spark)).count() == 0


def test_languages_of_null_ids_and_repeated_rows(spark):
    """Rows that share an id, or are all alike, are learned from; signs that are no letters make no language."""
    rows = [(None, f"the cat {k} sat on the mat", "en") for k in range(40)] + [(7, "der Hund lag auf dem Boden", "de")] * 900 + [(7, "½ ² ③", "de"), (None, "½", None)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=20).collect()
    assert all((r.lang_pred == "und") == (r.score == 0) for r in out)
    assert Counter(r.lang_pred == "und" for r in out) == {False: 940, True: 2}


def test_training_windows_cover_whole_texts(spark):
    text = "".join(chr(97 + k % 26) for k in range(6000))
    one, two = [k for k in range(20) if zlib.crc32(str(k).encode()) % 3 != 1][:2]
    texts, _ = langid.sample(spark.createDataFrame([(one, text, "en"), (two, "short", "en")], "doc_id long, text string, lang string"), 10, 8)
    assert sorted(map(len, texts)) == [5] + [langid.WINDOW] * 8
    assert texts[0] == text[: langid.WINDOW].encode() or texts[1] == text[: langid.WINDOW].encode()
    assert text[-langid.WINDOW :].encode() in texts


def test_pooled_documents_by_force():
    """Every byte is labelled by a network that ran over it and its surroundings; the labels of letter bytes are averaged."""
    net = langid._start(["a", "b", "c"], 4)
    texts = [b"", b"x", "Zwölf Boxkämpfer jagen Viktor quer ".encode() * 20, b"1 2 3", b"abc " * 31 + b"tail"]
    got = langid.Labeller(net).documents(texts)
    for text, row in zip(texts, got, strict=True):
        total, n = np.zeros(3), 0
        for at in range(0, len(text), langid.STEPS):
            padded = bytes(langid.WARM) + text + bytes(2 * langid.STEPS)
            data = np.frombuffer(padded[at : at + langid.STEPS + 2 * langid.WARM], dtype=np.uint8)[:, None]
            outs = [{s[0]: s[6] for s in langid._run(net, d, langid.byte_map()[data])} for d in (0, 1)]
            for t in range(langid.WARM, langid.WARM + langid.STEPS):
                if langid.counted_bytes()[data[t, 0]]:
                    e = np.exp(net.labels[0] @ outs[0][t] + net.labels[1] @ outs[1][t] + net.label_bias)
                    total, n = total + (e / e.sum())[:, 0], n + 1
        assert np.allclose(row, total / max(n, 1), atol=1e-4)


# --- 3: repeats ------------------------------------------------------------------------------------------------------


def repeats_by_force(texts, need):
    seen = Counter(t[i : i + need] for t in texts for i in range(len(t) - need + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - need + 1):
            if seen[t[i : i + need]] > 1:
                gone[i : i + need] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((gone & ~np.roll(gone, 1)).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [5000, 2])
def test_repeats(spark, crowd):
    rng = random.Random(5)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    base, shared = [word(rng.randrange(700)) for _ in range(20)], [word(rng.randrange(60, 380)) for _ in range(4)]
    texts = list(base)
    for _ in range(30):
        x, k = rng.choice(base), rng.random()
        texts.append(x if k < 0.2 else x[: len(x) // 2] + rng.choice(shared) + x[len(x) // 2 :] if k < 0.7 else word(40) + word(rng.randrange(1, 9)) * rng.randrange(1, 150) + word(20))
    texts += [b"a" * n for n in (199, 200, 201, 500)] + [b"", "é".encode() * 300]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    out = suffix_index.remove_repeats(df, crowd=crowd).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == repeats_by_force(texts, 200)


def test_matching_statistics():
    rng = random.Random(9)
    for _ in range(60):
        pieces = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 5))]
        got, starts = suffix_index.matching_statistics(pieces)
        for a, p in enumerate(pieces):
            for i in range(len(p)):
                best = 0
                for b, q in enumerate(pieces):
                    for j in range(len(q)):
                        n = 0
                        while (a, i) != (b, j) and i + n < len(p) and j + n < len(q) and p[i + n] == q[j + n]:
                            n += 1
                        best = max(best, n)
                assert got[starts[a] + i] == best


def test_repeats_of_awkward_rows(spark):
    out = suffix_index.remove_repeats(documents(spark)).collect()
    want = repeats_by_force([(r[1] or "").encode() for r in ROWS if r[0] not in (6, 7)], 200)
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out if r.doc_id not in (6, 7)) == Counter(want)
    assert {(r.n_removed, r.n_spans) for r in out if r.doc_id in (6, 7)} == {(len(LONG), 1)}
    assert suffix_index.remove_repeats(nothing(spark)).count() == 0


# --- 4: shards -------------------------------------------------------------------------------------------------------


def shards_hold(rows, shards, most):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total = sum(r.size for r in rows)
    sums = [sum(r.size for r in by[s]) for s in range(shards)]
    assert all(abs(s - total / shards) <= most for s in sums)


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    rows = sharding.shard_by_bytes(docs).collect()
    assert len(rows) == 1000
    shards_hold(rows, 40, max(r.size for r in rows))
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_by_bytes(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_shards_cut_a_hot_text(spark):
    df = spark.createDataFrame([(k, "hot text" if k < 600 else f"text {k} " * (k % 9)) for k in range(1000)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(df, shards=10).collect()
    shards_hold(rows, 10, max(r.size for r in rows))


def test_shards_cut_repeated_rows(spark):
    df = spark.createDataFrame([(7, "the same row")] * 3000 + [(k, f"text {k}") for k in range(1000)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(df, shards=10).collect()
    shards_hold(rows, 10, max(r.size for r in rows))
    keyed = df.selectExpr("xxhash64(text) AS h", "doc_id AS i", "monotonically_increasing_id() AS u", "28L AS size")
    assert 20 < len(set(sharding._sample(keyed, 50 / (4000 * 28)))) < 100


def test_shards_of_awkward_rows(spark):
    rows = sharding.shard_by_bytes(documents(spark), shards=3).collect()
    assert len(rows) == len(ROWS)
    assert {r.size for r in rows if r.doc_id == 3} == {16}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_bytes(nothing(spark)).count() == 0


# --- 5: quality ------------------------------------------------------------------------------------------------------


def kneser_ney_by_force(texts, order=kneser_ney.ORDER):
    """Probabilities of all n-grams of bytes from the definition."""
    pad = bytes([10]) * (order - 1)
    counts = Counter()
    for t in texts:
        counts.update((pad + t)[i : i + order] for i in range(len(t)))
    orders = {order: counts}
    for n in range(order - 1, 0, -1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    often = {n: Counter(orders[n].values()) for n in orders}
    after = {}
    for n in orders:
        for g, c in orders[n].items():
            after.setdefault((n, g[:-1]), []).append(c)

    def cut(c, n):
        k = often[n]
        if not all(k[i] for i in (1, 2, 3, 4)):
            return (0.5, 1.0, 1.5)[min(c, 3) - 1]
        y, i = k[1] / (k[1] + 2 * k[2]), min(c, 3)
        return min(max(i - (i + 1) * y * k[i + 1] / k[i], kneser_ney.LEAST_DISCOUNT), i)

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        same = after.get((n, g[:-1]))
        if not same:
            return p(g[1:])
        total = sum(same)
        held = sum(cut(c, n) for c in same)
        c = orders[n].get(g, 0)
        return (c - cut(c, n) if c else 0) / total + held / total * p(g[1:])

    return p


def test_kneser_ney_from_the_definition(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the ", "cat ", "sat. ", "on ", "Ähm, "]) for _ in range(30)) for _ in range(6)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = kneser_ney_by_force([t.encode() for t in texts])
    asked = {bytes(rng.choice(b"the catson.") for _ in range(kneser_ney.ORDER)) for _ in range(120)}
    asked |= {b"the " + bytes([k]) for k in range(256)} | {b"zzzz" + bytes([k]) for k in range(256)}
    code = lambda g: int.from_bytes(g, "big")
    codes = np.array(sorted(map(code, asked)))
    pieces = [(block, shard, kneser_ney.pressed(codes[at])) for block in (1, 2) for shard, at in kneser_ney.by_shard(codes, model.shards)]
    got = {1: {}, 2: {}}
    for r in kneser_ney.costs(spark.createDataFrame(pieces, "block long, shard int, codes binary"), model, copies=2).collect():
        got[r.block].update(zip(kneser_ney.unpressed(r.codes).tolist(), (2.0 ** -np.frombuffer(r.costs, "<f4").astype(float)).tolist(), strict=True))
    assert got[1] == got[2] and len(got[1]) == len(asked)
    got = got[1]
    for g in asked:
        assert got[code(g)] == pytest.approx(p(g), rel=1e-5)
    for context in (b"the ", b"zzzz"):
        assert sum(got[code(context + bytes([k]))] for k in range(256)) == pytest.approx(1, rel=1e-5)


def test_no_discount_is_zero(spark):
    """Many n-grams seen four times and few seen three times would make the formula's D3 negative."""
    counts = [1] * 10 + [2] * 10 + [3] * 2 + [4] * 90
    d = kneser_ney.discounts(spark.createDataFrame(list(enumerate(counts)), "g long, c long"))
    assert min(d) == kneser_ney.LEAST_DISCOUNT
    rows = [(k, "".join(chr(97 + (k + j) % 5) for j in range(60)), "en") for k in range(40)] + [(100, "z\x00ÿ" * 40, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 40").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert all(r.bits is not None and r.bits < 100 for r in kneser_ney.classify(docs, labels).collect())


def test_quality_by_force(spark, sf_dir):
    docs, labels = spark.read.parquet(sf_dir + "/documents.parquet").where("doc_id < 70"), spark.read.parquet(sf_dir + "/labels.parquet")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    rows = docs.select("doc_id", "lang", "text", kneser_ney._judged_apart("text").alias("apart")).collect()
    trusted = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    p = kneser_ney_by_force([(r.text or "").encode() for r in rows if r.doc_id in trusted and not r.apart])
    seen, pad = {}, bytes([10]) * (kneser_ney.ORDER - 1)
    judged = {}
    for r in rows:
        data = (r.text or "").encode()
        grams = [(pad + data)[i : i + kneser_ney.ORDER] for i in range(len(data))]
        for g in set(grams) - seen.keys():
            seen[g] = -math.log2(p(g))
        if data:
            judged[r.doc_id] = (r.lang, min(max((len(data).bit_length() - 1) // 2, 2), 6), sum(seen[g] for g in grams) / len(data), len(set(grams)) / len(data))
    held = [judged[r.doc_id] for r in rows if r.apart and r.doc_id in trusted and r.doc_id in judged]
    at = lambda values, q: sorted(values)[max(math.ceil(q * len(values)), 1) - 1]
    for r in rows:
        if r.doc_id not in judged:
            assert got[r.doc_id].bits is None and not got[r.doc_id].kept
            continue
        lang, grade, bits, variety = judged[r.doc_id]
        assert got[r.doc_id].bits == pytest.approx(bits, rel=1e-5)
        groups = [[h for h in held if h[:2] == (lang, grade)], [h for h in held if h[0] == lang], held]
        wide = []
        for group in groups:
            wide.append(group)
            if len(group) >= kneser_ney.LEAST_CLASS:
                break
        high = max(at([h[2] for h in g], 0.995) for g in wide if g)
        low = min(at([h[3] for h in g], 0.005) for g in wide if g) / 2
        assert got[r.doc_id].threshold == pytest.approx(high, rel=1e-5)
        if abs(bits - high) > 1e-4:
            assert got[r.doc_id].kept == (bits <= high and variety >= low)


def test_bits_look_up_each_ngram_once_and_alike_in_any_place(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice((0, 1, 4, 300)))) for _ in range(400)] + [None]
    data = [(t or "").encode() for t in texts * 2]
    codes = kneser_ney.grams(data)[0]
    known = np.unique(codes)
    price = np.random.default_rng(4).random(len(known), dtype=np.float32) * 9
    paid, asked, search = dict(zip(known.tolist(), price.tolist(), strict=True)), [], np.searchsorted

    def counted(a, v, *rest):
        asked.append(np.asarray(v))
        return search(a, v, *rest)

    monkeypatch.setattr(np, "searchsorted", counted)
    sizes, bits, variety = kneser_ney._bits(pa.array(texts * 2), known, price)
    assert sum(len(v) for v in asked) == len(known)
    assert sizes.tolist() == [len(t) for t in data]
    half = len(texts)
    assert np.array_equal(bits[:half], bits[half:], equal_nan=True) and np.array_equal(variety[:half], variety[half:], equal_nan=True)
    for k in range(half):
        mine = kneser_ney.grams([data[k]])[0].tolist()
        if not mine:
            assert np.isnan(bits[k]) and np.isnan(variety[k])
            continue
        assert bits[k] == pytest.approx(sum(paid[g] for g in mine) / len(mine), rel=1e-9)
        assert variety[k] == len(set(mine)) / len(mine)


def test_quality_rejects_junk_and_keeps_clean_text(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/labels.parquet")
    out = kneser_ney.classify(docs, labels).join(labels, "doc_id").collect()
    clean, junk = [r.kept for r in out if r.quality == 1 and not r.toxic], [r.kept for r in out if r.quality == 0]
    toxic = [r.kept for r in out if r.quality == 1 and r.toxic]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.05 and np.mean(toxic) < np.mean(clean)
    kept = {r.doc_id for r in kneser_ney.classify(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in kneser_ney.keep_good(docs, labels).collect()} == kept


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0), (6, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    out = kneser_ney.classify(documents(spark), labels).collect()
    assert len(out) == len(ROWS)
    assert all(not r.kept and r.bits is None for r in out if r.n_bytes == 0)
    kept = kneser_ney.keep_good(documents(spark), labels)
    assert kept.columns == documents(spark).columns
    assert kept.count() == sum(r.kept for r in out)
    assert kneser_ney.classify(nothing(spark), labels.limit(0)).count() == 0
    assert all(r.kept == (r.n_bytes > 0) for r in kneser_ney.classify(documents(spark), labels.limit(0)).collect())


# --- 6: decontamination ------------------------------------------------------------------------------------------------


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(1, 20))] for _ in range(2))
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
            best = row
        assert decontam.common_words(a, b) == best[-1]


def test_recall_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, bench = spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/benchmark.parquet")
    plain = lambda t: " " + " ".join(decontam.words_of(t)) + " "
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    truth = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in plain(r.text)}
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert truth and len(truth & found) >= 0.9 * len(truth)
    assert len(found - truth) <= 0.02 * len(truth)
    clean = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_paraphrase_is_found_and_common_words_are_not(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    item = [rng.choice(words) for _ in range(40)]
    changed = [w if k % 9 else "other" for k, w in enumerate(item)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(200))) for k in range(60)]
    rows.append((100, " ".join(rng.choice(words) for _ in range(90)) + " " + " ".join(changed) + " " + " ".join(rng.choice(words) for _ in range(50))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()] == [(100, 1)]


@pytest.fixture(scope="module")
def planted(spark):
    """Items of five lengths, each copied into one document and paraphrased in 15 % of its words into another."""
    rng = random.Random(15)
    words = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(6000)]
    often = words[:60]
    prose = lambda n: [rng.choice(often) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items, rows = [], [(k, " ".join(prose(rng.randint(30, 300)))) for k in range(300)]
    for length, many in ((1, 20), (20, 60), (40, 60), (120, 40), (300, 20)):
        for _ in range(many):
            i = len(items)
            # a single word is its own answer; it must not be one of the prose's
            item = [f"answer{i}"] if length == 1 else prose(length)
            items.append((i, length, " ".join(item)))
            changed = item if length == 1 else [w if rng.random() > 0.15 else rng.choice(words) for w in item]
            rows += [(at + i, " ".join([*prose(40), *said, *prose(60)])) for at, said in ((1000, item), (2000, changed))]
    return spark.createDataFrame(rows, "doc_id long, text string"), items


def test_copies_and_paraphrases_of_all_lengths(spark, planted):
    docs, items = planted
    bench = spark.createDataFrame([(i, t) for i, _, t in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    for length in (1, 20, 40, 120, 300):
        for at in (1000, 2000):
            mine = [(at + i, i) for i, n, _ in items if n == length]
            assert len(found.intersection(mine)) >= (1.0 if at == 1000 else 0.9) * len(mine), (length, at)
    assert all(d % 1000 == i and d >= 1000 for d, i in found)
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_blocks_change_no_result(spark, planted, monkeypatch):
    docs, items = planted
    bench = spark.createDataFrame([(i, t) for i, _, t in items], "item_id long, text string")
    whole = sorted((r.doc_id, r.item_id, r.cosine, r.coverage, r.word_at) for r in decontam.leaks(docs, bench).collect())
    monkeypatch.setattr(decontam, "ITEMS", 70)
    split = sorted((r.doc_id, r.item_id, r.cosine, r.coverage, r.word_at) for r in decontam.leaks(docs, bench).collect())
    assert [(x[:2], *x[3:]) for x in split] == [(x[:2], *x[3:]) for x in whole]
    assert np.allclose([x[2] for x in split], [x[2] for x in whole], atol=1e-4)
    kept = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {x[0] for x in split}


def test_more_words_than_columns_leave_nothing_out(spark, planted, monkeypatch):
    docs, items = planted
    bench = spark.createDataFrame([(i, t) for i, _, t in items], "item_id long, text string")
    monkeypatch.setattr(decontam, "VOCABULARY", 1000)
    assert len({w for _, _, t in items for w in t.split()}) > 4 * decontam.VOCABULARY
    latent = decontam.space(docs, bench)
    assert len(latent.vocabulary) > 3 * decontam.VOCABULARY and len(latent.vectors) == decontam.VOCABULARY
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    for length in (1, 20, 40, 120, 300):
        for at in (1000, 2000):
            mine = [(at + i, i) for i, n, _ in items if n == length]
            assert len(found.intersection(mine)) >= (1.0 if at == 1000 else 0.9) * len(mine), (length, at)
    assert all(d % 1000 == i and d >= 1000 for d, i in found)


def test_long_items_are_found(spark):
    rng = random.Random(6)
    other = lambda n: [f"o{rng.randrange(3000)}" for _ in range(n)]
    rows = [(k, " ".join(other(100))) for k in range(250)]
    items = [(i, [f"i{i}w{k}" for k in range(length)]) for i, length in enumerate((300, 1000))]
    for i, words in items:
        rows.append((1000 + i, " ".join([*other(50), *words, *other(50)])))
        rows.append((2000 + i, " ".join([*other(50), *(w if rng.random() > 0.05 else f"{w} inserted" for w in words), *other(50)])))
        rows.append((3000 + i, " ".join([*other(50), *words[: len(words) // 2], *other(50)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(words)) for i, words in items], "item_id long, text string")
    # with all directions kept, a passage of 32 words has a cosine under 0.4 with items of 300 and 1,000
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark, rank=2000).collect()}
    assert found == {(1000, 0), (2000, 0), (1001, 1), (2001, 1)}
    assert {r.doc_id for r in decontam.clean(docs, benchmark, rank=2000).collect()} == {*range(250), 3000, 3001}


def test_leaks_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "x"), (2, None)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontam.leaks(documents(spark), bench).collect())
    assert found == [(1, 1), (2, 1), (2, 1)]
    assert decontam.clean(documents(spark), bench).count() == len(ROWS) - 3
    assert decontam.leaks(nothing(spark), bench).count() == decontam.leaks(documents(spark), bench.limit(0)).count() == 0


# --- 7: personal data --------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_by_force(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(6)
    for alphabet in ("a@b.1-2+ ()3é_%\n", "1234567890 -.+", "0.1.2.3.255.256 "):
        for _ in range(6000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
            assert pii.base_spans(t) == spans_by_force(t), t
    t = "card 4111 1111 1111 1111, call +1 (555) 010-9999, x@y.example or 10.0.0.255"
    assert [k for k, _, _ in pii.base_spans(t)] == ["email", "ip", "card", "phone"]
    pii.base_spans("a." * 60_000), pii.base_spans("1" * 100_000), pii.base_spans("1." * 50_000)


def test_disclosing_terms(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))) for k in range(200)]
    rows += [(1000 + k, f"{rng.choice(['alpha', 'beta'])} the zanzibar office of boss@corp.example replied {k} times today") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.detect(docs).collect()}
    words = {rows[-1][1][int(s.split(":")[1]) : int(s.split(":")[2])] for s in out[1004].spans.split(",") if s.startswith("term")}
    assert "zanzibar" in words and "alpha" not in words and "beta" not in words
    assert all(out[k].n_term == 0 and out[k].spans == "" for k in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "boss@" not in clean[1000] and "zanzibar" not in clean[1000] and clean[0] == rows[0][1]


def terms_by_force(rows, alpha=0.8, support=3):
    """Disclosing terms from the definition: counts over whole texts, rows with multiplicity."""
    df_e, df_t, df_et, texts_e, texts_et = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for _, text in rows:
        spans = pii.base_spans(text)
        entities = {f"{k}:{text[a:b].lower()}" for k, a, b in spans}
        near = {w.lower() for m in pii.WORD.finditer(text) for w in [m.group()] if not any(m.start() < b and m.end() > a for _, a, b in spans)}
        df_t.update({w.lower() for w in re.findall(r"[^\W\d_]+", text)})
        df_e.update(entities)
        for e in entities:
            texts_e[e].add(text)
            for t in near:
                df_et[e, t] += 1
                texts_et[e, t].add(text)
    out = set()
    for (e, t), n in df_et.items():
        ic, pmi = math.log2(len(rows) / df_e[e]), math.log2(len(rows) * n / (df_e[e] * max(df_t[t], n)))
        if len(texts_e[e]) >= support:
            ok = len(texts_et[e, t]) >= support and pmi >= alpha * ic
        else:
            ok = texts_et[e, t] == texts_e[e] and df_t[t] <= n
        if ok and df_e[e] < len(rows):
            out.add(t)
    return out


def test_terms_by_force(spark):
    rng = random.Random(2)
    names = ["boss@corp.example", "10.0.0.1", "+49 30 1234567", "ann@corp.example", "bob@corp.example"]
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(150)]
    rows = []
    for k in range(400):
        said = [rng.choice(words[:40]) for _ in range(12)] + [rng.choice(words) for _ in range(2)]
        if k % 9 == 0:
            who = rng.choice([0, 0, 0, 1, 1, 2]) if k < 300 else 3 + (k > 390)
            said += [names[who], f"only{'abcde'[who]}"] + ["shared"] * (who == 0)
        rng.shuffle(said)
        rows.append((k, " ".join(said)))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, "the word shared with nobody named, and onlya too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = terms_by_force(rows)
    got = {r.term for r in pii.disclosing(pii.find_base(docs), docs).collect()}
    assert got == want and {"shared", "onlya", "onlyd"} <= want
    out = {r.doc_id: r for r in pii.detect(docs).collect()}
    for k, text in rows:
        marked = {text[int(a) : int(b)].lower() for a, b in re.findall(r"term:(\d+):(\d+)", out[k].spans)}
        assert marked == {w.lower() for w in re.findall(r"[^\W\d_]{3,}", text)} & want - {w for x in pii.base_spans(text) for w in re.findall(r"[^\W\d_]{3,}", text[x[1] : x[2]])}


def test_terms_of_a_rare_entity(spark):
    """A text that names an entity of its own loses the words found nowhere else; other texts that share its words stay."""
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(k, filler(30)) for k in range(300)]
    rows += [(1000, f"{filler(40)} boss@corp.example {filler(60)} zanzibar {filler(20)} pemba"), (1001, f"{filler(20)} Pemba {filler(20)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zanzibar" not in clean[1000] and "pemba" in clean[1000]
    assert all(clean[k] == text for k, text in rows if k != 1000)


def test_personal_data_of_awkward_rows(spark):
    out = pii.detect(documents(spark)).collect()
    assert len(out) == len(ROWS)
    assert {r.base_sha256 for r in out} == {hashlib.sha256(b"").hexdigest()}
    assert Counter(r.text for r in pii.sanitise(documents(spark)).collect()) == Counter(r[1] for r in ROWS)
    assert pii.detect(nothing(spark)).count() == pii.sanitise(nothing(spark)).count() == 0


# --- 8: media ------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    out = media.media_columns(documents(spark)).collect()
    assert len(out) == len(ROWS)
    want = Counter()
    for doc, text, *_ in ROWS:
        data = (text or "").encode()
        p = data + bytes(-len(data) % 64) or bytes(64)
        want[doc, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    by = defaultdict(set)
    for r in out:
        by[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by.values())
    assert media.media_columns(nothing(spark)).count() == 0


def test_images_of_any_colour_come_out_whole(spark):
    from tests.llm.test_webp import noise, write

    images = [noise(1, 6, 9, 40), noise(2, 4, 70)]
    stored = spark.createDataFrame([(7, b"".join(map(write, images))), (8, b"")], "doc_id long, media binary")
    out = media.decode_images(stored).orderBy("frame").collect()
    assert [(r.doc_id, r.frame, r.height, r.width) for r in out] == [(7, 0, 6, 9), (7, 1, 4, 70)]
    assert [bytes(r.pixels) for r in out] == [i.astype("<u4").tobytes() for i in images]


# --- 9: packing ------------------------------------------------------------------------------------------------------------


def pieces_hold(rows, texts, window):
    encode = packing.encoder(JSON, None)
    ids = {d: np.array([*encode(t or ""), 0], dtype="<u4") for d, t in texts.items()}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for d, part in by_doc.items():
        at = 0
        for r in sorted(part, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    for part in by_window.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(len(v) for v in ids.values()), len(by_window)


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    rows = packing.pack(docs, JSON, ranks=RANKS).collect()
    total, windows = pieces_hold(rows, {r.doc_id: r.text for r in docs.collect()}, 1024)
    assert windows <= total // 1024 + docs.rdd.getNumPartitions()


def test_packing_rule_minimises_the_sum_of_squares():
    rng = random.Random(3)
    p, levels = packing.Packer(32), Counter()
    for k in range(300):
        size = rng.randrange(1, 32)
        costs = {}
        for level in [0, *[h for h in levels if levels[h]]]:
            if level + size <= 32:
                after = levels.copy()
                if level:
                    after[level] -= 1
                if level + size < 32:
                    after[level + size] += 1
                costs[level] = sum(n * n for n in after.values())
        before = {h: len(p.open[h]) for h in range(1, 32)}
        p.add(k, np.zeros(size, dtype="<u4"))
        levels = Counter({h: len(p.open[h]) for h in range(1, 32)})
        assert sum(n * n for n in levels.values()) == min(costs.values()), before


def test_packing_of_awkward_rows(spark):
    rows = [(k, r[1]) for k, r in enumerate(ROWS)] + [(99, "before <|endoftext|> after")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces_hold(packing.pack(df, JSON, ranks=RANKS).collect(), dict(rows), 1024)
    assert {r.doc_id for r in packing.pack(documents(spark), JSON, ranks=RANKS).collect()} == {r[0] for r in ROWS}
    assert packing.pack(nothing(spark), JSON, ranks=RANKS).count() == 0


# --- 10: URLs -----------------------------------------------------------------------------------------------------------------


def test_url_filter_against_sql(spark, sf_dir):
    urls = [None, "", "no scheme", "http://", "http://COM/en/", "ftp://a.b.Example.com/en/7x?y", "http://example.net/de/81#z", "http://xexample.com/en/7", "http://de.org?/es/", "http://é.org/es/q://r", "a://b://c/en/", "http://com/en", "http://" + "x." * 3000 + "com/en/" + "y" * 9000]
    pages = spark.createDataFrame([(k, u, "<p>") for k, u in enumerate(urls + urls[4:6])], "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(con.execute(queries.ORACLES["op10_url_filters"].replace("SELECT page_id, host", "SELECT page_id, host", 1)).fetchall())
    got = sorted(tuple(r) for r in url_filter.filter_urls(pages, url_filter.rules_table(spark, queries.PAGE_RULES)).collect())
    assert got == want
    table = spark.read.parquet(sf_dir + "/pages.parquet")
    con.register("pages", table.toPandas())
    assert sorted(tuple(r) for r in queries.op10_url_filters(spark, sf_dir).collect()) == sorted(con.execute(queries.ORACLES["op10_url_filters"]).fetchall())
    rules = url_filter.rules_table(spark, queries.PAGE_RULES)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_filter_runs_no_python(spark, sf_dir):
    plan = queries.op10_url_filters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


# --- the pipeline ----------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        assert 0 < docs.count() <= left
        left = docs.count()
    assert not [r for r in docs.collect() if pii.base_spans(r.text)]
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()}
    assert got == {r.doc_id for r in docs.select("doc_id").collect()}


def test_each_stage_starts_on_collected_heaps(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(sf_dir + "/documents.parquet").limit(20).localCheckpoint()
    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collected = lambda: sum(b.getCollectionCount() for b in beans())
    for name, stage in corpus_pipeline.STAGES:
        seen = []
        held, corpus_pipeline.settle = corpus_pipeline.settle, lambda s, f=corpus_pipeline.settle: (seen.append(collected()), f(s), seen.append(collected()))
        try:
            stage(spark, docs, sf_dir)
        finally:
            corpus_pipeline.settle = held
        assert len(seen) == 2 and seen[1] > seen[0], name


def test_settling_frees_the_disk_of_ended_steps_only(spark):
    steps = [staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), f"test-{at}") for at in range(6)]
    folders = [Path(x.inputFiles()[0].removeprefix("file:")).parent for x in steps]
    derived = steps[4].join(steps[5].select("k", F.col("n").alias("m")), "k").where("k > 2").select("k", "m")
    del steps
    for _ in range(5):  # Python's release of a plan may reach the JVM after its collection
        settle(spark)
    assert [x.is_dir() for x in folders] == [False] * 4 + [True] * 2
    assert derived.count() == 4
