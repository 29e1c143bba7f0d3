"""Quality by the perplexity of an interpolated modified Kneser-Ney model trained on trusted text.

Texts are read as UTF-8 bytes, n-grams of up to ``ORDER`` bytes as exact codes, so the model and what scoring asks of it
grow with the text.  Nothing of it is collected or broadcast by the operator:

1. Counts, continuation counts and context totals of the trusted texts are aggregated by n-gram and kept as tables of
   discounted shares and back-off weights.  (Those of one and two bytes are bounded by the alphabet and go to all tasks.)
2. The documents are read in blocks of neighbouring rows.  Every block asks for each of its n-grams once.  Asked n-grams and
   model rows are sharded by the two bytes before the last, which all orders from three on share, and meet in a cogroup that
   gives each n-gram's cost in bits.  Asked n-grams of very many blocks are spread over copies of a shard.
3. The costs return to the blocks that asked, which meet their documents in a second cogroup, and every document adds up its
   own.  Documents travel compressed, n-grams as compressed differences.

A document is kept if its bits per byte are at most a quantile of trusted documents of its language and length class that
the model has not seen, and if the share of different n-grams among its own is at least half of what nearly all of them
have, which finds texts that repeat a few words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.session import release_memory, ship_package, tidy

from .common import staged

ORDER, SYMBOLS, BROADCAST_ROWS, BROADCAST_LIMITS = 5, 256, 5_000_000, 100_000
#: a block has at most so many rows, and of rows beyond ``LONG`` bytes at most as many as hold ``BLOCK_BYTES``
BLOCK_ROWS, LONG, BLOCK_BYTES = 8192, 1 << 14, 1 << 25
#: rows of the highest order and bytes of text to a shard and each of its copies
LEAST_SHARDS, SHARD_ROWS, COPY_BYTES = 24, 500_000, 1 << 25
LEAST_CLASS, LEAST_DISCOUNT = 100, 0.1
TEXT_BITS = 21  # of a text's number within a part, below the bits of an n-gram


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the ``order`` bytes that end at each byte of all texts, bytes of each text); a text starts as after a line's end."""
    pad = bytes([10]) * (order - 1)
    symbols = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = symbols[order - 1 :].astype(np.int64)
    for back in range(1, order):
        codes |= symbols[order - 1 - back : len(symbols) - back].astype(np.int64) << (8 * back)
    # positions that hold padding, between texts, are left out
    keep = np.ones(len(symbols), dtype=bool)
    starts = np.concatenate(([0], np.cumsum(sizes + order - 1)[:-1])) if len(texts) else np.empty(0, dtype=np.int64)
    for k in range(order - 1):
        keep[starts + k] = False
    return codes[keep[order - 1 :]], sizes


def _parts(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in runs of about ``most`` bytes."""
    at, held, size = 0, [], 0
    for k, x in enumerate(column):
        held.append((x.as_py() or "").encode())
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def count_grams(texts: DataFrame, text: str = "text") -> DataFrame:
    """(g, c): how often each n-gram of the highest order occurs."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _parts(batch.column(0)):
                g, c = np.unique(grams(part)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c.astype(np.int64))], ["g", "c"])

    return texts.select(text).mapInArrow(tidy(run), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of an order from its counts of counts; plain 0.5, 1, 1.5 where too few counts occur.

    None is under ``LEAST_DISCOUNT``: every context keeps something for what it has not seen, so no text is impossible.
    """
    n = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not all(n.get(k) for k in (1, 2, 3, 4)):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], LEAST_DISCOUNT), float(k)) for k in (1, 2, 3))


@dataclass
class Model:
    """Shares and back-off weights of orders from three on, sharded, and the probabilities of all pairs of bytes."""

    tables: DataFrame  # (shard, kind, key, value): kind 2k for shares of order k, 2k + 1 for weights of its contexts
    shards: int
    pairs: np.ndarray


def shard_of(pair: Column | np.ndarray, shards: int) -> Column | np.ndarray:
    """The shard of two bytes, alike for columns and arrays."""
    mixed = pair * 2654435761
    return F.pmod(F.shiftright(mixed, 16), F.lit(shards)) if isinstance(pair, Column) else (mixed >> 16) % shards


def train(trusted: DataFrame, text: str = "text") -> Model:
    counts = {ORDER: staged(count_grams(trusted, text), "kn-counts")}
    for order in range(ORDER - 1, 0, -1):  # how many symbols precede it
        suffix = F.col("g").bitwiseAND(F.lit((1 << 8 * order) - 1))
        counts[order] = staged(counts[order + 1].select(suffix.alias("g")).groupBy("g").agg(F.count("*").alias("c")), f"kn-continuations-{order}")
    shards = max(LEAST_SHARDS, -(-counts[ORDER].count() // SHARD_ROWS))
    tables, dense = None, np.full(1, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[order])
        rows = counts[order].withColumn("h", F.shiftright("g", 8)).withColumn("d", F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3))
        contexts = rows.groupBy("h").agg(F.sum("c").alias("total"), F.sum("d").alias("held"))
        shares = rows.join(contexts, "h").select("g", ((F.col("c") - F.col("d")) / F.col("total")).alias("value"))
        weights = contexts.select("h", (F.col("held") / F.col("total")).alias("value"))
        if order <= 2:  # at most 2**16 rows
            share, weight = shares.toPandas(), weights.toPandas()
            back = np.ones(SYMBOLS ** (order - 1))  # an unseen context leaves all to the shorter one
            back[weight.h.to_numpy()] = weight.value.to_numpy()
            dense = (back[:, None] * dense[None, :].repeat(len(back), 0)).ravel() if order == 2 else np.full(SYMBOLS, back[0] / SYMBOLS)
            dense[share.g.to_numpy()] += share.value.to_numpy()
            continue
        part = shares.select(F.lit(2 * order).alias("kind"), F.col("g").alias("key"), "value", F.shiftright("g", 8).bitwiseAND(F.lit(0xFFFF)).alias("pair"))
        part = part.unionByName(weights.select(F.lit(2 * order + 1).alias("kind"), F.col("h").alias("key"), "value", F.col("h").bitwiseAND(F.lit(0xFFFF)).alias("pair")))
        tables = part if tables is None else tables.unionByName(part)
    return Model(tables.select(shard_of(F.col("pair"), shards).cast("int").alias("shard"), F.col("kind").cast("int").alias("kind"), "key", "value"), shards, dense)


def probabilities(codes: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]], pairs: np.ndarray) -> np.ndarray:
    """p(last byte | bytes before) of n-grams of the highest order, seen or not; ``tables`` holds (sorted keys, values) by kind."""

    def value(kind: int, keys: np.ndarray, none: float) -> np.ndarray:
        known, values = tables.get(kind, (keys[:0], pairs[:0]))
        if not len(known):
            return np.full(len(keys), none)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], none)

    p = pairs[codes & 0xFFFF]
    for order in range(3, ORDER + 1):
        g = codes & ((1 << 8 * order) - 1)
        p = value(2 * order, g, 0.0) + value(2 * order + 1, g >> 8, 1.0) * p
    return p


def pressed(codes: np.ndarray) -> bytes:
    """Sorted codes as compressed differences, byte by byte."""
    steps = np.diff(codes, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8)
    return len(codes).to_bytes(4, "little") + pa.compress(steps.T.tobytes(), codec="zstd", asbytes=True)


def unpressed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel())


def by_shard(codes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its places in the sorted codes), for shards that have any."""
    shard = shard_of((codes >> 8) & 0xFFFF, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(codes) else ():
        yield int(shard[part[0]]), part


def _leads(ordered: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values is the first of its kind."""
    return np.concatenate((np.ones(min(1, len(ordered)), dtype=bool), ordered[1:] != ordered[:-1]))


def _different(codes: np.ndarray) -> np.ndarray:
    """The different codes, sorted; ``np.unique`` takes four times as long."""
    ordered = np.sort(codes)
    return ordered[_leads(ordered)]


def _distinct(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The different n-grams of all texts, sorted; what is found is merged whenever it has grown as large as what is known."""
    known, found, size = np.empty(0, dtype=np.int64), [], 0
    for _, part in _parts(column):
        found.append(_different(grams(part)[0]))
        size += len(found[-1])
        if size > len(known):
            known, found, size = _different(np.concatenate([known, *found])), [], 0
    return _different(np.concatenate([known, *found])) if found else known


def _scanned(docs: DataFrame) -> DataFrame:
    """``docs`` as a scan whose rows have a fixed place; what is no plain Parquet scan is written first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return staged(docs, "kn-documents")
    return docs


def _block(text: str) -> Column:
    """The block of a row: a stretch of its file, narrower for long texts."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    kind = F.when(size <= LONG, F.lit(0)).otherwise(F.length(F.bin(size)))
    rows = F.when(size <= LONG, F.lit(BLOCK_ROWS)).otherwise(F.greatest(F.lit(1), F.floor(BLOCK_BYTES / F.pow(F.lit(2.0), kind))))
    return F.xxhash64(F.col("_metadata.file_path"), kind, F.floor(F.col("_metadata.row_index") / rows))


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    blocks = batch.column(0).to_numpy()
    for block in np.unique(blocks):
        yield int(block), batch.filter(pa.array(blocks == block))


def asked(rows: DataFrame, shards: int) -> DataFrame:
    """(block, shard, codes): the different n-grams of the texts of each block in ``rows`` (block, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in ((b, p) for batch in batches for b, p in _by_block(batch)):
            codes = _distinct(part.column(1))
            pieces = [(shard, pressed(codes[at])) for shard, at in by_shard(codes, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(pieces), pa.int64()), pa.array([s for s, _ in pieces], pa.int32()), pa.array([c for _, c in pieces], pa.binary())], ["block", "shard", "codes"])

    return rows.mapInArrow(tidy(run), "block long, shard int, codes binary")


def costs(pieces: DataFrame, model: Model, copies: int = 1) -> DataFrame:
    """(block, codes, costs) of every piece (block, shard, codes): costs are bits as floats, in the order of the codes."""
    pairs = model.pairs

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, keys, values = (right.column(k).to_numpy() for k in ("kind", "key", "value"))
        tables = {}
        for kind in np.unique(kinds):
            k, v = keys[kinds == kind], values[kinds == kind]
            order = np.argsort(k)
            tables[int(kind)] = k[order], v[order]
        found = [(-np.log2(probabilities(unpressed(c.as_py()), tables, pairs))).astype("<f4").tobytes() for c in left.column("codes")]
        release_memory()
        return pa.table({"block": left.column("block"), "codes": left.column("codes"), "costs": pa.array(found, pa.binary())})

    spread = pieces.withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int"))
    tables = model.tables.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return spread.groupBy("shard", "copy").cogroup(tables.groupBy("shard", "copy")).applyInArrow(run, "block long, codes binary, costs binary")


def _packed(rows: DataFrame) -> DataFrame:
    """(block, rows): the rows (block, ...) of a block as compressed Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for block, part in ((b, p) for batch in batches for b, p in _by_block(batch)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return rows.mapInArrow(tidy(run), "block long, rows binary")


def _bits(column: pa.Array, known: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bits per byte, share of different n-grams) of every text; not a number without text."""
    sizes = np.zeros(len(column), dtype=np.int64)
    bits, variety = np.full(len(column), np.nan), np.full(len(column), np.nan)
    for first, part in _parts(column):
        codes, n = grams(part)
        if not len(codes):
            continue
        sizes[first : first + len(part)] = n
        filled = np.flatnonzero(n)  # no more than 2**20 in a part, so their numbers fit beside the codes
        # n-grams are looked up in order and once a part: at every byte by itself they would be found far apart in ``known``
        keys = np.sort(codes << TEXT_BITS | np.repeat(np.arange(len(filled)), n[filled]))
        starts = np.flatnonzero(_leads(keys))
        times, code, number = np.diff(starts, append=len(keys)), keys[starts] >> TEXT_BITS, keys[starts] & ((1 << TEXT_BITS) - 1)
        lead = _leads(code)
        paid = price[np.searchsorted(known, code[lead])].astype(np.float64)[np.cumsum(lead) - 1]
        bits[first + filled] = np.bincount(number, weights=times * paid, minlength=len(filled)) / n[filled]
        variety[first + filled] = np.bincount(number, minlength=len(filled)) / n[filled]
    return sizes, bits, variety


def score(docs: DataFrame, model: Model, *, text: str = "text", kept: list[str] | None = None) -> DataFrame:
    """``row, apart, n_bytes, bits, variety``: the columns ``kept`` of every row as a struct, and the bits per byte of its whole text."""
    ship_package(docs.sparkSession)
    docs = _scanned(docs)
    kept = docs.columns if kept is None else kept
    bytes_ = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    copies = max(1, -(-bytes_ // (COPY_BYTES * model.shards)))
    shards = model.shards
    found = costs(asked(docs.select(_block(text).alias("block"), F.col(text).alias("text")), shards), model, copies)
    rows = _packed(docs.select(_block(text).alias("block"), F.struct(*docs.columns).alias("row"), _judged_apart(text).alias("apart")))
    row = T.StructType([docs.schema[c] for c in kept])
    where, places = docs.columns.index(text), [docs.columns.index(c) for c in kept]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [unpressed(c.as_py()) for c in right.column("codes")] or [np.empty(0, dtype=np.int64)]
        price = [np.frombuffer(c.as_py(), dtype="<f4") for c in right.column("costs")] or [np.empty(0, dtype=np.float32)]
        known, price = np.concatenate(known), np.concatenate(price)
        order = np.argsort(known)
        order = order[_leads(known[order])]  # a block asked in several batches may have an n-gram in each, at the same price
        known, price = known[order], price[order]
        out = []
        for packed in left.column("rows"):
            for part in pa.ipc.open_stream(packed.as_buffer()):
                whole = part.column(1)
                sizes, bits, variety = _bits(whole.field(where), known, price)
                row = pa.StructArray.from_arrays([whole.field(k) for k in places], fields=[whole.type.field(k) for k in places])
                out.append(pa.record_batch([row, part.column(2), pa.array(sizes), pa.array(bits, from_pandas=True), pa.array(variety, from_pandas=True)], ["row", "apart", "n_bytes", "bits", "variety"]))
        release_memory()
        return pa.Table.from_batches(out)

    schema = T.StructType([T.StructField("row", row), *(T.StructField(*f) for f in (("apart", T.BooleanType()), ("n_bytes", T.LongType()), ("bits", T.DoubleType()), ("variety", T.DoubleType())))])
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of trusted documents; up to ``BROADCAST_ROWS`` of them go to the texts, beyond it both sides are shuffled."""
    ids = staged(labels.where("quality = 1 AND toxic = 0").select(F.col(key).cast("long").alias("doc_id")).distinct(), "kn-trusted")
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _judged_apart(text: str) -> Column:
    """Trusted documents that set the thresholds and do not train: a fifth, by a hash of the text, so copies stay together."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit("threshold")), F.lit(5)) == 0


def graded(docs: DataFrame, labels: DataFrame, *, key: str, text: str, lang: str, kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored rows with ``id``, ``tongue`` and ``grade``, the trusted ids)."""
    trusted = trusted_ids(labels, key)
    ids = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = train(ids.where(~_judged_apart("text")).join(trusted, "doc_id", "left_semi").select("text"))
    powers = F.length(F.bin(F.greatest("n_bytes", F.lit(1)))) - 1
    tongue = F.col("row").getField(lang)
    scored = score(docs, model, text=text, kept=kept).select(
        "row", "n_bytes", "bits", "variety", "apart", F.col("row").getField(key).cast("long").alias("id"),
        F.when(tongue.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), tongue)).alias("tongue"),
        F.least(F.greatest(F.floor(powers / 2), F.lit(2)), F.lit(6)).cast("int").alias("grade"),
    )
    return staged(scored, "kn-scores"), trusted


def thresholds(scored: DataFrame, trusted: DataFrame, quantile: float) -> DataFrame:
    """(tongue, grade, threshold, least_variety) of every language and length class that occurs."""
    known = scored.where("bits IS NOT NULL AND apart").select(F.col("id").alias("doc_id"), "tongue", "grade", "bits", "variety").join(trusted, "doc_id", "left_semi")
    at = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(10_000))
    both = lambda: F.struct(F.count("*").alias("n"), at("bits", quantile).alias("high"), at("variety", 1 - quantile).alias("low"))
    # as many rows as languages and length classes
    fine, coarse = known.groupBy("tongue", "grade").agg(both().alias("fine")), known.groupBy("tongue").agg(both().alias("coarse"))
    every = known.agg(both().alias("every")).first().every
    limits = scored.select("tongue", "grade").distinct().join(fine, ["tongue", "grade"], "left").join(coarse, "tongue", "left")
    limits = limits.withColumn("every", F.struct(F.lit(every.high).cast("double").alias("high"), F.lit(every.low).cast("double").alias("low")))
    enough = lambda c: F.coalesce(F.col(f"{c}.n"), F.lit(0)) >= LEAST_CLASS
    high = F.when(enough("fine"), F.col("fine.high")).otherwise(F.greatest("fine.high", F.when(enough("coarse"), F.col("coarse.high")).otherwise(F.greatest("coarse.high", "every.high"))))
    low = F.when(enough("fine"), F.col("fine.low")).otherwise(F.least("fine.low", F.when(enough("coarse"), F.col("coarse.low")).otherwise(F.least("coarse.low", "every.low"))))
    limits = staged(limits.select("tongue", "grade", high.alias("threshold"), (low / 2).alias("least_variety")), "kn-limits")
    return F.broadcast(limits) if limits.count() <= BROADCAST_LIMITS else limits


KEPT = "bits IS NOT NULL AND (threshold IS NULL OR (bits <= threshold AND variety >= least_variety))"


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.995, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, lang, n_bytes, bits, perplexity, threshold, kept`` for every row.

    ``labels`` has (doc_id, quality, toxic); trusted are documents of quality 1 that are not toxic.  Four fifths of them
    train the model, the others set the thresholds: the quantile of bits per byte among those of the same language and
    length class (powers of four), or the largest of the wider groups' where the class has under ``LEAST_CLASS`` of them;
    and likewise the least share of different n-grams.  A null or empty text has no perplexity and is not kept; a null
    language is a language of its own; repeated rows are judged alike; without trusted text to set thresholds everything
    that has text is kept; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    scored, trusted = graded(slim, labels.withColumnRenamed(key, "doc_id"), key="doc_id", text="text", lang="lang", kept=["doc_id", "lang"])
    limits = thresholds(scored, trusted, quantile)
    return scored.join(limits, ["tongue", "grade"], "left").select("row.doc_id", "row.lang", "n_bytes", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "threshold", F.expr(KEPT).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.995, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their columns, that ``classify`` keeps; nulls, empty texts and tables and repeated rows as there."""
    scored, trusted = graded(docs, labels, key=key, text=text, lang=lang)
    limits = thresholds(scored, trusted, quantile)
    return scored.join(limits, ["tongue", "grade"], "left").where(KEPT).select("row.*")
