"""Personal data: pattern spans, and terms that give a protected entity away.

Emails, IP addresses, card and phone numbers are found by their patterns (``base_spans``).  Each value is a protected
entity.  All words of the texts that name it are its context terms; over whole texts the pointwise mutual information

    PMI(e; t) = log2( N * df(e, t) / (df(e) * df(t)) )

says how strongly term t reveals entity e, whose own information is IC(e) = log2(N / df(e)).  A term that stands with the
entity in at least ``support`` different texts discloses it from PMI >= ``alpha`` * IC on.  An entity with fewer texts is
weaker evidence, so there the term must stand in all of them and reveal the entity wholly: PMI = IC, the term never occurs
without it.  Each occurrence of a disclosing term in any text is generalised (a plain word) or removed (``alpha`` * IC is
reached even if the term were ``remove_factor`` times as common).

Counts are over all rows.  The per-entity and per-term counts are aggregated before they are shuffled, hot texts collapse
to one row with a multiplicity first, and joins without aggregation are by the text's digest or the word, which AQE splits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import settle, ship_package, tidy

from .common import staged

KINDS = ("email", "ip", "card", "phone")
# fixed values: the patterns; the guards before digits and signs only spare hopeless starts within a longer run
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
NUMBER = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "drop": ""}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255
    return [m.span() for m in ADDRESS.finditer(text) if all(map(small, m.group().split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *s) for s in addresses(text)] + [("card", *s) for s in cards(text)]
        found += [("phone", *s) for s in phones(text)] if "+" in text else []
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entities_of(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    return sorted({xxhash.xxh64_intdigest(f"{kind}:{text[a:b].lower()}", 42) - (1 << 63) for kind, a, b in spans})


def outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of the words that touch no span."""
    taken = sorted((a, b) for _, a, b in spans)
    k, done = 0, 0  # done: the furthest end of the spans that start before the word's end
    for m in WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            done = max(done, taken[k][1])
            k += 1
        if m.start() >= done:
            yield m.start(), m.end(), m.group().lower()


FOUND = "doc_id long, text_key string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entities array<long>, near array<string>"
SPANS = "text_key string, terms array<struct<start:int,end:int,how:string>>"
HIT = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("how", pa.string())]))
BROADCAST_ROWS, BROADCAST_TEXTS = 1_000_000, 5_000_000


def find_base(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pattern spans, their digest, the entities and their context terms of every row; ``text_key`` is the text's MD5."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                body = x.as_py() or ""
                spans = base_spans(body)
                kinds = [k for k, _, _ in spans]
                line = joined(spans)
                rows.append((hashlib.md5(body.encode()).hexdigest(), *(kinds.count(k) for k in KINDS), hashlib.sha256(line.encode()).hexdigest(), line, entities_of(body, spans), sorted({t for _, _, t in outside(body, spans)}) if spans else []))
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            types = (pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()))
            names = [x.split()[0] for x in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.selectExpr(f"cast(`{key}` as long) AS doc_id", f"`{text}` AS text").mapInArrow(tidy(run), FOUND)


def _words(column: str) -> F.Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}]+"))


def disclosing(found: DataFrame, docs: DataFrame, *, alpha: float = 0.8, support: int = 3, remove_factor: float = 4.0, text: str = "text") -> DataFrame:
    """(term, how) of the terms beyond the disclosure threshold of an entity; how is ``term`` (generalise) or ``drop``."""
    n = found.count()
    texts = staged(found.where(F.size("entities") > 0).groupBy("text_key").agg(F.count("*").alias("rows"), F.any_value("entities").alias("entities"), F.any_value("near").alias("near")), "pii-texts")
    named = texts.select("rows", "near", F.explode("entities").alias("entity"))
    entities = named.groupBy("entity").agg(F.sum("rows").alias("df_e"), F.count("*").alias("texts_e"))
    pairs = named.select("rows", "entity", F.explode("near").alias("term")).groupBy("entity", "term").agg(F.sum("rows").alias("df_et"), F.count("*").alias("texts"))
    pairs = pairs.join(entities, "entity").withColumn("rare", F.col("texts_e") < support)
    pairs = staged(pairs.where(F.col("texts") >= F.least(F.lit(support), "texts_e")), "pii-pairs")
    words = docs.select(F.explode(_words(text)).alias("word"))
    frequencies = words.groupBy(F.xxhash64("word").alias("code")).agg(F.count("*").alias("df_t"))  # every word is counted, by its hash
    scored = pairs.withColumn("code", F.xxhash64("term")).join(frequencies, "code")
    pmi = F.log2(F.lit(float(n)) * F.col("df_et") / (F.col("df_e") * F.greatest("df_t", "df_et")))
    scored = scored.withColumn("over", pmi - alpha * F.log2(F.lit(float(n)) / F.col("df_e"))).where(f"df_e < {max(n, 1)} AND IF(rare, df_t <= df_et, over >= 0)")
    how = F.when(~F.col("rare") & (F.col("over") >= F.log2(F.lit(remove_factor))), "drop").otherwise("term")
    return scored.groupBy("term").agg(F.min(how).alias("how"))


def revealing_spans(docs: DataFrame, disclosed: DataFrame, *, text: str = "text") -> DataFrame:
    """``text_key, terms``: the spans of all occurrences of disclosing terms in each text, in order."""
    ship_package(docs.sparkSession)
    disclosed = staged(disclosed, "pii-terms")
    if disclosed.count() <= BROADCAST_ROWS:  # beyond it the join shuffles the words
        disclosed = F.broadcast(disclosed)
    bodies = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    opened = bodies.select("text_key", F.explode(_words("text")).alias("term")).join(disclosed, "term")
    hits = staged(opened.groupBy("text_key").agg(F.collect_set(F.struct("term", "how")).alias("hits")), "pii-hits")
    if hits.count() <= BROADCAST_TEXTS:  # so that only texts with hits are shuffled
        bodies = bodies.join(F.broadcast(hits.select(F.xxhash64("text_key").alias("code"))), F.xxhash64("text_key") == F.col("code"), "left_semi")
    once = bodies.join(hits.hint("merge"), "text_key").groupBy("text_key").agg(F.any_value("text").alias("text"), F.any_value("hits").alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, terms in zip(batch.column(1), batch.column(2), strict=True):
                body, how = body.as_py(), {t["term"]: t["how"] for t in terms.as_py()}
                out.append([{"start": a, "end": b, "how": how[t]} for a, b, t in outside(body, base_spans(body)) if t in how])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, HIT)], ["text_key", "terms"])

    return staged(once.mapInArrow(tidy(run), SPANS).where(F.size("terms") > 0), "pii-spans")


def detect(docs: DataFrame, *, alpha: float = 0.8, support: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, counts by kind, ``base_sha256``, ``spans`` and ``n_term`` for every row.

    A null text is empty; repeated rows are found alike; a null id is kept; an empty table gives no rows; other columns
    are ignored.  ``spans`` lists the base spans, then ``term`` spans by start.
    """
    found = staged(find_base(docs, key=key, text=text), "pii-found")
    terms = revealing_spans(docs, disclosing(found, docs, alpha=alpha, support=support, text=text), text=text)
    extra = F.concat_ws(",", F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])))
    all_spans = F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(extra, F.lit("")))
    return found.join(terms, "text_key", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.coalesce(all_spans, F.lit("")).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term")
    )


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its label; of overlapping spans the one that starts first, then the longer, counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], LABELS[kind]]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, *, alpha: float = 0.8, support: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the same columns and ``text`` sanitised; a null text stays null, rows are neither added nor lost."""
    found = staged(find_base(docs, key=key, text=text), "pii-found")
    settle(docs.sparkSession)
    terms = revealing_spans(docs, disclosing(found, docs, alpha=alpha, support=support, text=text), text=text)
    settle(docs.sparkSession)
    names = docs.columns

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for x, t in zip(batch.column(names.index(text)), batch.column(len(names)).to_pylist(), strict=True):
                body = x.as_py()
                new.append(None if body is None else masked(body, base_spans(body) + [(s["how"], s["start"], s["end"]) for s in t or []]))
            columns = [pa.array(new, pa.string()) if name == text else batch.column(k) for k, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    marked = docs.withColumn("__text_key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    marked = marked.join(terms.select(F.col("text_key").alias("__text_key"), F.col("terms").alias("__terms")), "__text_key", "left").select(*names, "__terms")
    return marked.mapInArrow(tidy(mask), docs.schema)
