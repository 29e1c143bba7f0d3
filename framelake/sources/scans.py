"""Readers of detection caches, candidate lists, goal lists, rosters and stores; each gives a flat table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake import schemas
from framelake.errors import SchemaError


def documents(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """Whole-document JSON files under an explicit schema, with their ``path``; a corrupt one fails a strict read."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def file_id(path: Column) -> Column:
    """The stem of a file's name."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def detection_caches(spark: SparkSession, path: str) -> DataFrame:
    """One row for each cache: (fid, frames, balls, persons, hoops); lists must have as many frames as stated."""
    return consistent_caches(documents(spark, path, schemas.CACHE_JSON), name=file_id(F.col("path")))


def consistent_caches(raw: DataFrame, *, name: Column) -> DataFrame:
    """Caches as read, with their file's ``name``; one whose lists have other lengths than stated fails the run."""
    good = (F.size("balls") == F.col("frames")) & (F.size("persons") == F.col("frames"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("frames")).otherwise(F.raise_error(F.concat(F.lit("frame counts differ in "), F.col("path"))).cast("int"))
    return raw.select(name.alias("fid"), checked.alias("frames"), "balls", "persons", "hoops")


def valid_caches(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Caches that can be used again: readable, and with the expected number of frames (fid, frames) and structure."""
    return usable_caches(documents(spark, path, schemas.CACHE_JSON, strict=False).withColumn("fid", file_id(F.col("path"))), expected)


def usable_caches(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """Of the caches as read (fid, …) those without a defect that have the expected number of frames."""
    good = F.col("_corrupt_record").isNull() & (F.size("balls") == F.col("frames")) & (F.size("persons") == F.col("frames"))
    rows = raw.select("fid", "frames", "balls", "persons", "hoops", F.coalesce(good, F.lit(False)).alias("__good"))
    return rows.where("__good").join(expected.select("fid", F.col("frames").alias("__want")), "fid").where("frames = __want").select("fid", "frames", "balls", "persons", "hoops")


def frames(caches: DataFrame) -> DataFrame:
    """The dense spine: (fid, frame_idx, sec)."""
    return caches.where("frames > 0").select("fid", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame_idx")).withColumn("sec", F.col("frame_idx") / schemas.FPS)


def _opened(caches: DataFrame, column: str, item: str) -> DataFrame:
    outer = caches.select("fid", F.posexplode(column).alias("frame_idx", "__list"))
    return outer.select("fid", "frame_idx", F.posexplode("__list").alias(item, "__x"))


def ball_detections(caches: DataFrame) -> DataFrame:
    at = lambda k: F.col("__x.box")[k]
    return _opened(caches, "balls", "det_idx").select("fid", "frame_idx", "det_idx", F.col("__x.sec").alias("sec"), F.col("__x.conf").alias("conf"), at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2"), F.col("__x.cx").alias("cx"), F.col("__x.cy").alias("cy"))


def person_boxes(caches: DataFrame) -> DataFrame:
    """A degenerate person box fails."""
    x = F.col("__x")
    good = (F.size(x) == 4) & (x[2] > x[0]) & (x[3] > x[1])
    first = F.when(good, x[0]).otherwise(F.raise_error(F.lit("a degenerate person box")).cast("int"))
    return _opened(caches, "persons", "box_idx").select("fid", "frame_idx", "box_idx", first.alias("x1"), x[1].alias("y1"), x[2].alias("x2"), x[3].alias("y2"))


def hoop_detections(caches: DataFrame, least_conf: float = 0.25) -> DataFrame:
    """Hoops above the confidence (strictly), centres cut to whole pixels; caches without the key give none."""
    rows = _opened(caches.where("hoops IS NOT NULL"), "hoops", "det_idx")
    return rows.where(F.col("__x.conf") > least_conf).select("fid", "frame_idx", "det_idx", F.col("__x.conf").alias("conf"), F.col("__x.cx").cast("int").alias("cx"), F.col("__x.cy").cast("int").alias("cy"))


def source_media(spark: SparkSession, path: str) -> DataFrame:
    """Video files by name: (path, fid, length, ordinal); two with one stem fail."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][pP]4").load(path).select("path", "length")
    named = files.withColumn("fid", file_id(F.col("path")))
    twice = F.count("*").over(Window.partitionBy("fid"))
    unique = F.when(twice == 1, F.col("fid")).otherwise(F.raise_error(F.concat(F.lit("two files are named "), F.col("fid"))))
    return named.select("path", unique.alias("fid"), "length", F.row_number().over(Window.orderBy("fid")).alias("ordinal"))  # files of one session


def session_facts(spark: SparkSession, path: str) -> DataFrame:
    raw = documents(spark, path, "files map<string,struct<width:int,height:int,fps:double,duration:double>>")
    rows = raw.select(F.explode("files").alias("name", "f")).select("name", file_id(F.col("name")).alias("fid"), "f.*")
    good = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("fps") > 0) & (F.col("duration") > 0)
    return rows.withColumn("width", F.when(F.coalesce(good, F.lit(False)), F.col("width")).otherwise(F.raise_error(F.concat(F.lit("a fact is missing or not positive: "), F.col("name"))).cast("int")))


def candidates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Candidates of all batches in file order: (…, file_idx, ordinal)."""
    out = None
    for k, p in enumerate(paths):
        rows = documents(spark, p, schemas.CANDIDATES_JSON).withColumn("file_idx", F.lit(k)).withColumn("ordinal", F.monotonically_increasing_id())
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise SchemaError("no candidate file is given")
    return out


def hoop_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with typed tracks: the stored points mix numbers and words and are cast one by one."""
    raw = documents(spark, path, schemas.HOOPS_JSON).select(F.posexplode("events").alias("event_idx", "e"))
    point = lambda p: F.struct(p[0].cast("double").alias("sec"), p[1].cast("int").alias("cx"), p[2].cast("int").alias("cy"), p[3].alias("src"))
    return raw.select("e.fid", "event_idx", F.col("e.window")[0].alias("w0"), F.col("e.window")[1].alias("w1"), F.col("e.anchor")[0].cast("int").alias("anchor_cx"), F.col("e.anchor")[1].cast("int").alias("anchor_cy"), "e.detected", F.transform("e.track", point).alias("track"))


def goals(spark: SparkSession, path: str, *, confirmed: bool = True) -> DataFrame:
    raw = documents(spark, path, f"goals array<struct<{', '.join(':'.join(x.split()) for x in schemas.GOAL.split(', '))}>>")
    rows = raw.select(F.posexplode("goals").alias("ordinal", "g")).select("ordinal", "g.*")
    return rows.where("status = 'confirmed'") if confirmed else rows


def scorer_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCORER_CANDIDATE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(players, assignments); a tag that occurs twice fails."""
    raw = documents(spark, path, "session string, confirmed boolean, players array<struct<tag:string,name:string,team:string>>, assignments map<string,string>")
    people = raw.select(F.posexplode("players").alias("ordinal", "p")).select("ordinal", "p.*")
    once = F.when(F.count("*").over(Window.partitionBy("tag")) == 1, F.col("tag")).otherwise(F.raise_error(F.concat(F.lit("a tag occurs twice: "), F.col("tag"))))
    return people.withColumn("tag", once), raw.select(F.explode("assignments").alias("key", "tag"))


def players_from_text(df: DataFrame, column: str) -> DataFrame:
    """``tag=name,tag=name`` strings as rows."""
    pairs = df.select(F.posexplode(F.split(column, ",")).alias("ordinal", "pair"))
    return pairs.select("ordinal", F.trim(F.element_at(F.split("pair", "=", 2), 1)).alias("tag"), F.trim(F.get(F.split("pair", "=", 2), F.lit(1))).alias("name")).where("tag <> ''")


def embedding_cache(spark: SparkSession, path: str, model_tag: str) -> DataFrame:
    """The vectors of one model; a store partitioned by ``model_tag`` reads only that partition.  None at all fails."""
    rows = spark.read.schema(schemas.EMBEDDING).parquet(path).where(F.col("model_tag") == model_tag)
    if rows.isEmpty():
        raise SchemaError(f"no vector has the model tag {model_tag}")
    return rows


def photo_gallery(spark: SparkSession, path: str) -> DataFrame:
    """photos/<number>/*.{jpg,jpeg,png} as (number, path, md5); numbers that differ only in leading zeros fail."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png}").load(path)
    rows = files.select("path", F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).alias("raw"), F.md5("content").alias("md5")).where("raw <> ''").withColumn("number", F.regexp_replace("raw", r"^0+(?=\d)", ""))
    spellings = F.size(F.collect_set("raw").over(Window.partitionBy("number")))
    return rows.select(F.when(spellings == 1, F.col("number")).otherwise(F.raise_error(F.concat(F.lit("numbers collide: "), F.col("number")))).alias("number"), "path", "md5")


def batches(spark: SparkSession, path: str, name: str = "goals") -> DataFrame:
    """(batch, path) of ``<name>.json`` (batch 1) and ``<name>_batchK.json``; two files for one batch fail."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}*.json").load(path).select("path")
    found = files.select("path", F.regexp_extract("path", rf"/{name}(?:_batch(\d+))?\.json$", 1).alias("k"), F.col("path").rlike(rf"/{name}(_batch\d+)?\.json$").alias("fits")).where("fits")
    rows = found.select(F.when(F.col("k") == "", 1).otherwise(F.expr("try_cast(k AS int)")).alias("batch"), "path")
    once = F.when(F.count("*").over(Window.partitionBy("batch")) == 1, F.col("batch")).otherwise(F.raise_error(F.concat(F.lit("two files for batch "), F.col("batch").cast("string"))).cast("int"))
    return rows.select(once.alias("batch"), "path")


def detections_of_events(events: DataFrame) -> DataFrame:
    """The event table read as detections: user as file, 12-minute frames, a place and confidence from the id and value.

    (fid, frame, det, cx, cy, conf, k, role), all whole numbers but conf.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return events.select(
        F.col("user_id").cast("long").alias("fid"), F.floor(micros / 720_000_000).cast("long").alias("frame"), F.col("event_id").cast("long").alias("det"), ((F.col("event_id") * 7919) % 1920).cast("long").alias("cx"),
        ((F.col("event_id") * 104729) % 1080).cast("long").alias("cy"), F.least(F.col("value") / 200, F.lit(1.0)).alias("conf"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("role"),
    )
