"""Writers: atomic documents, cache upserts, nested results, cut lists and selected photos."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import split_window
from framelake.operators.merges import latest
from framelake.operators.segments import ranks
from framelake.session import staged


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document with all rows under ``rows``, which one task holds: a session's export, not a corpus.

    The document is written beside its place and renamed over it, so readers see the old or the new one.
    """
    spark = df.sparkSession
    doc = df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias("rows"))).alias("value"))  # one exported document
    staging = f"{path}.{uuid.uuid4().hex}"
    doc.coalesce(1).write.text(staging)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fs.makeQualified(part), fs.makeQualified(target), renames)
    fs.delete(source, True)


def write_documents(rows: DataFrame, path: str, *, session: str, name: str | None, order: list[str]) -> None:
    """One JSON document a session, in the folder ``session=`` of ``path``: its rows in order, as a list or ``under`` a name."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[F.col(c) for c in rows.columns if c != session]).alias("__row")))), lambda x: x["__row"])
    docs = rows.groupBy(F.col(session).alias("session")).agg(items.alias("rows"))
    value = F.to_json("rows") if name is None else F.to_json(F.struct(F.col("rows").alias(name)))
    docs.select("session", value.alias("value")).repartition("session").write.partitionBy("session").text(path)


def upsert(log_path: str, rows: DataFrame, *, key: list[str]) -> DataFrame:
    """Appends rows to a store and gives its newest-wins view.

    Every append has a version above all before it; of rows of one append with the same key the last row counts, so the
    view does not hang on the clock.
    """
    spark = rows.sparkSession
    top = spark.read.parquet(log_path).agg(F.max("version")).first()[0] if _exists(spark, log_path) else None
    rows.withColumns({"version": F.lit((top or 0) + 1).cast("long"), "row_at": F.monotonically_increasing_id()}).write.mode("append").parquet(log_path)
    return latest(spark.read.parquet(log_path), key=key, order=[F.col("version"), F.col("row_at")])


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def nested(rows: DataFrame, *, by: str, order: list[str], fields: list[str], name: str = "members") -> DataFrame:
    """Rows grouped back into ordered arrays."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))


def concat_batches(parts: list[DataFrame]) -> DataFrame:
    """All rows of all batches, nothing merged; (batch, ...)."""
    out = None
    for k, p in enumerate(parts, 1):
        rows = p.withColumn("batch", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def clip_segments(clips: DataFrame, files: DataFrame, *, clip: str, file: str, start: str, end: str, order: str, duration: str) -> DataFrame:
    """(clip, part, file, start, end): the window within its file, and what is left in the next file if there is one."""
    ranked = staged(ranks(files.select(*dict.fromkeys((file, order, duration))), [order], "__at"), "clip-files")
    after = ranked.select((F.col("__at") - 1).alias("__at"), F.col(file).alias("__next"))
    named = ranked.join(after, "__at", "left").select(F.col(file), F.col(duration).alias("__d"), "__next")
    cut = clips.join(named, file).withColumn("__w", split_window(F.col(start), F.col(end), F.col("__d")))
    own = cut.select(clip, F.lit(1).alias("part"), file, F.col("__w.start").alias("start"), F.col("__w.end").alias("end"))
    over = cut.where((F.col("__w.over") > 0) & F.col("__next").isNotNull()).select(clip, F.lit(2).alias("part"), F.col("__next").alias(file), F.lit(0).alias("start"), F.col("__w.over").alias("end"))
    return own.unionByName(over)


def numbered_clips(goals: DataFrame, *, order: list[str], present: Column, name: str = "clip") -> DataFrame:
    """Numbers from 001 over all goals in order; a goal whose source is missing keeps its number."""
    return ranks(goals, order, "number").withColumn(name, F.format_string("%03d", "number")).withColumn("present", present)


def selected_photos(selections: DataFrame, candidates: DataFrame, *, key: str) -> tuple[DataFrame, DataFrame]:
    """(renamed photos in order, unknown selections)."""
    chosen = ranks(selections.join(candidates, key), ["video_no", "deciseconds", key], "number")
    name = F.format_string("%03d_v%03d_t%04d.%d.jpg", F.col("number"), F.col("video_no").cast("int"), F.floor(F.col("deciseconds") / 10).cast("int"), F.pmod(F.col("deciseconds"), F.lit(10)).cast("int"))
    return chosen.withColumn("file_name", name).drop("number"), selections.join(candidates, key, "left_anti")
