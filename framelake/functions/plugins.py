"""Seams for models: a callable made once a worker process maps batches; weights are never part of this package.

A plug-in is a factory (no arguments) that gives a callable from a list of paths or contents to one result each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.errors import SchemaError
from framelake.session import ship_package

Factory = Callable[[], Callable[[list], list]]


def only_misses(requests: DataFrame, cache: DataFrame, *, key: list[str]) -> DataFrame:
    """Requests whose key is not cached yet, each key once: the only rows that a model sees."""
    return requests.dropDuplicates(key).join(cache.select(*key).distinct(), key, "left_anti")


def check_budget(requests: DataFrame, cache: DataFrame, *, key: list[str], most: int) -> None:
    """Fails before any model call if more than ``most`` distinct keys would be asked."""
    n = only_misses(requests, cache, key=key).count()
    if n > most:
        raise SchemaError(f"{n} readings are needed and {most} allowed")


def map_model(rows: DataFrame, factory: Factory, *, column: str, keep: list[str], result: str) -> DataFrame:
    """One model result for every row (``result`` is "name type"); the model is made at a task's first batch."""
    ship_package(rows.sparkSession)
    name = result.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if len(pdf):
                model = model or factory()
                yield pdf[keep].assign(**{name: model(pdf[column].tolist())})

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*dict.fromkeys([*keep, column])).mapInPandas(run, ", ".join([*(f"`{k}` {fields[k]}" for k in keep), result]))


def detect_faces(photos: DataFrame, factory: Factory, *, column: str = "path", keep: list[str]) -> DataFrame:
    """(keep..., face, w, h, score, vec): one row a face; a photo without any gives one row of nulls, so it is cached too."""
    found = map_model(photos, factory, column=column, keep=keep, result="faces array<struct<w:int,h:int,score:double,vec:array<double>>>")
    return found.select(*keep, F.posexplode_outer("faces").alias("face", "__f")).select(*keep, "face", "__f.*")


def register_gallery(faces: DataFrame, *, number: str, photo: str, least_width: int = 120) -> DataFrame:
    """(number, photo, vec, verdict): the largest face of each photo; narrow or absent ones are kept as audit rows."""
    from framelake.operators.joins import nearest

    best = nearest(faces, by=[number, photo], order=[F.desc_nulls_last(F.col("w") * F.col("h")), F.col("face")])
    verdict = F.when(F.col("vec").isNull(), "no_face").when(F.col("w") < least_width, "too_small").otherwise("kept")
    return best.select(number, photo, F.when(verdict == "kept", F.col("vec")).alias("vec"), verdict.alias("verdict"))


def gate_reason(ratio_reason: Column, person_conf: Column, *, least: float = 0.25) -> Column:
    """Why a crop fails: its shape first, and only for good shapes the person check."""
    return F.when(ratio_reason.isNotNull(), ratio_reason).when(F.coalesce(person_conf, F.lit(0.0)) < least, "no_person")


def crop_team(black: Column, white: Column, *, least_black: float = 0.25, least_white: float = 0.20) -> Column:
    """The team that a torso's shares of black and white pixels name."""
    from framelake.schemas import BLACK, CASUAL, WHITE

    return F.when(black >= least_black, BLACK).when(white >= least_white, WHITE).otherwise(CASUAL)


def sharpest(frames: DataFrame, *, by: list[str], variance: str = "lap_var", order: str = "frame", floor: float = 15.0) -> DataFrame:
    """The sharpest frame of each group, none if it is under the floor."""
    from framelake.operators.joins import nearest

    return nearest(frames.where(F.col(variance).isNotNull()), by=by, order=[F.desc(variance), F.col(order)]).where(F.col(variance) >= floor)


def digit_components(parts: DataFrame, *, by: list[str], least_area: int = 30, least_height: float = 0.2) -> DataFrame:
    """Components (x1, y1, x2, y2, area, height share) that can be digits: large enough and not strictly within another."""
    good = parts.where((F.col("area") >= least_area) & (F.col("height") >= least_height))
    other = good.select(*by, *[F.col(c).alias(f"o_{c}") for c in ("part", "x1", "y1", "x2", "y2")])
    nested = (F.col("o_part") != F.col("part")) & (F.col("x1") > F.col("o_x1")) & (F.col("y1") > F.col("o_y1")) & (F.col("x2") < F.col("o_x2")) & (F.col("y2") < F.col("o_y2"))
    inner = good.join(other, by).where(nested).select(*by, "part").distinct()
    return good.join(inner, [*by, "part"], "left_anti")


def read_digits(scores: DataFrame, *, by: list[str], least: float = 0.55, sure: float = 0.75, most: int = 2) -> DataFrame:
    """(by..., number, confidence) from template scores (part, x1, digit, score): the best digit of each part, left to
    right; null if one is unlike all or there are more than ``most``."""
    from framelake.operators.joins import nearest

    best = nearest(scores, by=[*by, "part"], order=[F.desc("score"), F.col("digit")])
    per = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x1", "part", "digit"))).alias("ds"), F.min("score").alias("low"), F.count("*").alias("n"))
    good = (F.col("low") >= least) & (F.col("n") <= most)
    text = F.concat_ws("", F.transform("ds", lambda d: d["digit"].cast("string")))
    return per.select(*by, F.when(good, F.regexp_replace(text, r"^0+(?=\d)", "")).alias("number"), F.when(good, F.when(F.col("low") >= sure, "high").otherwise("low")).alias("confidence"))


def digit_library(samples: DataFrame, *, least: int = 3) -> DataFrame:
    """Template digits from labelled crops (key, number, parts ordered by x): samples with as many parts as digits count,
    and a digit is enabled at ``least`` samples."""
    digits = F.filter(F.split("number", ""), lambda d: d != "")
    fit = samples.where(F.size(digits) == F.size("parts"))
    pairs = fit.select("key", F.explode(F.arrays_zip(digits.alias("digit"), F.col("parts").alias("part"))).alias("z")).select("key", "z.digit", "z.part")
    return pairs.groupBy("digit").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("part")).alias("templates")).where(F.col("n") >= least)
