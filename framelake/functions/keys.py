"""Keys, tags, numbers and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.schemas import BLACK, CASUAL, OPPONENT, PLAYER_KEYS, WHITE


def stem(file: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file, r"\.[^.]+$", "")


def goal_key(file: Column, deciseconds: Column) -> Column:
    """``<file>#<seconds with one decimal>`` from whole deciseconds, so no float is formatted."""
    d = deciseconds.cast("long")
    return F.concat(file, F.lit("#"), F.floor(d / 10).cast("string"), F.lit("."), F.pmod(d, F.lit(10)).cast("string"))


def first_crops(crops: Column, crop: Column) -> Column:
    """The non-empty entries of the newer field, else the older field as a list, else an empty list."""
    several = F.filter(F.coalesce(crops, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    single = F.when(F.coalesce(crop, F.lit("")) != "", F.array(crop)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(several) > 0, several).otherwise(single)


def seed_box(values: Column, frame: Column) -> Column:
    """(frame, box) or null if a part is missing or the box degenerate."""
    at = lambda k: F.get(values, F.lit(k))
    good = frame.isNotNull() & (F.size(values) == 4) & (at(2) > at(0)) & (at(3) > at(1))
    return F.when(good, F.struct(frame.alias("frame"), at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2")))


def first_number(text: Column) -> Column:
    """The first run of digits without leading zeros; null without digits."""
    found = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"^0+(?=\d)", ""))


def standalone_numbers(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` once for every different run of digits in ``column``, as ``number``."""
    return rows.withColumn("number", F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit("[0-9]+"), 0))))


def whole_number(text: Column) -> Column:
    """A string of digits only, else null."""
    return F.when(text.rlike(r"^\d+$"), F.regexp_replace(text, r"^0+(?=\d)", ""))


def confidence(text: Column) -> Column:
    return F.when(text.isin("high", "medium", "low"), text).otherwise("low")


def team_of(tag: Column) -> Column:
    """The team that a tag's first sign names."""
    return F.when(tag.startswith(BLACK), OPPONENT).when(tag.startswith(WHITE), "主队").otherwise(CASUAL)


def opponent_of(session: Column, default: str = OPPONENT) -> Column:
    """What follows the first underscore of a session id, else the default."""
    rest = F.regexp_extract(session, r"^[^_]*_(.+)$", 1)
    return F.when(rest != "", rest).otherwise(default)


def player_key(place: Column) -> Column:
    """The key of the player at a place (from 1); players beyond the keys have an empty one."""
    return F.when(place <= len(PLAYER_KEYS), F.substring(F.lit(PLAYER_KEYS), place.cast("int"), F.lit(1))).otherwise("")


def aspect(width: Column, height: Column, tolerance: float = 0.01) -> Column:
    """``16:9`` or ``4:3`` within the tolerance, else null."""
    ratio = width / height
    near = lambda x: F.abs(ratio / x - 1) <= tolerance
    return F.when(near(16 / 9), "16:9").when(near(4 / 3), "4:3")


def letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA: numbers written with 26 letters and no zero."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(13)),
        F.struct(n.cast("long").alias("left"), F.lit("").alias("text")),
        lambda s, _: F.when(s["left"] > 0, F.struct(F.floor((s["left"] - 1) / 26).alias("left"), F.concat(F.char(F.lit(65) + F.pmod(s["left"] - 1, F.lit(26))), s["text"]).alias("text"))).otherwise(s),
    )
    return steps["text"]


def with_suffix(title: Column, suffix: Column, word: str) -> Column:
    """The suffix put before ``word`` where the title ends with it, else at the end."""
    head = F.substring(title, F.lit(1), F.length(title) - len(word))
    return F.when(title.endswith(word), F.concat(head, suffix, F.lit(word))).otherwise(F.concat(title, suffix))


def rounded(x: Column, digits: int) -> Column:
    """``x`` times the power of ten to the nearest whole number, halves away from zero, and back.

    ``F.round`` rounds the shortest decimal that names ``x`` instead: 0.0585 as 0.058499999999999996 goes down there and up here.
    """
    scale = F.lit(10.0**digits)
    size = F.abs(x * scale)
    whole = F.floor(size).cast("double")
    return F.signum(x) * (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)) / scale


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of numbers, in double precision and in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector fails."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    checked = F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("double"))
    return F.transform(v, lambda x: x.cast("double") / checked)
