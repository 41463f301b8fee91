"""Names and ids of bodies, frames, spacecraft and instruments; pictures of times; classes of lookup errors.

Ids are columns, names come from dimension tables: bodies (name, id, frame) and frames (name, id, class, class_id, alias_of).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import lit


def spacecraft_id(number: Column, origin: str = "naif") -> Column:
    """Id of a spacecraft from its number in a catalogue: naif as it is, dsn negated, norad below -100000."""
    if origin not in ("naif", "dsn", "norad"):
        raise ValueError(f"unknown origin {origin!r}")
    return {"naif": number, "dsn": -number, "norad": -100000 - number}[origin].cast("long")


def infer_ids(spacecraft: DataFrame, number: str, instruments: list[str] | None = None, origin: str = "naif") -> DataFrame:
    """All columns with spacecraft_id, clock_id, ephemeris_id, attitude_id and instrument_ids (name: id, in the order given, from 1)."""
    own = F.col("spacecraft_id")
    out = spacecraft.withColumn("spacecraft_id", spacecraft_id(F.col(number), origin))
    names = instruments or []
    ids = F.map_from_arrays(F.lit(names).cast("array<string>"), F.array(*[own * 1000 - i for i in range(1, len(names) + 1)]).cast("array<bigint>")) if names else F.create_map().cast("map<string,bigint>")
    return out.withColumns({"clock_id": own, "ephemeris_id": own, "attitude_id": own * 1000, "instrument_ids": ids})


def spacecraft_of(instrument_id: Column) -> Column:
    """Id of the spacecraft that an instrument's id belongs to: the id over 1000, towards plus infinity."""
    return F.ceil(instrument_id / 1000).cast("long")


def instruments_of(spacecraft: DataFrame, bodies: DataFrame) -> DataFrame:
    """spacecraft_id with name and id of each body whose id is one of its instruments' (-1 to -999 below its own thousandfold).

    An equi-join on the spacecraft that an id would belong to.
    """
    own = bodies.where("id < -1000 and id % 1000 <> 0").select("name", "id", spacecraft_of(F.col("id")).alias("spacecraft_id"))
    return spacecraft.select("spacecraft_id").join(own, "spacecraft_id")


def body_or_frame(names: DataFrame, bodies: DataFrame, frames: DataFrame, name: str = "name") -> DataFrame:
    """names with kind (body, frame, or null where neither knows it) and id; a body goes before a frame of the same name, case has no influence."""
    known = bodies.select(F.upper("name").alias("_key"), F.lit(0).alias("_first"), F.lit("body").alias("kind"), "id").unionByName(frames.select(F.upper("name").alias("_key"), F.lit(1).alias("_first"), F.lit("frame").alias("kind"), "id"))
    known = known.groupBy("_key").agg(F.min(F.struct("_first", "kind", "id")).alias("_k"))
    return names.join(known, F.upper(name) == F.col("_key"), "left").select(*names.columns, "_k.kind", "_k.id")


def object_frames(names: DataFrame, bodies: DataFrame, frames: DataFrame, name: str = "name") -> DataFrame:
    """names with frame and frame_id of the frame that is fixed to each body; null where there is none."""
    b = bodies.select(F.upper("name").alias("_key"), F.col("frame"))
    f = frames.select(F.col("name").alias("frame"), F.col("id").alias("frame_id"))
    return names.join(b, F.upper(name) == F.col("_key"), "left").join(f, "frame", "left").select(*names.columns, "frame", "frame_id")


def frame_class_ids(frames: DataFrame, most_hops: int = 16) -> DataFrame:
    """frame id with root_id, root_class and class_id at the end of its chain of aliases (class 4); circular chains are an error of the query.

    A chain is followed by doubling: each round joins every link with the link at its end, so `most_hops` rounds follow
    2**most_hops aliases; it ends when no link is an alias any more.
    """
    step = frames.select(F.col("id").alias("frame_id"), F.when(F.col("class") == 4, F.col("alias_of")).otherwise(F.col("id")).alias("at"))
    moves = frames.where("class = 4").limit(1).count()
    for _ in range(most_hops if moves else 0):
        nxt = step.select(F.col("frame_id").alias("at"), F.col("at").alias("to"))
        step = step.join(nxt, "at", "left").select("frame_id", F.coalesce("to", "at").alias("at"))
        ends = frames.select(F.col("id").alias("at"), F.col("class").alias("_c"))
        if not step.join(ends, "at").where("_c = 4 and at <> frame_id").limit(1).count():
            break
    end = frames.select(F.col("id").alias("at"), F.col("class").alias("root_class"), "class_id")
    circular = F.when(F.col("root_class") == 4, F.raise_error(F.lit("a circular chain of frame aliases")).cast("int"))
    return step.join(end, "at", "left").select("frame_id", F.col("at").alias("root_id"), F.coalesce(circular, "root_class").alias("root_class"), "class_id")


def target_ids(targets: DataFrame, bodies: DataFrame, frames: DataFrame, name: str = "name") -> DataFrame:
    """targets with spk_id (the body's), ck_id (the body's frame, or the frame) and pck_id (class id, where the chain ends in class 2); null where there is none."""
    spk = bodies.select(F.upper("name").alias("_b"), F.col("id").alias("spk_id"), F.upper("frame").alias("_bf"))
    roots = frame_class_ids(frames)
    fr = frames.select(F.upper("name").alias("_f"), F.col("id").alias("ck_id")).join(roots, F.col("ck_id") == F.col("frame_id"), "left")
    fr = fr.select("_f", "ck_id", F.when(F.col("root_class") == 2, F.col("class_id")).alias("pck_id"))
    return targets.join(spk, F.upper(name) == F.col("_b"), "left").join(fr, F.col("_f") == F.coalesce("_bf", F.upper(name)), "left").select(*targets.columns, "spk_id", "ck_id", "pck_id")


# Codes of a time format and the parts of a time picture they stand for.
PICTURE = {"%Y": "YYYY", "%y": "YR", "%m": "MM", "%b": "Mon", "%B": "Month", "%d": "DD", "%j": "DOY", "%H": "HR", "%I": "AP", "%M": "MN", "%S": "SC", "%p": "AMPM", "%a": "Wkd", "%A": "Weekday"}


def time_picture(fmt: str) -> str:
    """Picture of a strftime format, rounded and in UTC; a fraction (%f) only right after "%S."."""

    def part(m: re.Match) -> str:
        code = m.group()
        if code == "%%":
            return "%"
        if code == "%S.%f":
            return "SC.######"
        if code == "%f":
            raise ValueError("%f must follow %S.")
        if code not in PICTURE:
            raise ValueError(f"a picture has no part for {code!r}")
        return PICTURE[code]

    return re.sub(r"%S\.%f|%%|%\w", part, fmt) + "::RND ::UTC"


# Short messages of the toolkit and the class of each.
ERROR_CLASSES = {
    "NOFRAMECONNECT": "coverage", "SPKINSUFFDATA": "coverage", "CKINSUFFDATA": "coverage", "NOLOADEDFILES": "missing_kernel", "KERNELVARNOTFOUND": "missing_kernel",
    "NOSUCHFILE": "missing_kernel", "NOFRAMEDATA": "missing_kernel", "FRAMEDATANOTFOUND": "missing_kernel", "UNPARSEDTIME": "bad_time", "INVALIDTIMESTRING": "bad_time",
}
_MEANING = {"coverage": "the time or frame asked for lies outside what is loaded", "missing_kernel": "a table or frame that is needed is not loaded", "bad_time": "the time can't be read", "other": "the lookup failed"}


def error_class(short: Column) -> Column:
    """coverage, missing_kernel, bad_time or other, from a short message with or without its SPICE( ) around it."""
    token = F.regexp_replace(F.trim(F.coalesce(short, F.lit(""))), r"^SPICE\((.*)\)$", "$1")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ERROR_CLASSES.items() for x in kv]), token), F.lit("other"))


def error_message(short: Column, routine: Column | None = None) -> Column:
    """One line: what it means, the short message, and where it arose."""
    meaning = F.element_at(F.create_map(*[F.lit(x) for kv in _MEANING.items() for x in kv]), error_class(short))
    where = F.when(F.trim(F.coalesce(lit(routine), F.lit(""))) != "", F.concat(F.lit(" in "), F.trim(lit(routine)))).otherwise("") if routine is not None else F.lit("")
    return F.concat(meaning, F.lit(" ["), F.coalesce(F.when(short != "", short), F.lit("SPICE(UNKNOWN)")), where, F.lit("]"))
