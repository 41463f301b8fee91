"""Text kernels as tables: the pool of variables that their data blocks assign, and views on it.

A text kernel is prose with data blocks between lines that hold only `\\begindata` and `\\begintext`. A block assigns to
variables, `NAME = value`, or adds to them, `NAME += ( value, value ... )`; values are numbers (exponents with D or E), strings
in single quotes (two for one inside), or dates after `@`. Commas, spaces and line ends part values. Kernels are read in an
order; a later `=` replaces what a variable had.

All is done by DataFrame functions: a kernel is cut into lines, lines into tokens, and windows over one kernel's tokens (a few
megabytes at most) tell names from values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfold.functions import vec as V

TOKEN = r"('(?:[^']|'')*'|\+=|=|\(|\)|[^\s,()'=]+?(?=\+=|[\s,()'=]|$))"
MARKER = r"^\s*\\begin(data|text)\s*$"
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
DATE = r"^@(\d{4})-([A-Z]{3}|\d{1,2})-(\d{1,2})(?:[-/T](\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?$"


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """kernel (place in the order of loading) and text of files; a path may be one that only Spark reads."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.lit(i).cast("long").alias("kernel"), F.col("value").alias("text"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "kernel long, text string")
    return out


def date_seconds(token: Column) -> Column:
    """Seconds from 2000-01-01 12:00 of a date token, days of 86,400 seconds each; null where it is none."""
    t = F.upper(token)
    part = lambda i: F.regexp_extract(t, DATE, i)
    number = lambda c: F.coalesce(F.when(c != "", c).try_cast("double"), F.lit(0.0))
    month = F.coalesce(part(2).try_cast("int"), F.array_position(F.array(*map(F.lit, MONTHS)), part(2)).cast("int"))
    day = F.datediff(F.try_to_date(F.concat_ws("-", part(1), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(3), 2, "0"))), F.lit("2000-01-01").cast("date"))
    return F.when(t.rlike(DATE), day * 86400.0 - 43200.0 + number(part(4)) * 3600 + number(part(5)) * 60 + number(part(6)))


def assignments(texts: DataFrame) -> DataFrame:
    """Every value that texts (kernel, text) assign: kernel, at (of the assignment in its kernel), variable, adds, item (from 0), token."""
    lines = texts.select("kernel", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line", "_t"))
    own = Window.partitionBy("kernel").orderBy("line")
    said = F.when(F.col("_t").rlike(MARKER), F.regexp_extract("_t", MARKER, 1))
    data = lines.withColumn("_mode", F.last(said, ignorenulls=True).over(own)).where((F.col("_mode") == "data") & ~F.col("_t").rlike(MARKER))
    tokens = data.select("kernel", "line", F.posexplode(F.regexp_extract_all("_t", F.lit(TOKEN), 1)).alias("place", "token"))
    order = Window.partitionBy("kernel").orderBy("line", "place")
    op = F.lead("token").over(order)
    named = tokens.withColumn("_op", F.when(op.isin("=", "+=") & ~F.col("token").rlike("^[='(]"), op))
    numbered = named.withColumn("at", F.count("_op").over(order)).where("at > 0")
    each = Window.partitionBy("kernel", "at")
    held = numbered.withColumns({"variable": F.max(F.when(F.col("_op").isNotNull(), F.col("token"))).over(each), "adds": F.max(F.col("_op") == "+=").over(each)})
    values = held.where(F.col("_op").isNull() & ~F.col("token").isin("=", "+=", "(", ")"))
    return values.withColumn("item", F.row_number().over(each.orderBy("line", "place")) - 1).select("kernel", "at", "variable", "adds", "item", "token")


def pool(texts: DataFrame) -> DataFrame:
    """variable, index (from 0), number, text: what is in the pool when all kernels are loaded, in order of kernel.

    A date is a number (date_seconds()). A token that is no value has neither number nor text: see invalid(). A null text
    is empty; kernels of one number, or equal ones, are loaded in no certain order.
    """
    rows = assignments(texts)
    by = Window.partitionBy("variable")
    start = F.max(F.when(~F.col("adds"), F.struct("kernel", "at"))).over(by)
    live = rows.withColumn("_start", start).where(F.col("_start").isNull() | (F.struct("kernel", "at") >= F.col("_start")))
    quoted = F.col("token").startswith("'")
    text = F.when(quoted, F.replace(F.expr("substring(token, 2, length(token) - 2)"), F.lit("''"), F.lit("'")))
    plain = F.regexp_replace("token", "[dD]", "E")
    number = F.when(quoted, None).when(F.col("token").startswith("@"), date_seconds(F.col("token"))).when(F.col("token").rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eEdD][-+]?\d+)?$"), plain.try_cast("double"))
    index = F.row_number().over(by.orderBy("kernel", "at", "item")) - 1
    return live.select("variable", index.cast("int").alias("index"), number.alias("number"), text.alias("text"))


def invalid(held: DataFrame) -> DataFrame:
    """Values of a pool that are neither numbers, strings nor dates."""
    return held.where("number is null and text is null").select("variable", "index")


# --- views ---------------------------------------------------------------------------------------------------------


def items(held: DataFrame, prefix: str, name: str = "id") -> DataFrame:
    """Variables `<prefix><id>_<item>`: id, item, index, number, text."""
    shape = rf"^{prefix}(-?\d+)_(\w+)$"
    return held.where(F.col("variable").rlike(shape)).select(F.regexp_extract("variable", shape, 1).cast("long").alias(name), F.regexp_extract("variable", shape, 2).alias("item"), "index", "number", "text")


def _value(item: str, index: int = 0, kind: str = "number") -> Column:
    return F.max(F.when((F.col("item") == item) & (F.col("index") == index), F.col(kind)))


def _numbers(item: str) -> Column:
    """An item's numbers in order (as many as one variable of one object has)."""
    return F.transform(F.sort_array(F.collect_list(F.when(F.col("item") == item, F.struct("index", "number")))), lambda s: s["number"])


def detector_vectors(held: DataFrame) -> DataFrame:
    """instrument, pixel (from 1), x, y, z: the instrument's PIXEL_VECTORS, three numbers for each of PIXEL_COUNT, else its BORESIGHT.

    Fewer numbers than PIXEL_COUNT asks for are an error of the query.
    """
    ins = items(held, "INS", "instrument")
    counts = ins.groupBy("instrument").agg(_value("PIXEL_COUNT").cast("long").alias("count"), F.count(F.when(F.col("item") == "PIXEL_VECTORS", 1)).alias("n"), F.count(F.when(F.col("item") == "BORESIGHT", 1)).alias("b"))
    short = F.raise_error(F.concat(F.lit("too few pixel vectors of instrument "), F.col("instrument").cast("string"))).cast("long")
    counts = counts.withColumn("count", F.when((F.col("n") > 0) & (F.col("n") < 3 * F.col("count")), short).when(F.col("n") > 0, F.col("count")))
    used = ins.join(counts.select("instrument", "count"), "instrument").where(((F.col("item") == "PIXEL_VECTORS") & (F.col("index") < 3 * F.col("count"))) | ((F.col("item") == "BORESIGHT") & F.col("count").isNull() & (F.col("index") < 3)))
    axis = lambda k: F.max(F.when(F.col("index") % 3 == k, F.col("number")))
    return used.groupBy("instrument", (F.floor(F.col("index") / 3) + 1).cast("int").alias("pixel")).agg(*[axis(k).alias(a) for k, a in enumerate("xyz")])


def _unit(v: V.Vec) -> V.Vec:
    n = v.norm()
    return V.Vec(*(V.safe_div(c, n) for c in v))


def fields_of_view(held: DataFrame) -> DataFrame:
    """instrument, shape, frame, bx, by, bz (as given), ref_angle, cross_angle (radians, null for corners), corners.

    corners: array of (x, y, z). Of a field given by corners they are those; of one given by angles: for a circle
    the boresight turned towards the reference vector by the angle, for an ellipse the ends of both half axes, for a rectangle
    the four unit vectors whose tangents along both axes are those of the angles.
    """
    ins = items(held, "INS", "instrument")
    got = ins.groupBy("instrument").agg(
        _value("FOV_SHAPE", 0, "text").alias("shape"), _value("FOV_FRAME", 0, "text").alias("frame"), *[_value("BORESIGHT", k).alias(f"b{a}") for k, a in enumerate("xyz")],
        F.coalesce(_value("FOV_CLASS_SPEC", 0, "text"), F.lit("CORNERS")).alias("spec"), *[_value("FOV_REF_VECTOR", k).alias(f"r{a}") for k, a in enumerate("xyz")],
        _value("FOV_REF_ANGLE").alias("ref"), _value("FOV_CROSS_ANGLE").alias("cross"), F.coalesce(_value("FOV_ANGLE_UNITS", 0, "text"), F.lit("RADIANS")).alias("units"),
        _numbers("FOV_BOUNDARY_CORNERS").alias("_c"), _numbers("FOV_BOUNDARY").alias("_d"),
    ).where("shape is not null")
    scale = F.when(F.upper("units") == "DEGREES", 3.141592653589793 / 180).when(F.upper("units") == "ARCMINUTES", 3.141592653589793 / 10800).when(F.upper("units") == "ARCSECONDS", 3.141592653589793 / 648000).otherwise(1.0)
    angles = F.upper("spec") == "ANGLES"
    got = got.withColumns({"shape": F.upper("shape"), "ref_angle": F.when(angles, F.col("ref") * scale), "cross_angle": F.when(angles, F.col("cross") * scale)})
    b = _unit(V.Vec(F.col("bx"), F.col("by"), F.col("bz")))
    got = got.withColumns(dict(zip(("ux", "uy", "uz"), b, strict=True)))
    u, r = V.Vec.columns("u"), V.Vec.columns("r")
    along = u.dot(r)
    got = got.withColumns(dict(zip(("sx", "sy", "sz"), _unit(V.Vec(*(x - along * y for x, y in zip(r, u, strict=True)))), strict=True)))
    s = V.Vec.columns("s")
    t = u.cross(s)
    mixed = lambda a, b_, c: F.struct(*[(a * x + b_ * y + c * z).alias(n) for n, x, y, z in zip("xyz", u, s, t, strict=True)])
    ra, ca, zero = F.col("ref_angle"), F.col("cross_angle"), F.lit(0.0)
    length = F.sqrt(1 + F.tan(ra) * F.tan(ra) + F.tan(ca) * F.tan(ca))
    four = F.array(*[mixed(1 / length, i * F.tan(ra) / length, j * F.tan(ca) / length) for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1))])
    ends = F.array(mixed(F.cos(ra), F.sin(ra), zero), mixed(F.cos(ca), zero, F.sin(ca)))
    one = F.array(mixed(F.cos(ra), F.sin(ra), zero))
    given = F.when(F.size("_c") > 0, F.col("_c")).otherwise(F.col("_d"))
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size(given) / 3).cast("int") - 1), lambda k: F.struct(F.get(given, 3 * k).alias("x"), F.get(given, 3 * k + 1).alias("y"), F.get(given, 3 * k + 2).alias("z")))
    corners = F.when(angles & (F.col("shape") == "CIRCLE"), one).when(angles & (F.col("shape") == "ELLIPSE"), ends).when(angles & (F.col("shape") == "RECTANGLE"), four).when(~angles & (F.size(given) >= 3), triples)
    return got.select("instrument", "shape", "frame", "bx", "by", "bz", "ref_angle", "cross_angle", corners.alias("corners"))


def clocks(held: DataFrame) -> DataFrame:
    """One row a spacecraft clock (type 1): clock, moduli, offsets, partition_start, partition_end, ticks_per_count, pieces (tick, time, rate), in order of tick.

    rate: seconds of the parallel time for a count of the leading field, as in SCLK01_COEFFICIENTS.
    """
    shape = r"^(SCLK01_COEFFICIENTS|SCLK01_MODULI|SCLK01_OFFSETS|SCLK_PARTITION_START|SCLK_PARTITION_END|SCLK01_TIME_SYSTEM)_(\d+)$"
    rows = held.where(F.col("variable").rlike(shape)).select((-F.regexp_extract("variable", shape, 2).cast("long")).alias("clock"), F.regexp_extract("variable", shape, 1).alias("item"), "index", "number")
    got = rows.groupBy("clock").agg(_numbers("SCLK01_COEFFICIENTS").alias("_c"), _numbers("SCLK01_MODULI").alias("moduli"), _numbers("SCLK01_OFFSETS").alias("offsets"), _numbers("SCLK_PARTITION_START").alias("partition_start"), _numbers("SCLK_PARTITION_END").alias("partition_end"), F.coalesce(_value("SCLK01_TIME_SYSTEM"), F.lit(1.0)).cast("int").alias("time_system"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.size("_c") / 3).cast("int") - 1), lambda k: F.struct(F.get("_c", 3 * k).alias("tick"), F.get("_c", 3 * k + 1).alias("time"), F.get("_c", 3 * k + 2).alias("rate")))
    per = F.aggregate(F.slice("moduli", 2, F.greatest(F.size("moduli"), F.lit(1))), F.lit(1.0), lambda s, m: s * m)
    return got.where("size(_c) >= 3").withColumns({"pieces": F.array_sort(pieces), "ticks_per_count": per}).drop("_c")


def ticks_to_time(ticks: Column, clock_pieces: Column, per_count: Column) -> Column:
    """Seconds of the clock's parallel time at encoded ticks, by the last piece that starts at or before; null before the first."""
    own = F.element_at(F.filter(clock_pieces, lambda p: p["tick"] <= ticks), -1)
    return F.when(F.exists(clock_pieces, lambda p: p["tick"] <= ticks), own["time"] + (ticks - own["tick"]) / per_count * own["rate"])


def time_to_ticks(time: Column, clock_pieces: Column, per_count: Column) -> Column:
    """The inverse, by the last piece whose time is reached."""
    own = F.element_at(F.filter(clock_pieces, lambda p: p["time"] <= time), -1)
    return F.when(F.exists(clock_pieces, lambda p: p["time"] <= time), own["tick"] + (time - own["time"]) / own["rate"] * per_count)


def encode_ticks(text: Column, clock: Column) -> Column:
    """Ticks of a clock string `[partition/]field<.,:- or space>field...`, from the first tick of all; null for a partition that the clock lacks.

    clock: a struct of moduli, offsets, partition_start and partition_end. Without a partition, the first one that holds the fields counts.
    """
    head = F.when(text.contains("/"), F.trim(F.substring_index(text, "/", 1)).try_cast("int"))
    fields = F.split(F.trim(F.when(text.contains("/"), F.substring_index(text, "/", -1)).otherwise(text)), r"[.,:\- ]+")
    worth = F.transform(clock["moduli"], lambda m, i: F.aggregate(F.slice(clock["moduli"], i + 2, F.size(clock["moduli"])), F.lit(1.0), lambda s, x: s * x))
    value = F.aggregate(F.transform(fields, lambda f, i: (f.try_cast("double") - F.coalesce(F.get(clock["offsets"], i), F.lit(0.0))) * F.get(worth, i)), F.lit(0.0), lambda s, x: s + x)
    spans = F.arrays_zip(clock["partition_start"].alias("partition_start"), clock["partition_end"].alias("partition_end"))
    holding = F.array_position(F.transform(spans, lambda p: (p["partition_start"] <= value) & (value <= p["partition_end"])), True).cast("int")
    part = F.coalesce(head, holding)
    before = F.aggregate(F.slice(spans, 1, F.greatest(part - 1, F.lit(0))), F.lit(0.0), lambda s, p: s + p["partition_end"] - p["partition_start"])
    return F.when((part >= 1) & (part <= F.size(spans)), before + value - F.get(clock["partition_start"], part - 1))


def frames(held: DataFrame) -> DataFrame:
    """frame_id, name, class, class_id, center, relative, spec, r0..r8: frames and, for constant ones (class 4), the row-major matrix from the frame to the one that it is relative to.

    A TKFRAME matrix is given by columns; angles are turns about axes, the first outermost; a quaternion is scalar first.
    """
    rows = items(held, "(?:FRAME_|TKFRAME_)", "frame_id")
    got = rows.groupBy("frame_id").agg(
        _value("NAME", 0, "text").alias("name"), *[_value(i).cast("long").alias(i.lower()) for i in ("CLASS", "CLASS_ID", "CENTER")], _value("RELATIVE", 0, "text").alias("relative"), F.upper(_value("SPEC", 0, "text")).alias("spec"),
        *[_value("MATRIX", k).alias(f"m{k}") for k in range(9)], *[_value("ANGLES", k).alias(f"a{k}") for k in range(3)], *[_value("AXES", k).cast("int").alias(f"x{k}") for k in range(3)], *[_value("Q", k).alias(f"q{k}") for k in range(4)],
        F.upper(F.coalesce(_value("UNITS", 0, "text"), F.lit("RADIANS"))).alias("units"),
    )
    scale = F.when(F.col("units") == "DEGREES", 3.141592653589793 / 180).when(F.col("units") == "ARCMINUTES", 3.141592653589793 / 10800).when(F.col("units") == "ARCSECONDS", 3.141592653589793 / 648000).otherwise(1.0)

    def turn(k: int) -> V.Matrix:
        three = [V.about(axis, F.col(f"a{k}") * scale) for axis in (1, 2, 3)]
        pick = lambda i, j: F.when(F.col(f"x{k}") == 1, three[0][i][j]).when(F.col(f"x{k}") == 2, three[1][i][j]).otherwise(three[2][i][j])
        return tuple(V.Vec(*(pick(i, j) for j in range(3))) for i in range(3))

    # The three turns are made into columns before they are multiplied, so that no expression holds them many times over.
    for k in range(3):
        got = got.withColumns({f"t{k}{i}{j}": turn(k)[i][j] for i in range(3) for j in range(3)})
    t = [tuple(V.Vec(*(F.col(f"t{k}{i}{j}") for j in range(3))) for i in range(3)) for k in range(3)]
    got = got.withColumns({f"p{i}{j}": c for i, row in enumerate(V.product(t[0], t[1])) for j, c in enumerate(row)})
    angled = V.product(tuple(V.Vec(*(F.col(f"p{i}{j}") for j in range(3))) for i in range(3)), t[2])
    turned = V.rotation([F.col(f"q{k}") for k in range(4)])
    value = lambda i, j: F.when(F.col("spec") == "MATRIX", F.col(f"m{3 * j + i}")).when(F.col("spec") == "ANGLES", angled[i][j]).when(F.col("spec") == "QUATERNION", turned[i][j])
    return got.where("name is not null").select("frame_id", "name", "class", "class_id", "center", "relative", "spec", *[value(i, j).alias(f"r{3 * i + j}") for i in range(3) for j in range(3)])


def names(held: DataFrame) -> DataFrame:
    """name, id of bodies that kernels name (NAIF_BODY_NAME and NAIF_BODY_CODE at the same place); of equal names the last counts."""
    each = held.where(F.col("variable").isin("NAIF_BODY_NAME", "NAIF_BODY_CODE")).groupBy("index").agg(F.max("text").alias("name"), F.max("number").cast("long").alias("id"))
    return each.where("name is not null and id is not null").groupBy(F.upper(F.regexp_replace(F.trim("name"), " +", " ")).alias("name")).agg(F.max_by("id", "index").alias("id"))
