"""Ephemeris files of the DAF kind (SPK) as tables of records, and states of targets from them.

A file is a chain of summary records, each naming segments: a target and its centre, a frame, a span of time, and a data type. Types 2
and 3 hold Chebyshev polynomials on even intervals, types 9 and 13 samples for Lagrange and Hermite interpolation. A reader task
takes one file and sends one row for each interval of a segment, with all that an evaluation within it needs; from there on
intervals are joined to times by bucket, whatever file or segment they come from. Where several segments hold a time, the one of
the later file counts, and within a file the later one.

Files are read by Spark (`binaryFile`), of 2 GB at most each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from skyfold.functions.vec import NAN
from skyfold.operators.ephemeris import STATE, frame_path
from skyfold.operators.rangejoin import points_in_intervals

RECORD = 1024
SEGMENT = "file long, segment int, target int, center int, frame int, type int, start double, stop double, begin long, end long"
INTERVAL = "file long, segment int, target int, center int, frame int, type int, t0 double, t1 double, at array<double>, values array<double>"
#: Intervals that a reader sends at a time.
BATCH = 2000


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file (place in the order of loading) and content of files."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.format("binaryFile").load(path).select(F.lit(i).cast("long").alias("file"), "content")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "file long, content binary") if out is None else out


def summaries(content: bytes, kind_of_file: bytes = b"DAF/SPK") -> tuple[list[tuple], str]:
    """(four whole numbers, start, stop, first and last word's address) of every segment, in order, and the byte order.

    The four are target, center, frame and type in an SPK file; instrument, frame, type and whether there are rates in a CK file.
    """
    if not content.startswith((kind_of_file, b"NAIF/DAF")):
        raise ValueError(f"not an {kind_of_file[4:].decode()} file")
    order = ">" if content[88:96].startswith(b"BIG") else "<"
    nd, ni = np.frombuffer(content[8:16], order + "i4")
    at = int(np.frombuffer(content[76:80], order + "i4")[0])
    size, out, seen = int(nd) + (int(ni) + 1) // 2, [], set()
    while at:
        if at in seen or at * RECORD > len(content):
            raise ValueError("the chain of summaries is broken")
        seen.add(at)
        record = content[(at - 1) * RECORD : at * RECORD]
        nxt, _, n = np.frombuffer(record[:24], order + "f8")
        for k in range(int(n)):
            part = record[24 + 8 * size * k : 24 + 8 * size * (k + 1)]
            start, stop = np.frombuffer(part[:16], order + "f8")
            target, center, frame, kind, begin, end = np.frombuffer(part[8 * int(nd) :], order + "i4")[:6].tolist()
            out.append((target, center, frame, kind, float(start), float(stop), begin, end))
        at = int(nxt)
    return out, order


def _polynomials(words: np.ndarray, start: float, stop: float) -> Iterator[tuple[float, float, np.ndarray, np.ndarray]]:
    """Types 2 and 3: an interval a record, with its middle and half length, and all coefficients."""
    init, length, size, n = words[-4:]
    size, n = int(size), int(n)
    for i, row in enumerate(words[: size * n].reshape(n, size)):
        low, high = init + i * length, init + (i + 1) * length
        low, high = (start if i == 0 else max(low, start)), (stop if i == n - 1 else min(high, stop))
        if low <= high:
            yield low, high, row[:2], row[2:]


def _samples(words: np.ndarray, start: float, stop: float, kind: int) -> Iterator[tuple[float, float, np.ndarray, np.ndarray]]:
    """Types 9 and 13: an interval for each window of samples, with their epochs and states.

    A window of an even size has half of its samples on each side of a time; one of an odd size has the nearest sample in
    its middle; at the ends of a segment windows stay within it.
    """
    n, window = int(words[-1]), int(words[-2]) + 1
    window = min(window, n)
    states, epochs = words[: 6 * n].reshape(n, 6), words[6 * n : 7 * n]
    borders = epochs if window % 2 == 0 else np.concatenate([epochs[:1], (epochs[1:] + epochs[:-1]) / 2, epochs[-1:]])
    for i in range(len(borders) - 1):
        first = min(max(i - window // 2 + (1 if window % 2 == 0 else 0), 0), n - window)
        low, high = (start if i == 0 else max(borders[i], start)), (stop if i == len(borders) - 2 else min(borders[i + 1], stop))
        if low <= high:
            yield low, high, epochs[first : first + window], states[first : first + window].ravel()
    if len(borders) == 1:
        yield start, stop, epochs[:1], states[0]


def _rows(schema: pa.Schema, keep: tuple[int, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                found, order = summaries(content)
                words = np.frombuffer(content[: len(content) // 8 * 8], order + "f8")
                held: list[tuple] = []
                for s, (target, center, frame, kind, start, stop, begin, end) in enumerate(found):
                    if keep is None:
                        held.append((file, s, target, center, frame, kind, start, stop, begin, end))
                    elif kind in keep:
                        own = words[begin - 1 : end].astype(float)
                        parts = _polynomials(own, start, stop) if kind in (2, 3) else _samples(own, start, stop, kind)
                        for low, high, at, values in parts:
                            held.append((file, s, target, center, frame, kind, low, high, at, values))
                            if len(held) >= BATCH:
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                                held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def segments(files: DataFrame) -> DataFrame:
    """SEGMENT rows of files (file, content): what each file covers; begin and end are addresses of its words, from 1."""
    return files.select("file", "content").mapInArrow(_rows(_arrow(SEGMENT), None), SEGMENT)


def intervals(files: DataFrame) -> DataFrame:
    """INTERVAL rows of files (file, content), closed at both ends: at holds the middle and half length (types 2, 3) or the epochs (9, 13), values the coefficients or states. Segments of other types are left out (segments() shows them)."""
    return files.select("file", "content").mapInArrow(_rows(_arrow(INTERVAL), (2, 3, 9, 13)), INTERVAL)


# --- evaluation ----------------------------------------------------------------------------------------------------


def chebyshev(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives at x of polynomials c[row, coordinate, degree]: by the recurrences of T and its derivative."""
    n = c.shape[2]
    t, d = np.ones((n, len(x))), np.zeros((n, len(x)))
    if n > 1:
        t[1], d[1] = x, 1.0
    for k in range(2, n):
        t[k] = 2 * x * t[k - 1] - t[k - 2]
        d[k] = 2 * t[k - 1] + 2 * x * d[k - 1] - d[k - 2]
    return np.einsum("kr,rck->rc", t, c), np.einsum("kr,rck->rc", d, c)


def divided(x: np.ndarray, nodes: np.ndarray, f: np.ndarray, slopes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives at x[row] of the polynomials through f[row, node, coordinate], with slopes there if given, by divided differences."""
    if slopes is not None:
        nodes, f = np.repeat(nodes, 2, 1), np.repeat(f, 2, 1)
    n = nodes.shape[1]
    table, heads = f.copy(), [f[:, 0]]
    for k in range(1, n):
        gap = nodes[:, k:] - nodes[:, :-k]
        nxt = (table[:, 1:] - table[:, :-1]) / np.where(gap == 0, 1, gap)[:, :, None]
        if slopes is not None and k == 1:
            nxt[:, 0::2] = slopes
        table = nxt
        heads.append(table[:, 0])
    value, slope = heads[-1].copy(), np.zeros_like(heads[-1])
    for k in range(n - 2, -1, -1):
        h = (x - nodes[:, k])[:, None]
        slope = slope * h + value
        value = value * h + heads[k]
    return value, slope


def evaluate(kind: int, et: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """States (x..vz) at et[row] in intervals of one type and size."""
    rows = len(et)
    if kind in (2, 3):
        c = values.reshape(rows, 3 if kind == 2 else 6, -1)
        p, v = chebyshev((et - at[:, 0]) / at[:, 1], c)
        return np.concatenate([p, v / at[:, 1:2]], 1) if kind == 2 else p
    f = values.reshape(rows, -1, 6)
    if kind == 9:
        return divided(et, at, f, None)[0]
    return np.concatenate(divided(et, at, f[:, :, :3], f[:, :, 3:]), 1)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        et, kinds = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        at, values = batch.column(4), batch.column(5)
        sizes = np.stack([kinds, at.value_lengths().to_numpy(), values.value_lengths().to_numpy()], 1)
        out = np.full((len(et), 6), np.nan)
        for kind, a, v in np.unique(sizes, axis=0).tolist():
            mine = np.flatnonzero((sizes == (kind, a, v)).all(1))
            some = pa.array(mine)
            out[mine] = evaluate(kind, et[mine], at.take(some).flatten().to_numpy().reshape(-1, a), values.take(some).flatten().to_numpy().reshape(-1, v))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(out[:, k]) for k in range(6))], names=[*_ASKED, *STATE])


_ASKED = ["target", "center", "et"]


def _found(asked: DataFrame, held: DataFrame, bucket_s: float) -> DataFrame:
    """asked (target, center, et; each once) with states, where an interval holds the time: that of the latest file, segment and start."""
    own = held.select("target", "center", "file", "segment", "t0", "t1", "type", "at", "values")
    met = points_in_intervals(asked, own, "et", "t0", "t1", bucket_s, ["target", "center"], closed=True)
    best = Window.partitionBy(*_ASKED).orderBy(F.desc("file"), F.desc("segment"), F.desc("t0"))
    used = met.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*_ASKED, "type", "at", "values")
    return used.mapInArrow(_states, "target int, center int, et double, " + ", ".join(f"{c} double" for c in STATE))


def lookup(times: DataFrame, held: DataFrame, bucket_s: float = 3600.0) -> DataFrame:
    """times (target, center, et, any others) with x..vz (km, km/s) by the segments of that target about that centre, NaN where none holds the time.

    held: intervals(). Rows may repeat. bucket_s is about the length of an interval.
    """
    keyed = times.withColumns({"target": F.col("target").cast("int"), "center": F.col("center").cast("int"), "et": F.col("et").cast("double")})
    found = _found(keyed.select(*_ASKED).distinct(), held, bucket_s).withColumnsRenamed({c: f"_{c}" for c in STATE})
    out = keyed.join(found, _ASKED, "left")
    return out.select(*[c for c in times.columns if c not in STATE], *[F.coalesce(f"_{c}", F.lit(NAN)).alias(c) for c in STATE])


def relative_states(times: DataFrame, held: DataFrame, target: int, center: int, prefix: str = "", bucket_s: float = 3600.0) -> DataFrame:
    """times (et, any others) with <prefix>x..vz of one target about one centre, as lookup()."""
    asked = times.select(F.lit(target).alias("target"), F.lit(center).alias("center"), F.col("et").cast("double").alias("et")).distinct()
    names = [f"{prefix}{c}" for c in STATE]
    found = _found(asked, held.where((F.col("target") == target) & (F.col("center") == center)), bucket_s).select(F.col("et").alias("_et"), *[F.col(c).alias(f"_{n}") for c, n in zip(STATE, names, strict=True)])
    joined = times.join(found, F.col("et") == F.col("_et"), "left")
    return joined.select(*[c for c in times.columns if c not in names], *[F.coalesce(f"_{n}", F.lit(NAN)).alias(n) for n in names])


def states(times: DataFrame, held: DataFrame, target: int, observer: int, bucket_s: float = 3600.0) -> DataFrame:
    """times (et, any others) with x..vz of a target as an observer has it, over the chain of centres of held (intervals()).

    The links (target, center, frame) of the files are read to the driver: they are the bodies that files name. All links of the
    path must have one frame, else it is a ValueError, as is a pair that is not connected.
    """
    links = {(r.target, r.center): r.frame for r in held.select("target", "center", "frame").distinct().collect()}
    graph = {str(t): str(c) for t, c in links}
    path = frame_path(graph, str(target), str(observer))
    if len({links[int(a), int(graph[a])] for a, _ in path}) > 1:
        raise ValueError("the links from the target to the observer have several frames")
    rows = times
    for k, (child, _) in enumerate(path):
        rows = relative_states(rows, held, int(child), int(graph[child]), f"_s{k}_", bucket_s)
    zero = lambda c: sum((F.col(f"_s{k}_{c}") if up else -F.col(f"_s{k}_{c}") for k, (_, up) in enumerate(path)), F.lit(0.0))
    return rows.select(*times.columns, *[zero(c).alias(c) for c in STATE])


def daf(found: list[tuple], big_endian: bool = False, kind_of_file: bytes = b"DAF/SPK ") -> bytes:
    """A file of segments (four whole numbers as of summaries(), start, stop, words), as many as there are; 25 a summary record."""
    order = ">" if big_endian else "<"
    chunks = [found[k : k + 25] for k in range(0, len(found), 25)] or [[]]
    body_at = 2 + 2 * len(chunks)  # after the file record, summaries and their names come in pairs
    address, data, records = (body_at - 1) * RECORD // 8 + 1, b"", b""
    for n, chunk in enumerate(chunks):
        part = np.array([2 + 2 * (n + 1) if n + 1 < len(chunks) else 0, 2 + 2 * (n - 1) if n else 0, len(chunk)], order + "f8").tobytes()
        for target, center, frame, kind, start, stop, words in chunk:
            flat = np.asarray(words, order + "f8").ravel()
            part += np.array([start, stop], order + "f8").tobytes() + np.array([target, center, frame, kind, address, address + len(flat) - 1], order + "i4").tobytes()
            data, address = data + flat.tobytes(), address + len(flat)
        records += part.ljust(RECORD, b"\0") + b" " * RECORD
    head = kind_of_file.ljust(8) + np.array([2, 6], order + "i4").tobytes() + b" " * 60 + np.array([2, 2 * len(chunks), address], order + "i4").tobytes() + (b"BIG-IEEE" if big_endian else b"LTL-IEEE")
    return head.ljust(RECORD, b"\0") + records + data
