"""GeoTIFF rasters as tables of cells, and cells written as GeoTIFF files.

A task reads one file's directory and sends a row for each of its strips or tiles, still compressed; these are dealt to all tasks
anew, decoded, and become rows of cells with the places of their centres. Files are read by Spark's `binaryFile` (2 GB at most each).

Read: both byte orders; strips and tiles; no compression, LZW or deflate; horizontal predictor; whole numbers of 8 to 64 bits and floats; the
first band of interleaved ones. Places follow the pixel scale and tie point (north up; rotated files are an error), the code of the reference
system the projected key, then the geographic one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed by the format: bytes of a value of each type, and its numpy name where it has one.
TYPES = {1: "u1", 2: "u1", 3: "u2", 4: "u4", 5: "u4,u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 11: "f4", 12: "f8"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
GEOGRAPHIC, PROJECTED = 2048, 3072

INFO = "path string, width int, height int, kind string, x0 double, y0 double, dx double, dy double, epsg int, nodata double"
BLOCK = INFO + ", row0 int, col0 int, rows int, cols int, bands int, compression int, predictor int, payload binary"
CELL = "path string, row int, col int, x double, y double, value double"


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path and content of files; a path may be a folder or a pattern."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def tags(content: bytes) -> tuple[dict[int, np.ndarray], str]:
    """The values of the first directory by tag, and the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or int(np.frombuffer(content[2:4], order + "u2")[0]) != 42:
        raise ValueError("not a TIFF file")
    at = int(np.frombuffer(content[4:8], order + "u4")[0])
    out = {}
    for k in range(int(np.frombuffer(content[at : at + 2], order + "u2")[0])):
        entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind = np.frombuffer(entry[:4], order + "u2").tolist()
        n = int(np.frombuffer(entry[4:8], order + "u4")[0])
        if kind in TYPES:
            dtype = np.dtype([("a", order + "u4"), ("b", order + "u4")]) if kind == 5 else np.dtype(order + TYPES[kind])
            size = n * dtype.itemsize
            place = int(np.frombuffer(entry[8:12], order + "u4")[0])
            out[tag] = np.frombuffer(entry[8 : 8 + size] if size <= 4 else content[place : place + size], dtype)
    return out, order


def affine(found: dict[int, np.ndarray]) -> tuple[float, float, float, float]:
    """(x0, y0, dx, dy) of the corner of the first pixel and of a pixel; dy is negative. ValueError without scale or tie point."""
    if 33550 not in found or 33922 not in found:
        raise ValueError("a raster without pixel scale or tie point, or a rotated one")
    (sx, sy), (i, j, _, x, y) = found[33550][:2].tolist(), found[33922][:5].tolist()
    return x - i * sx, y + j * sy, sx, -sy


def epsg(found: dict[int, np.ndarray]) -> int:
    """Code of the reference system: the projected key, else the geographic one; ValueError without both."""
    keys = found.get(34735, np.zeros(0, int)).reshape(-1, 4)[1:].tolist() if len(found.get(34735, ())) >= 4 else []
    by = {k: v for k, where, _, v in keys if where == 0}
    for key in (PROJECTED, GEOGRAPHIC):
        if key in by:
            return int(by[key])
    raise ValueError("a raster without a code of its reference system")


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, a bit longer one code before it is needed; 256 clears the table, 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out, last = list(base), 9, [], b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("a broken LZW strip")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = []
    table: dict[bytes, int] = {}
    width, last = 9, b""

    def clear() -> None:
        nonlocal table, width
        codes.append((256, width))
        table, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    for i in range(len(data)):
        longer = last + data[i : i + 1]
        if longer in table:
            last = longer
            continue
        codes.append((table[last], width))
        table[longer] = len(table) + 2
        if len(table) + 2 >= 1 << width:
            width += 1
        if len(table) + 2 >= 4094:
            clear()
        last = data[i : i + 1]
    if last:
        codes.append((table[last], width))
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    codes.append((257, width))
    held = bits = 0
    out = bytearray()
    for code, size in codes:
        held, bits = (held << size) | code, bits + size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def info(path: str, content: bytes) -> tuple[tuple, dict[int, np.ndarray]]:
    """A row of INFO and the tags of a file."""
    found, order = tags(content)
    one = lambda tag, otherwise: int(found[tag][0]) if tag in found else otherwise
    kind = order + {1: "u", 2: "i", 3: "f"}[one(339, 1)] + str(one(258, 8) // 8)
    text = bytes(found[42113]).split(b"\0")[0].strip() if 42113 in found else b""
    return (path, one(256, 0), one(257, 0), kind, *affine(found), epsg(found), float(text) if text else None), found


def _blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                head, found = info(path, content)
                width, height = head[1:3]
                one = lambda tag, otherwise: int(found[tag][0]) if tag in found else otherwise  # noqa: B023, E731
                bands = one(277, 1)
                if bands > 1 and one(284, 1) != 1:
                    raise ValueError("bands in planes of their own are not read")
                tiled = 324 in found
                rows, cols = (one(323, height), one(322, width)) if tiled else (min(one(278, height), height), width)
                across = -(-width // cols)
                for n, (at, size) in enumerate(zip(found[324 if tiled else 273].tolist(), found[325 if tiled else 279].tolist(), strict=True)):
                    row0, col0 = n // across * rows, n % across * cols
                    if row0 < height:
                        own = rows if tiled else min(rows, height - row0)
                        line = (*head, row0, col0, own, cols, bands, one(259, NONE), one(317, 1), content[at : at + size])
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(line, schema, strict=True)], schema=schema)

    return run


def decode(payload: bytes, compression: int, predictor: int, kind: str, rows: int, cols: int, bands: int) -> np.ndarray:
    """Values of the first band of a strip or tile."""
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {predictor} is not read")
    flat = payload if compression == NONE else lzw_decode(payload) if compression == LZW else zlib.decompress(payload)
    values = np.frombuffer(flat[: rows * cols * bands * np.dtype(kind).itemsize], kind).reshape(rows, cols, bands)
    if predictor == 2:
        values = np.cumsum(values.astype(kind[1:]), 1, dtype=kind[1:])
    return values[:, :, 0].astype(np.float64)


def _cells(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                values = decode(b["payload"], b["compression"], b["predictor"], b["kind"], b["rows"], b["cols"], b["bands"])
                values = values[: b["height"] - b["row0"], : b["width"] - b["col0"]]
                row, col = np.meshgrid(*(np.arange(n, dtype=np.int32) for n in values.shape), indexing="ij")
                row, col = row.ravel() + np.int32(b["row0"]), col.ravel() + np.int32(b["col0"])
                made = [pa.array(row), pa.array(col), pa.array(b["x0"] + (col + 0.5) * b["dx"]), pa.array(b["y0"] + (row + 0.5) * b["dy"]), pa.array(values.ravel())]
                path = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(row), np.int32)), pa.array([b["path"]])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([path, *made], schema=schema)

    return run


def describe(files: DataFrame) -> DataFrame:
    """INFO rows of files (path, content): size, kind of values, corner and step of pixels, code of the reference system, fill value (null: none)."""
    schema = to_arrow_schema(StructType.fromDDL(INFO))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [info(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())[0] for k in range(batch.num_rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, INFO)


def cells(files: DataFrame) -> DataFrame:
    """CELL rows of files (path, content): every pixel of the first band with the place of its centre; fill values are as they are stored.

    A file that is no GeoTIFF, or of a form that is not read, is an error of the query.
    """
    blocks = files.select("path", "content").mapInArrow(_blocks(to_arrow_schema(StructType.fromDDL(BLOCK))), BLOCK)
    dealt = blocks.repartition("path", "row0", "col0")
    return dealt.mapInArrow(_cells(to_arrow_schema(StructType.fromDDL(CELL))), CELL)


def encode(values: np.ndarray, x0: float, y0: float, dx: float, dy: float, code: int = 4326, compression: int = LZW, rows_per_strip: int = 64, nodata: float | None = None, big_endian: bool = False, tile: int | None = None, predictor: int = 1) -> bytes:
    """A GeoTIFF file of a raster whose row 0 is north; x0, y0: the corner of its first pixel, dy negative."""
    order = ">" if big_endian else "<"
    height, width = values.shape
    values = values.astype(values.dtype.newbyteorder(order))
    squeeze = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress}[compression]

    def packed(part: np.ndarray) -> bytes:
        if predictor == 2:
            part = np.diff(part.astype(part.dtype.newbyteorder("=")), axis=1, prepend=np.zeros((len(part), 1), part.dtype.newbyteorder("="))).astype(values.dtype)
        return squeeze(part.tobytes())

    if tile:
        padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), values.dtype)
        padded[:height, :width] = values
        parts = [packed(padded[i : i + tile, j : j + tile]) for i in range(0, height, tile) for j in range(0, width, tile)]
    else:
        parts = [packed(values[i : i + rows_per_strip]) for i in range(0, height, rows_per_strip)]
    places = np.cumsum([8] + [len(p) for p in parts])
    sample = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    projected = not 4000 <= code < 5000
    entries: list[tuple[int, int, list]] = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [8 * values.dtype.itemsize]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [sample]),
        (33550, 12, [dx, -dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]), (34735, 3, [1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, PROJECTED if projected else GEOGRAPHIC, 0, 1, code]),
    ]
    entries += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, places[:-1].tolist()), (325, 4, [len(p) for p in parts])] if tile else [(273, 4, places[:-1].tolist()), (278, 4, [rows_per_strip]), (279, 4, [len(p) for p in parts])]
    if nodata is not None:
        entries.append((42113, 2, list(f"{nodata:g}".encode() + b"\0")))
    body = b"".join(parts)
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    more_at, ifd, more = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, v in sorted(entries):
        flat = np.array(v, order + TYPES[kind]).tobytes()
        held = flat.ljust(4, b"\0") if len(flat) <= 4 else np.array([more_at + len(more)], order + "u4").tobytes()
        more += flat + b"\0" * (len(flat) % 2) if len(flat) > 4 else b""
        ifd += np.array([tag, kind], order + "u2").tobytes() + np.array([len(v)], order + "u4").tobytes() + held
    head = (b"MM" if big_endian else b"II") + np.array([42], order + "u2").tobytes() + np.array([at], order + "u4").tobytes()
    return head + body + np.array([len(entries)], order + "u2").tobytes() + ifd + b"\0" * 4 + more


def encode_cells(rows: DataFrame, key: str = "path", code: int = 4326, fill: float = -32768.0) -> DataFrame:
    """key and content of a GeoTIFF (LZW, double) for each raster of rows (key, row, col, x, y, value; x, y of centres, evenly spaced); cells that are missing hold the fill.

    A raster is made by one task. Rasters of one row or column have steps of 1.
    """
    schema = StructType([rows.schema[key], *StructType.fromDDL("content binary").fields])

    def run(name: tuple, table: pa.Table) -> pa.Table:
        row, col, x, y, value = (table[c].to_numpy() for c in ("row", "col", "x", "y", "value"))
        grid = np.full((row.max() + 1, col.max() + 1), fill)
        grid[row, col] = value
        a, b, c, d = np.argmin(col), np.argmax(col), np.argmin(row), np.argmax(row)
        dx = float((x[b] - x[a]) / (col[b] - col[a])) if col[b] > col[a] else 1.0
        dy = float((y[d] - y[c]) / (row[d] - row[c])) if row[d] > row[c] else -1.0
        content = encode(grid, float(x[a] - (col[a] + 0.5) * dx), float(y[c] - (row[c] + 0.5) * dy), dx, dy, code, nodata=fill)
        return pa.table({key: table[key].slice(0, 1), "content": pa.array([content], pa.binary())})

    out = rows.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "value")])
    return out.groupBy(key).applyInArrow(run, schema)
