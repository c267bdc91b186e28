"""LAS point clouds: header, variable-length records and points, as a Python data source.

    spark.dataSource.register(LasSource)
    spark.read.format("las").load(path)

The path is a file, a folder with .las files, or a pattern of file names in one. A partition is a range of
records, so that one large file is read by many tasks; option `records` sets its length, `start`
and `count` read a part of each file, `box` only points in "x0,y0,z0,x1,y1,z1".
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER_BYTES = 375
RECORDS = 1_000_000

# Byte offset of red in a record, by point format.
RGB_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
# And of the GPS time, which formats 0 and 2 lack.
TIME_AT = {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}

SCHEMA = (
    "idx long, xi int, yi int, zi int, x double, y double, z double, intensity int, classification int, return_byte int, "
    "return_number int, number_of_returns int, user_data int, r int, g int, b int, gps_time double, file string"
)


class LasError(ValueError):
    pass


@dataclass
class Header:
    version: tuple[int, int]
    size: int
    points_at: int
    n_vlrs: int
    point_format: int
    record_bytes: int
    n_points: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    def density(self, units: str | None) -> float | None:
        """Points a square unit of the bounds; none for metres or without an area."""
        area = (self.high[0] - self.low[0]) * (self.high[1] - self.low[1])
        return None if units == "metre" or area <= 0 else self.n_points / area


def open_input(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def parse_header(raw: bytes) -> Header:
    if len(raw) < HEADER_BYTES:
        raise LasError("a LAS header has 375 bytes at least")
    if raw[:4] != b"LASF":
        raise LasError("not a LAS file")
    major, minor = raw[24], raw[25]
    size, points_at, n_vlrs = struct.unpack_from("<HII", raw, 94)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", raw, 179)
    legacy, = struct.unpack_from("<I", raw, 107)
    long, = struct.unpack_from("<Q", raw, 247)
    return Header(
        (major, minor), size, points_at, n_vlrs, raw[104] & 0x3F, struct.unpack_from("<H", raw, 105)[0],
        long if minor >= 4 and long else legacy, struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155), (x0, y0, z0), (x1, y1, z1),
    )


def parse_vlrs(raw: bytes, header: Header) -> list[tuple[str, int, bytes]]:
    """(user id, record id, payload) of the records between header and points; a record cut short ends the list."""
    at, out = header.size, []
    for _ in range(header.n_vlrs):
        if at + 54 > min(len(raw), header.points_at):
            break
        size, = struct.unpack_from("<H", raw, at + 20)
        if at + 54 + size > len(raw):
            break
        out.append((raw[at + 2 : at + 18].rstrip(b"\0").decode("latin-1"), struct.unpack_from("<H", raw, at + 18)[0], raw[at + 54 : at + 54 + size]))
        at += 54 + size
    return out


def projection(vlrs: list[tuple[str, int, bytes]]) -> tuple[str | None, int | None]:
    """(CRS text, EPSG unit code): well-known text is preferred to GeoTIFF keys' text."""
    by_id = {k: data for user, k, data in vlrs if user == "LASF_Projection"}
    wkt = next((by_id[k].rstrip(b"\0").decode("latin-1") for k in (2112, 2111) if by_id.get(k, b"").rstrip(b"\0")), None)
    text, unit = by_id.get(34737, b"").rstrip(b"\0").decode("latin-1"), None
    keys = by_id.get(34735, b"")
    for k in range(1, len(keys) // 8):
        key, where, count, value = struct.unpack_from("<4H", keys, 8 * k)
        if key in (3076, 4099) and not where:
            unit = value
        if key in (1026, 2049, 3073) and where == 34737 and wkt is None:
            text = text[value : value + count]
    return wkt or text.strip("| ") or None, unit


def dtype(header: Header) -> np.dtype:
    """The fields of a record that are read, at their offsets."""
    at = {"xi": ("<i4", 0), "yi": ("<i4", 4), "zi": ("<i4", 8), "intensity": ("<u2", 12), "return_byte": ("u1", 14)}
    at |= {"classification": ("u1", 16 if header.point_format >= 6 else 15), "user_data": ("u1", 17 if header.point_format >= 6 else 16)}
    if (rgb := RGB_AT.get(header.point_format)) is not None:
        at |= {c: ("<u2", rgb + 2 * k) for k, c in enumerate("rgb")}
    if (time := TIME_AT.get(header.point_format)) is not None:
        at["gps_time"] = ("<f8", time)
    return np.dtype({"names": list(at), "formats": [f for f, _ in at.values()], "offsets": [o for _, o in at.values()], "itemsize": header.record_bytes})


def decode(raw: bytes, header: Header, first: int, file: str = "") -> pa.RecordBatch:
    """Points of whole records; a record cut short at the end is left out."""
    rec = np.frombuffer(raw[: len(raw) // header.record_bytes * header.record_bytes], dtype(header))
    new = header.point_format >= 6
    rb = rec["return_byte"].astype(np.int32)
    cols = {"idx": np.arange(first, first + len(rec)), **{f"{d}i": rec[f"{d}i"] for d in "xyz"}}
    cols |= {d: rec[f"{d}i"] * header.scale[k] + header.offset[k] for k, d in enumerate("xyz")}
    cols |= {"intensity": rec["intensity"], "classification": rec["classification"] if new else rec["classification"] & 0x1F, "return_byte": rb}
    cols |= {"return_number": rb & (15 if new else 7), "number_of_returns": (rb >> (4 if new else 3)) & (15 if new else 7), "user_data": rec["user_data"]}
    rgb = header.point_format in RGB_AT
    cols |= {c: rec[c] if rgb else np.full(len(rec), 255) for c in "rgb"}
    kinds = {"idx": pa.int64(), "x": pa.float64(), "y": pa.float64(), "z": pa.float64()}
    arrays = {k: pa.array(v).cast(kinds.get(k, pa.int32())) for k, v in cols.items()}
    arrays["gps_time"] = pa.array(rec["gps_time"]) if header.point_format in TIME_AT else pa.nulls(len(rec), pa.float64())
    arrays["file"] = pa.repeat(pa.scalar(file), len(rec))
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def list_files(path: str) -> list[str]:
    """The file, the .las files of a folder, or the files of a folder whose names fit a pattern, in order."""
    folder, _, name = path.rpartition("/")
    pattern = any(c in name for c in "*?[")
    fs, at = open_input((folder or ".") if pattern else path)
    if pattern:
        found, keep, whole = pafs.FileSelector(at), lambda f: fnmatch.fnmatchcase(f.base_name, name), folder
    elif fs.get_file_info(at).type == pafs.FileType.Directory:
        found, keep, whole = pafs.FileSelector(at, recursive=True), lambda f: f.base_name.lower().endswith(".las"), path
    else:
        return [path]
    head = whole.rstrip("/").removesuffix(at.rstrip("/"))  # the scheme, and whatever else stands before the path
    return sorted(head + f.path for f in fs.get_file_info(found) if f.is_file and keep(f))


def read_header(path: str) -> Header:
    fs, at = open_input(path)
    with fs.open_input_file(at) as f:
        return parse_header(f.read(HEADER_BYTES))


@dataclass
class Records(InputPartition):
    path: str
    start: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("records", RECORDS))
        self.start, self.count = int(options.get("start", 0)), options.get("count")
        self.box = [float(x) for x in options["box"].split(",")] if "box" in options else None

    def partitions(self) -> list[Records]:
        out = []
        for path in list_files(self.path):
            head = read_header(path)
            if self.box and any(head.high[k] < self.box[k] or head.low[k] > self.box[k + 3] for k in range(3)):
                continue  # nothing of the file lies in the box
            end = head.n_points if self.count is None else min(head.n_points, self.start + int(self.count))
            out += [Records(path, at, min(self.size, end - at)) for at in range(self.start, end, self.size)]
        return out or [Records("", 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        header = read_header(part.path)
        fs, at = open_input(part.path)
        step = 1 << 16
        with fs.open_input_file(at) as f:
            f.seek(header.points_at + part.start * header.record_bytes)
            for k in range(0, part.count, step):
                batch = decode(f.read(min(step, part.count - k) * header.record_bytes), header, part.start + k, part.path)
                if self.box:
                    inside = np.ones(batch.num_rows, bool)
                    for d, low, high in zip("xyz", self.box, self.box[3:]):
                        inside &= (batch.column(d).to_numpy() >= low) & (batch.column(d).to_numpy() <= high)
                    batch = batch.filter(pa.array(inside))
                yield batch


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)
