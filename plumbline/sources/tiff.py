"""TIFF rasters as a data source: a row a pixel, of the strips or tiles that a query asks for.

The window of a read is an option, so that only the strips and tiles that it meets are listed, and others are neither read nor
decoded. It is no pushed filter: Spark 4.1.2 keeps the filters last pushed to a Python source for every other use of the same frame, which
then lacks rows (of 640 pixels an unfiltered count gave 200 after a filtered one). Classic and BigTIFF files of both byte orders, uncompressed, deflate and
PackBits, chunky or planar, with or without horizontal differences; the first image of a file counts. Paths may be files,
folders or patterns.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from plumbline.sources.las import open_input

#: Decoded bytes that one task is dealt, at least one strip or tile.
TASK_BYTES = 32 << 20
#: Pixels of one Arrow batch.
BATCH = 1 << 18
SCHEMA = "file string, width int, height int, bands int, whole boolean, px int, py int, v array<double>"

# Fixed values of the format: tags, and struct codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = (
    256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339,
)
PIXEL_SCALE, TIEPOINT, GEO_TEXT = 33550, 33922, 34737
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


class TiffError(ValueError):
    pass


@dataclass
class Image:
    """What the first directory of a file tells."""

    order: str
    width: int
    height: int
    bands: int
    dtype: np.dtype
    compression: int
    planar: int
    predictor: int
    chunk: tuple[int, int]
    tiled: bool
    offsets: list[int]
    sizes: list[int]
    scale: list[float] = field(default_factory=list)
    tiepoint: list[float] = field(default_factory=list)
    text: str | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.chunk[0])

    def place(self, k: int) -> tuple[int, int, int]:
        """(plane, first column, first row) of a strip or tile."""
        plane, k = divmod(k, self.across * -(-self.height // self.chunk[1]))
        return plane, k % self.across * self.chunk[0], k // self.across * self.chunk[1]

    def transform(self) -> dict[str, float] | None:
        """Pixel size and the ground place of the raster's corner, if the file has them."""
        if len(self.scale) < 2 or len(self.tiepoint) < 6:
            return None
        i, j, _, x, y = self.tiepoint[:5]
        return {"x": x - i * self.scale[0], "y": y + j * self.scale[1], "dx": self.scale[0], "dy": -self.scale[1]}


def read_image(f) -> Image:
    head = f.read(16)
    if head[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF file")
    order = "<" if head[:2] == b"II" else ">"
    magic = struct.unpack_from(order + "H", head, 2)[0]
    if magic not in (42, 43):
        raise TiffError("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    count_code, entry = ("Q", 20) if big else ("H", 12)
    f.seek(at)
    n = struct.unpack(order + count_code, f.read(struct.calcsize(count_code)))[0]
    raw, tags = f.read(n * entry), {}
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", raw, k * entry)
        count = struct.unpack_from(order + ("Q" if big else "I"), raw, k * entry + 4)[0]
        if kind not in _TYPES:
            continue
        code = f"{count}s" if kind == 2 else f"{count}{_TYPES[kind]}"
        size, where = struct.calcsize(order + code), k * entry + (12 if big else 8)
        if size > (8 if big else 4):
            f.seek(struct.unpack_from(order + ("Q" if big else "I"), raw, where)[0])
            data = f.read(size)
        else:
            data = raw[where : where + size]
        if len(data) == size:
            tags[tag] = list(struct.unpack(order + code, data))
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, height, bits = one(WIDTH), one(HEIGHT), tags.get(BITS, [1])
    if not width or not height:
        raise TiffError("no image size")
    if len(set(bits)) > 1 or bits[0] % 8 or (one(FORMAT, 1), bits[0]) not in {(1, 8), (1, 16), (1, 32), (2, 8), (2, 16), (2, 32), (3, 32), (3, 64)}:
        raise TiffError(f"samples of {bits} bits and format {one(FORMAT, 1)} are not read")
    tiled = TILES in tags
    chunk = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    text = tags[GEO_TEXT][0].rstrip(b"\0").decode("latin-1") if GEO_TEXT in tags else None
    return Image(
        order, width, height, one(SAMPLES, 1), np.dtype(f"{order}{_KINDS[one(FORMAT, 1)]}{bits[0] // 8}"), one(COMPRESSION, 1), one(PLANAR, 1), one(PREDICTOR, 1),
        chunk, tiled, tags.get(TILES if tiled else STRIPS, []), tags.get(TILE_BYTES if tiled else STRIP_BYTES, []), tags.get(PIXEL_SCALE, []), tags.get(TIEPOINT, []), text,
    )


def _unpacked(raw: bytes) -> bytes:
    """PackBits."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def decode(raw: bytes, image: Image, k: int) -> np.ndarray:
    """rows, columns, samples of a strip or tile, without what lies beyond the image; missing bytes are zero."""
    if image.compression in (8, 32946):
        raw = zlib.decompressobj().decompress(raw)
    elif image.compression == 32773:
        raw = _unpacked(raw)
    elif image.compression != 1:
        raise TiffError(f"compression {image.compression} is not read")
    _, x, y = image.place(k)
    columns, rows = image.chunk
    rows = rows if image.tiled else min(rows, image.height - y)
    samples = 1 if image.planar == 2 else image.bands
    size = rows * columns * samples
    held = np.frombuffer(raw[: size * image.dtype.itemsize // image.dtype.itemsize * image.dtype.itemsize].ljust(size * image.dtype.itemsize, b"\0"), image.dtype)
    out = held.reshape(rows, columns, samples)
    if image.predictor == 2:
        out = np.cumsum(out, axis=1, dtype=image.dtype.newbyteorder("="))
    return out[: image.height - y, : image.width - x]


@dataclass
class Part(ds.InputPartition):
    path: str
    chunks: list[list[int]]  # of each place its strip or tile in every plane


class TiffReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.task_bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))
        x0, y0, x1, y1 = [int(v) for v in options["window"].split(",")] if "window" in options else (0, 0, 1 << 40, 1 << 40)
        self.low, self.high = {"px": x0, "py": y0}, {"px": x1 - 1, "py": y1 - 1}

    def partitions(self) -> list[Part]:
        out = []
        for path in list_files(self.path):
            fs, at = open_input(path)
            with fs.open_input_file(at) as f:
                image = read_image(f)
            planes = image.bands if image.planar == 2 else 1
            places = len(image.offsets) // planes
            size = image.chunk[0] * image.chunk[1] * image.bands * image.dtype.itemsize
            met = [[k + p * places for p in range(planes)] for k in range(places) if self._meets(image, k)]
            step = max(1, self.task_bytes // max(size, 1))
            out += [Part(path, met[k : k + step]) for k in range(0, len(met), step)]
        return out or [Part("", [])]

    def _meets(self, image: Image, k: int) -> bool:
        _, x, y = image.place(k)
        return x <= self.high["px"] and x + image.chunk[0] > self.low["px"] and y <= self.high["py"] and y + image.chunk[1] > self.low["py"]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.chunks:
            return
        fs, at = open_input(part.path)
        with fs.open_input_file(at) as f:
            image = read_image(f)
            for chunk in part.chunks:
                planes = []
                for k in chunk:
                    f.seek(image.offsets[k])
                    planes.append(decode(f.read(image.sizes[k]), image, k))
                yield from self._batches(part.path, image, chunk[0], np.concatenate(planes, axis=2) if len(planes) > 1 else planes[0])

    def _batches(self, path: str, image: Image, k: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, x0, y0 = image.place(k)
        x1, y1 = max(x0, self.low["px"]), max(y0, self.low["py"])
        values = values[y1 - y0 :, x1 - x0 :][: max(0, self.high["py"] - y1 + 1), : max(0, self.high["px"] - x1 + 1)]
        rows, columns, bands = values.shape
        step = max(1, BATCH // max(columns, 1))
        for r in range(0, rows, step):
            some = values[r : r + step].astype(np.float64)
            n = some.shape[0] * columns
            px, py = np.tile(np.arange(x1, x1 + columns, dtype=np.int32), some.shape[0]), np.repeat(np.arange(y1 + r, y1 + r + some.shape[0], dtype=np.int32), columns)
            same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(some.ravel()))
            columns_ = [same(path, pa.string()), same(image.width, pa.int32()), same(image.height, pa.int32()), same(image.bands, pa.int32()), same(image.dtype.kind != "f", pa.bool_()), pa.array(px), pa.array(py), v]
            yield pa.RecordBatch.from_arrays(columns_, names=[c.split()[0] for c in SCHEMA.split(", ")])


class TiffSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def list_files(path: str) -> list[str]:
    """The file, the .tif and .tiff files of a folder, or the files of a folder whose names fit a pattern, in order."""
    folder, _, name = path.rpartition("/")
    pattern = any(c in name for c in "*?[")
    fs, at = open_input(folder if pattern else path)
    if not pattern and fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    whole = folder if pattern else path.rstrip("/")
    head = whole.removesuffix(at.rstrip("/"))
    fits = (lambda n: fnmatch.fnmatchcase(n, name)) if pattern else (lambda n: n.lower().endswith((".tif", ".tiff")))
    return sorted(head + f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=not pattern)) if f.is_file and fits(f.base_name))


def read(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, **options) -> DataFrame:
    """(file, width, height, bands, whole, px, py, v): the pixels of rasters, rows from the top; whole: samples are integers.

    window: only pixels x0 <= px < x1 and y0 <= py < y1."""
    spark.dataSource.register(TiffSource)
    if window:
        options["window"] = ",".join(map(str, window))
    return spark.read.format("tiff").options(path=path, **options).load()


def encode(values: np.ndarray, rows_per_strip: int = 16, deflate: bool = True, origin: tuple[float, float] | None = None, pixel: float = 1.0) -> bytes:
    """A little-endian TIFF file of rows, columns, samples."""
    height, width, bands = values.shape
    dtype = values.dtype.newbyteorder("<")
    strips = [values[r : r + rows_per_strip].astype(dtype).tobytes() for r in range(0, height, rows_per_strip)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8 * dtype.itemsize] * bands), (COMPRESSION, "H", [8 if deflate else 1]), (262, "H", [2 if bands >= 3 else 1]),
        (STRIPS, "I", None), (SAMPLES, "H", [bands]), (ROWS, "I", [rows_per_strip]), (STRIP_BYTES, "I", [len(s) for s in strips]), (PLANAR, "H", [1]), (FORMAT, "H", [kind] * bands),
    ]
    if origin:
        tags += [(PIXEL_SCALE, "d", [pixel, pixel, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, *origin, 0.0])]
    at = 8 + 2 + 12 * len(tags) + 4
    body, codes, entries = b"", {v: k for k, v in _TYPES.items()}, b""
    sizes = {tag: struct.calcsize(f"<{len(strips) if v is None else len(v)}{c}") for tag, c, v in tags}
    data_at = at + sum(s for s in sizes.values() if s > 4)
    places = [data_at + sum(map(len, strips[:k])) for k in range(len(strips))]
    for tag, code, v in tags:
        v = places if v is None else v
        raw = struct.pack(f"<{len(v)}{code}", *v)
        entries += struct.pack("<HHI", tag, codes[code], len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(body)))
        body += raw if len(raw) > 4 else b""
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + body + b"".join(strips)


def write_sheets(pixels: DataFrame, folder: str, width: int, height: int, bands: int, **told) -> DataFrame:
    """(sheet, file): writes pixels(sheet string, px, py, v array of bytes) as one 8-bit file a sheet; what has no row is zero.

    A sheet's size is fixed, so that a task holds width * height * bands bytes whatever the number of rows. Files appear under their names when they are whole."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width, bands), np.uint8)
        image[rows["py"].to_numpy(), rows["px"].to_numpy()] = np.stack(rows["v"].to_numpy()).astype(np.uint8)
        fs, at = open_input(folder)
        fs.create_dir(at, recursive=True)
        name = f"{key[0]}.tif"
        part = f"{at}/.{name}.{np.random.default_rng().integers(1 << 62)}"
        with fs.open_output_stream(part) as f:
            f.write(encode(image, **told))
        fs.move(part, f"{at}/{name}")
        return pd.DataFrame([(key[0], f"{folder}/{name}")], columns=["sheet", "file"])

    return pixels.groupBy("sheet").applyInPandas(run, "sheet string, file string")
