"""A cache of preview samples: a sink of column files, and a source that checks them.

Every task writes six files of its own (positions, colours, intensities, classes and the two return numbers) and a list of its
nodes' slices. When all have committed, one descriptor names their parts; it is written beside and moved to its name, last of all, so that a
cache without it does not exist. A task that fails, or whose attempt is not the committed one, leaves files that no descriptor
names. The descriptor has one line a task; the slices stay in the parts. The reader compares files and slices with what
the descriptor and the parts tell before it reads any.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from plumbline.sources.las import open_input

VERSION = 1
DESCRIPTOR = "descriptor.json"
# The column files, their element types, and the columns in each.
FILES = {
    "positions": ("<f4", ("lx", "ly", "lz")), "colors": ("u1", ("r", "g", "b")), "intensities": ("<f4", ("intensity",)),
    "classifications": ("u1", ("classification",)), "return_numbers": ("u1", ("return_number",)), "numbers_of_returns": ("u1", ("number_of_returns",)),
}
SCHEMA = "id long, lx float, ly float, lz float, r int, g int, b int, intensity float, classification int, return_number int, number_of_returns int"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = [pa.int64(), *[pa.float32()] * 3, *[pa.int32()] * 3, pa.float32(), *[pa.int32()] * 3]


@dataclass
class Written(ds.WriterCommitMessage):
    part: str
    points: int
    nodes: int


class CacheWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.told, self.overwrite = options["path"].rstrip("/"), options.get("told", "{}"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = open_input(self.folder)
        fs.create_dir(at, recursive=True)
        part = f"part-{uuid.uuid4().hex}"
        files = {name: fs.open_output_stream(f"{at}/{part}.{name}") for name in FILES}
        slices, n = [], 0
        try:
            for b in iterator:
                column = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                ids = column("id").astype(np.int64)
                for name, (kind, columns) in FILES.items():
                    files[name].write(np.stack([column(c) for c in columns], axis=1).astype(kind).tobytes())
                edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else [0]
                for a, z in zip(edges, edges[1:]):
                    if slices and slices[-1][0] == ids[a] and slices[-1][1] + slices[-1][2] == n + a:
                        slices[-1][2] += z - a
                    else:
                        slices.append([int(ids[a]), n + a, z - a])
                n += len(ids)
        finally:
            for f in files.values():
                f.close()
        with fs.open_output_stream(f"{at}/{part}.slices") as f:
            f.write(json.dumps(slices).encode())
        return Written(part, n, len({s[0] for s in slices}))

    def commit(self, messages: list[Written]) -> None:
        fs, at = open_input(self.folder)
        if not self.overwrite and fs.get_file_info(f"{at}/{DESCRIPTOR}").is_file:
            self.abort(messages)
            raise FileExistsError(f"{self.folder} holds a cache")
        parts = [vars(m) for m in messages if m is not None and m.points]
        descriptor = {"version": VERSION, "points": sum(p["points"] for p in parts), "parts": parts, "told": json.loads(self.told)}
        beside = f"{at}/.{DESCRIPTOR}-{uuid.uuid4().hex}"
        with fs.open_output_stream(beside) as f:
            f.write(json.dumps(descriptor, indent=1).encode())
        fs.move(beside, f"{at}/{DESCRIPTOR}")

    def abort(self, messages: list[Written]) -> None:
        fs, at = open_input(self.folder)
        for m in messages:
            if m is not None:
                for name in (*FILES, "slices"):
                    if fs.get_file_info(f"{at}/{m.part}.{name}").is_file:
                        fs.delete_file(f"{at}/{m.part}.{name}")


@dataclass
class Part(ds.InputPartition):
    part: str
    points: int


class CacheReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.ids = {int(v) for v in options["ids"].split(",")} if "ids" in options else None

    def partitions(self) -> list[Part]:
        told = read_descriptor(self.folder)
        return [Part(p["part"], p["points"]) for p in told["parts"]] or [Part("", 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.part:
            return
        fs, at = open_input(self.folder)
        with fs.open_input_stream(f"{at}/{part.part}.slices") as f:
            slices = json.loads(f.read())
        for name, (kind, columns) in FILES.items():
            have, want = fs.get_file_info(f"{at}/{part.part}.{name}").size, part.points * np.dtype(kind).itemsize * len(columns)
            if have != want:
                raise ValueError(f"{part.part}.{name} has {have} bytes of {want}")
        files = {name: fs.open_input_file(f"{at}/{part.part}.{name}") for name in FILES}
        try:
            for node, first, count in slices:
                if first < 0 or count < 0 or first + count > part.points:
                    raise ValueError(f"the slice of node {node} lies outside {part.part}")
                if self.ids is None or node in self.ids:
                    yield from self._slice(files, node, first, count)
        finally:
            for f in files.values():
                f.close()

    def _slice(self, files, node: int, first: int, count: int, step: int = 1 << 17) -> Iterator[pa.RecordBatch]:
        for at in range(first, first + count, step):
            n, values = min(step, first + count - at), {"id": None}
            for name, (kind, columns) in FILES.items():
                size = np.dtype(kind).itemsize * len(columns)
                files[name].seek(at * size)
                held = np.frombuffer(files[name].read(n * size), kind).reshape(n, len(columns))
                values |= {c: held[:, k] for k, c in enumerate(columns)}
            values["id"] = np.full(n, node)
            yield pa.RecordBatch.from_arrays([pa.array(values[c]).cast(t) for c, t in zip(_COLUMNS, _ARROW)], names=_COLUMNS)


class CacheSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "preview-cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CacheReader:
        return CacheReader(self.options)

    def writer(self, schema, overwrite: bool) -> CacheWriter:
        return CacheWriter(self.options, overwrite)


def read_descriptor(folder: str) -> dict:
    """The descriptor of a finished cache. One of another version is no cache."""
    fs, at = open_input(folder.rstrip("/"))
    if not fs.get_file_info(f"{at}/{DESCRIPTOR}").is_file:
        raise FileNotFoundError(f"{folder} holds no finished cache")
    with fs.open_input_stream(f"{at}/{DESCRIPTOR}") as f:
        told = json.loads(f.read())
    if told.get("version") != VERSION:
        raise ValueError(f"{folder} has version {told.get('version')}")
    return told


def write(sample: DataFrame, folder: str, told: dict | None = None, overwrite: bool = False) -> None:
    """Writes the sample of one cloud (columns of SCHEMA, and idx for the order), nodes together and in file order; told goes into the descriptor."""
    sample.sparkSession.dataSource.register(CacheSource)
    names = sample.select("id", "idx", *[c for c in _COLUMNS if c != "id"])
    ordered = names.repartitionByRange("id", "idx").sortWithinPartitions("id", "idx").drop("idx")
    ordered.write.format("preview-cache").mode("overwrite" if overwrite else "append").option("told", json.dumps(told or {})).save(folder)


def read(spark: SparkSession, folder: str, ids: list[int] | None = None) -> DataFrame:
    """The points of a cache, or of some nodes."""
    spark.dataSource.register(CacheSource)
    options = {"ids": ",".join(map(str, ids))} if ids is not None else {}
    return spark.read.format("preview-cache").options(path=folder, **options).load()
