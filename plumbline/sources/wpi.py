"""Binary tiles for interchange: u32 count, u32 flags (bit 0: colours), then records of int32 x, y, z,
u16 intensity, u8 class, u8 return byte and, with colours, three u16; gzip around it."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FIELDS = [("xi", "<i4"), ("yi", "<i4"), ("zi", "<i4"), ("intensity", "<u2"), ("classification", "u1"), ("return_byte", "u1")]
COLOURS = [("r", "<u2"), ("g", "<u2"), ("b", "<u2")]


def encode(points: pd.DataFrame, colours: bool = True) -> bytes:
    kind = np.dtype(FIELDS + COLOURS * colours)
    rec = np.zeros(len(points), kind)
    for name in kind.names:
        rec[name] = points[name].to_numpy()
    return struct.pack("<II", len(rec), int(colours)) + rec.tobytes()


def decode(raw: bytes) -> pd.DataFrame:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    n, flags = struct.unpack_from("<II", raw)
    kind = np.dtype(FIELDS + COLOURS * (flags & 1))
    if len(raw) < 8 + n * kind.itemsize:
        raise ValueError("a tile is cut short")
    rec = np.frombuffer(raw, kind, n, 8)
    return pd.DataFrame({k: rec[k].astype(np.int64) for k in kind.names})


def tiles(owned: DataFrame, *key: str) -> DataFrame:
    """(key.., tile): the points of each node as one compressed tile; a node holds at most its capacity."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[list(key)].head(1).copy()
        out["tile"] = [gzip.compress(encode(rows.sort_values("idx")), mtime=0)]
        return out

    kinds = dict(owned.dtypes)
    return owned.groupBy(*key).applyInPandas(pack, ", ".join(f"{k} {kinds[k]}" for k in key) + ", tile binary")
