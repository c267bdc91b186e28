"""WARC archives of pages, and their capture index by an external merge.

`write_archives` gives each page a record: of pages with equal payloads the one with the
smallest page_id is a response, the others revisit it. `write_runs` reads the archives
back, and each archive's captures become a run sorted by URL key and timestamp.
`merge_runs` merges runs by a tree of losers, FAN_IN at a time, until one pass is left.
Every pass is cut into key ranges, each of which merges its slice of every run of a group; a
run of a later pass is one file a range. The result is the capture history of every URL, in global order.

Records are gzip members of their own, as other readers expect. WARC-Payload-Digest is the
bare base32 SHA-1 of the full payload, also in revisits, which name the response in
WARC-Refers-To and give the full payload's length in X-Payload-Length.

Defined cases: a null html is an empty payload; a null url has the URL key of an empty one;
repeated rows with the smallest page_id of their payload are all responses; a null
page_id never is the smallest unless all are null, which makes all of them responses;
payloads shorter than min_bytes are all responses; an empty table gives no archives and
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, new_folder
from plumbline.llm.files import reading, writing
from plumbline.llm.losertree import LoserTree

#: Runs that one merge reads at once.
FAN_IN = 128
#: Captures in a row group of a run, which is what a merge holds of each run.
GROUP_ROWS = 512
#: Runs, and captures of each, from which the key ranges are chosen; they only balance the tasks.
RANGE_RUNS, RANGE_KEYS = 256, 128
#: Captures a key range should hold.
RANGE_ROWS = 1 << 17
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)

CAPTURE = pa.schema(
    [
        ("urlkey", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("at", pa.int64()),
        ("size", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)
CAPTURE_KIND = (
    "urlkey string, ts long, page_id long, archive string, at long, size long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long"
)


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then the path and query in lower case."""
    try:
        u = urlsplit((url or "").strip())
        host = u.hostname or ""
    except ValueError:
        return (url or "").lower()
    path = (u.path.rstrip("/") or "/") + (f"?{u.query}" if u.query else "")
    return ",".join(reversed(host.split("."))) + ")" + path.lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, url: str, seconds: int, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {(EPOCH + timedelta(seconds=seconds)).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Target-URI: {''.join(c for c in url if c >= ' ')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {sha1}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def records(path: str, block: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, size, headers, block) of each record of an archive."""
    with reading(path) as f:
        start, used, press, out, data = 0, 0, None, bytearray(), b""
        while True:
            if not data and not (data := f.read(block)):
                return
            press = press or zlib.decompressobj(31)
            out += press.decompress(data)
            used += len(data) - len(press.unused_data)
            data = press.unused_data
            if press.eof:
                head, _, rest = bytes(out).partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                yield start, used, fields, rest[: int(fields["Content-Length"])]
                start, used, press, out = start + used, 0, None, bytearray()


def _name(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _page_id(name: str | None) -> int | None:
    found = (name or "").strip("<>").rpartition(":")[2]
    return None if found in ("", "none") else int(found)


def _int(x) -> int | None:
    return None if x is None or x != x else int(x)


def _archive(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        batches = (b for b in batches if len(b))
        if (batch := next(batches, None)) is None:
            return
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        with writing(path) as out:
            while batch is not None:
                for r in batch.itertuples(index=False):
                    page_id, first = _int(r.page_id), _int(r.first)
                    payload, revisit = (r.html or "").encode("utf-8", "surrogatepass"), r.revisit
                    name = _name(page_id)
                    sha1 = base64.b32encode(bytes.fromhex(r.sha1)).decode()
                    out.write(
                        record("revisit" if revisit else "response", name, r.url or "", (page_id or 0) % 10**9, payload, sha1, _name(first) if revisit else None)
                    )
                batch = next(batches, None)
        yield pd.DataFrame({"archive": [path]})

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the pages as WARC files in folder; returns their list (archive)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    shared = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("n"))
        .groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
        .filter((F.col("times") > 1) & (F.col("n") >= min_bytes))
        .select("sha1", "first")
    )
    # Nothing needs the rows of a payload together, so that Spark splits this join where a payload is hot.
    told = rows.join(materialize(shared, "shared-payloads"), "sha1", "left").select(
        "page_id", "url", "html", "sha1", "first",
        F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"),
    )
    return materialize(told.mapInPandas(_archive(folder), "archive string"), "archives")


def _run(folder: str):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["archive"]:
                rows = []
                for at, size, h, block in records(archive):
                    payload = block.partition(b"\r\n\r\n")[2]
                    full = h["WARC-Type"] == "response"
                    if full and digest(payload) != h["WARC-Payload-Digest"]:
                        raise ValueError(f"{archive} at {at}: payload does not match its digest")
                    seconds = int((datetime.strptime(h["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc) - EPOCH).total_seconds())
                    rows.append(
                        (url_key(h.get("WARC-Target-URI")), seconds, _page_id(h["WARC-Record-ID"]), archive, at, size,
                         len(payload) if full else int(h["X-Payload-Length"]), h["WARC-Payload-Digest"], h["WARC-Type"], _page_id(h.get("WARC-Refers-To")))
                    )
                rows.sort(key=_order)
                path = f"{folder}/{archive.rpartition('/')[2]}.run"
                _save(path, iter(rows))
                yield pd.DataFrame({"run": [path], "n": [len(rows)]})

    return index


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[3], row[4]


class _Capture(tuple):
    """A row that compares by its place in the index."""

    def __lt__(self, other: tuple) -> bool:
        return _order(self) < _order(other)


def _save(path: str, rows: Iterator[tuple]) -> int:
    total = 0
    with writing(path) as out, pq.ParquetWriter(out, CAPTURE, compression="zstd") as to:
        while part := [r for _, r in zip(range(GROUP_ROWS), rows)]:
            to.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), CAPTURE)], schema=CAPTURE))
            total += len(part)
    return total


def _slice(path: str, low: tuple | None, high: tuple | None) -> Iterator[_Capture]:
    """The captures of a run from low on and below high; row groups outside are not read."""
    with reading(path) as f:
        found = pq.ParquetFile(f)
        for g in range(found.num_row_groups):
            keys = found.metadata.row_group(g).column(0).statistics
            if keys is not None and keys.has_min_max and (low and keys.max < low[0] or high and keys.min > high[0]):
                continue
            columns = [c.to_pylist() for c in found.read_row_group(g, use_threads=False).columns]
            for row in zip(*columns):
                place = _order(row)[:3]
                if high and place >= high:
                    return
                if not low or place >= low:
                    yield _Capture(row)


def write_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Read every archive back and write its captures as a sorted run; returns the list (run, n)."""
    # The list is short but names large files: an explicit number of tasks is left alone by adaptive execution.
    dealt = archives.repartition(max(1, archives.count()), "archive")
    return materialize(dealt.mapInPandas(_run(folder), "run string, n long"), "runs")


def _piece(run: str, part: int) -> str:
    """The file of a run that holds the key range; a run of the first pass is one file."""
    return run if run.endswith(".run") else f"{run}/{part:06d}.run"


def _merge_groups(folder: str, edges: list[tuple | None]):
    """Merge rows (g, part, runs): key range `part` of each group's runs, into a file."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part, runs in zip(batch["g"], batch["part"], batch["runs"]):
                run = f"{folder}/{g:06d}"
                slices = [_slice(_piece(r, part), edges[part], edges[part + 1]) for r in sorted(runs)]
                yield pd.DataFrame({"run": [run], "n": [_save(_piece(run, part), iter(LoserTree(slices)))]})

    return merge


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for run, n in zip(batch["run"], batch["n"]):
            step, out = max(1, -(-n // RANGE_KEYS)), []
            with reading(run) as f:
                found = pq.ParquetFile(f)
                at = 0
                for g in range(found.num_row_groups):
                    rows = found.metadata.row_group(g).num_rows
                    if any((at + k) % step == 0 for k in range(rows)):
                        t = found.read_row_group(g, columns=["urlkey", "ts", "page_id"]).to_pylist()
                        out += [(x["urlkey"], x["ts"], -1 if x["page_id"] is None else x["page_id"]) for k, x in enumerate(t) if (at + k) % step == 0]
                    at += rows
            yield pd.DataFrame(out, columns=["urlkey", "ts", "page_id"])


def merge_runs(runs: DataFrame, folder: str) -> DataFrame:
    """The captures of all runs in global order: rows of CAPTURE_KIND with part, the key range they lie in.

    Rows are in order within a part and parts in order of their numbers."""
    spark, level, coarse = runs.sparkSession, 0, None
    total, k = (x or 0 for x in runs.agg(F.sum("n"), F.count("*")).first())
    sampled = runs.orderBy(F.xxhash64("run")).limit(RANGE_RUNS)
    keys = sorted(tuple(r) for r in sampled.mapInPandas(_keys, "urlkey string, ts long, page_id long").collect())
    parts = max(1, min(-(-total // RANGE_ROWS), len(keys)), min(spark.sparkContext.defaultParallelism, len(keys)))
    cuts = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    edges = [None, *cuts, None]
    while k > FAN_IN:
        level += 1
        groups = -(-k // FAN_IN)
        if coarse is None:  # ranges of all passes but the last: as many tasks, each for one group only
            step = max(1, min(groups, len(edges) - 1))
            coarse = [*edges[:-1:step], None]
        ranges = len(coarse) - 1
        dealt = runs.select(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g"), "run").groupBy("g").agg(F.collect_list("run").alias("runs"))
        tasks = dealt.select("g", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("part"), "runs").repartition(groups * ranges, "g", "part")
        done = materialize(tasks.mapInPandas(_merge_groups(f"{folder}/level-{level}", coarse), "run string, n long"), "runs")
        runs = materialize(done.groupBy("run").agg(F.sum("n").alias("n")), "runs")
        k = runs.count()
    names = [r.run for r in runs.orderBy("run").collect()]  # at most FAN_IN
    within = coarse or [None, None]
    piece = [bisect_right(within[1:-1], e) if e else 0 for e in edges[:-1]]  # which coarse range each range lies in

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch["id"].tolist():
                merged = iter(LoserTree([_slice(_piece(r, piece[part]), edges[part], edges[part + 1]) for r in names]))
                while rows := [r for _, r in zip(range(8192), merged)]:
                    out = pd.DataFrame(rows, columns=CAPTURE.names)
                    for c in ("page_id", "refers_to"):
                        out[c] = pd.array([_int(x) for x in out[c]], dtype="Int64")
                    out["part"] = part
                    yield out

    return spark.range(0, len(edges) - 1, 1, len(edges) - 1).mapInPandas(merge, f"{CAPTURE_KIND}, part int")


def capture_index(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    folder = new_folder(spark, "warc")
    archives = write_archives(pages, folder, min_bytes)
    return merge_runs(write_runs(archives, f"{folder}/runs"), f"{folder}/runs")
