"""Large XML files read by many tasks.

Spark's text reader deals a file out in blocks and ends records at `>`, the one character
that ends markup of every kind. A block's task can't know what it begins in, so that the work is done in two scans:

1.  Each block is read from every state that it could begin in (text, a comment, CDATA, an
    instruction). For each it tells the state at its end and what it did to the elements around it: those it closed and
    opened, how many of the counted elements began, the last attributes that are kept, and the text since the last tag.
    Runs that come to the same state go on as one, so that nearly all blocks are scanned once.
2.  Along each file the blocks' effects are applied one after the other, which gives the context that each block begins
    in (`contexts`); then each block is read once more, in its true context.

The result does not depend on where the blocks begin. Readers are tolerant: unknown or broken markup is skipped,
a close tag that fits no open element changes nothing, and an unfinished tag at the end of a file is dropped (of an unfinished CDATA section the text is
given, which no close tag follows). A tag ends at the first `>`. What one task holds is one record, or the text of one element where comments or CDATA cut it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States that a block can begin in, with the end that each but the first waits for.
STATES = {"text": b"", "comment": b"--", "cdata": b"]]", "instruction": b"?"}
#: Markup that outlasts a `>`.
_LONG = {b"!--": "comment", b"![CDATA[": "cdata", b"?": "instruction"}
#: Contexts that are sent to the tasks at once; each is one block's, so that they stand for this many times the block size.
CONTEXTS = 1 << 18

_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|lt|gt|amp|quot|apos);")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}

#: (kind, name, attributes, text): open, close or text.
Event = tuple[str, str, dict[str, str], str]


def decode_entities(text: str) -> str:
    """Named and numeric entities; what is no entity stays."""

    def one(m: re.Match) -> str:
        if (named := _NAMED.get(m[1])) is not None:
            return named
        digits = m[1][1:]
        try:
            code = int(digits[1:], 16) if digits[:1] in "xX" else int(digits)
        except ValueError:
            return m[0]
        return chr(code) if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def _local(name: str) -> str:
    return name.partition(":")[2] if ":" in name else name


def _tag(body: str) -> list[Event]:
    """The events of what stands between < and >; none for garbage."""
    if body.startswith("/"):
        name = _local(body[1:].strip())
        return [("close", name, {}, "")] if name else []
    empty = body.endswith("/")
    body = body.removesuffix("/")
    m = re.match(r"[^\s/>]+", body)
    if not m:
        return []
    name = _local(m[0])
    attributes = {_local(k): decode_entities(a or b) for k, a, b in _ATTRIBUTE.findall(body[m.end() :])}
    return [("open", name, attributes, "")] + ([("close", name, {}, "")] if empty else [])


def step(state: str, record: bytes, ended: bool = True) -> tuple[str, list[Event]]:
    """The state after a record and the events in it; ended: a `>` stood behind the record."""
    tail = b">" if ended else b""
    text = lambda raw, coded=True: [("text", "", {}, decode_entities(t) if coded else t)] if (t := raw.decode("utf-8", "replace")) else []
    if state != "text":
        done = ended and record.endswith(STATES[state])
        held = (record[:-2] if done else record + tail) if state == "cdata" else b""
        return "text" if done else state, text(held, False)
    head, mark, body = record.partition(b"<")
    if not mark:
        return "text", text(record + tail)
    events = text(head)
    for start, inside in _LONG.items():
        if body.startswith(start):
            rest = body[len(start) :]
            done = ended and rest.endswith(STATES[inside])
            if inside == "cdata":
                events += text(rest[:-2] if done else rest + tail, False)
            return "text" if done else inside, events
    if ended and not body.startswith(b"!"):
        events += _tag(body.decode("utf-8", "replace"))
    return "text", events


@dataclass
class Context:
    """What a place in a file is within."""

    state: str = "text"
    path: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    kept: dict[str, str] = field(default_factory=dict)
    text: str = ""


@dataclass(frozen=True)
class Watch:
    """Elements that are counted, and elements whose attributes are kept until the next such one."""

    counted: frozenset[str] = frozenset()
    kept: frozenset[str] = frozenset()


@dataclass
class Effect:
    """What a stretch of a file does to any context; steps are names opened, or closed with a / in front."""

    steps: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    kept: dict[str, str] | None = None
    tagged: bool = False
    text: str = ""

    def add(self, event: Event, watch: Watch) -> None:
        kind, name, attributes, text = event
        if kind == "text":
            self.text += text
            return
        self.tagged, self.text = True, ""
        if kind == "open":
            self.steps.append(name)
            if name in watch.counted:
                self.counts[name] = self.counts.get(name, 0) + 1
            if name in watch.kept:
                self.kept = attributes
        else:
            self._close(name)

    def _close(self, name: str) -> None:
        for k in range(len(self.steps) - 1, -1, -1):
            if self.steps[k] == name:
                del self.steps[k:]
                return
            if self.steps[k][0] == "/":
                break
        self.steps.append("/" + name)

    def then(self, later: "Effect") -> "Effect":
        out = Effect(list(self.steps), dict(self.counts), later.kept if later.kept is not None else self.kept, self.tagged or later.tagged)
        out.text = later.text if later.tagged else self.text + later.text
        for s in later.steps:
            if s[0] == "/":
                out._close(s[1:])
            else:
                out.steps.append(s)
        for k, n in later.counts.items():
            out.counts[k] = out.counts.get(k, 0) + n
        return out

    def on(self, c: Context, state: str) -> Context:
        path = list(c.path)
        for s in self.steps:
            if s[0] != "/":
                path.append(s)
            elif s[1:] in path:
                while path.pop() != s[1:]:
                    pass
        counts = {k: c.counts.get(k, 0) + self.counts.get(k, 0) for k in {*c.counts, *self.counts}}
        return Context(state, path, counts, self.kept if self.kept is not None else c.kept, self.text if self.tagged else c.text + self.text)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, block, record): what stands before each `>`, in order within a partition; block is the byte at which its split begins."""
    read = spark.read.option("lineSep", ">").text(path)
    meta = F.col("_metadata")
    return read.select(meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("record"))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Iterator[bytes]]]:
    """The blocks of a partition, each with its records; one block must be used up before the next."""

    def rows():
        for b in batches:
            yield from zip(*(b.column(k).to_pylist() for k in range(4)))

    from itertools import groupby

    for key, group in groupby(rows(), key=lambda r: (r[0], r[1], r[2])):
        yield key, (r[3] for r in group)


def effects(block: Iterable[bytes], watch: Watch) -> tuple[dict[str, tuple[str, Effect]], int, int]:
    """For each state that a block can begin in the state at its end and its effect; and the block's records and their bytes."""
    # Runs that are in one state go on as one: a run has its present state, its effect since, and the starts that it stands for with theirs before.
    runs = {s: (Effect(), {s: Effect()}) for s in STATES}
    n = size = 0
    for record in block:
        n, size, after = n + 1, size + len(record), {}
        for state, (effect, starts) in runs.items():
            to, events = step(state, record)
            for e in events:
                effect.add(e, watch)
            if to in after:
                other, others = after[to]
                others = {k: before.then(other) for k, before in others.items()} | {k: before.then(effect) for k, before in starts.items()}
                after[to] = (Effect(), others)
            else:
                after[to] = (effect, starts)
        runs = after
    return {k: (state, before.then(effect)) for state, (effect, starts) in runs.items() for k, before in starts.items()}, n, size


def contexts(read: DataFrame, watch: Watch) -> DataFrame:
    """(file, block, context, unfinished) of each block but those that begin a file and end it whole. `context` is JSON; unfinished: the file ends within its last record."""

    def told(batches):
        for (file, size, block), rows in _blocks(batches):
            found, n, length = effects(rows, watch)
            text = json.dumps({k: [s, vars(e)] for k, (s, e) in found.items()})
            yield pa.record_batch({"file": [file], "size": [size], "block": [block], "n": [n], "bytes": [length], "effects": [text]})

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        cut = int(pdf["n"].sum() + pdf["bytes"].sum() - pdf["size"].iloc[0]) == 1
        out, c = [], Context()
        for k, r in enumerate(pdf.itertuples()):
            unfinished = cut and k + 1 == len(pdf)
            if r.block or unfinished:
                out.append((r.file, r.block, json.dumps(vars(c)), unfinished))
            state, effect = json.loads(r.effects)[c.state]
            c = Effect(**effect).on(c, state)
        return pd.DataFrame(out, columns=["file", "block", "context", "unfinished"])

    each = read.mapInArrow(told, "file string, size long, block long, n long, bytes long, effects string")
    return each.groupBy("file").applyInPandas(along, "file string, block long, context string, unfinished boolean")


def scan(read: DataFrame, found: DataFrame, rows: Callable[[str, int, Context, Iterator[Event]], Iterator[dict]], schema: pa.Schema, ddl: str, chunk: int = 1 << 16) -> DataFrame:
    """rows(file, block, context, events) of every block, in its context. `found` are the `contexts`, written to a table."""
    spark, total = read.sparkSession, found.count()
    parts = -(-total // CONTEXTS) or 1
    out = None
    for p in range(parts):  # as a rule one; more where blocks are very many, each with the contexts of its own files
        own = lambda df: df if parts == 1 else df.filter(F.pmod(F.xxhash64("file"), F.lit(parts)) == p)
        sent = spark.sparkContext.broadcast({(r.file, r.block): (r.context, r.unfinished) for r in own(found).toLocalIterator()})

        def run(batches, sent=sent):
            for (file, _, block), each in _blocks(batches):
                if block and (file, block) not in sent.value:
                    raise ValueError(f"no context for byte {block} of {file}: the files or spark.sql.files.maxPartitionBytes changed between two reads")
                text, unfinished = sent.value.get((file, block), (None, False))
                context = Context(**json.loads(text)) if text else Context()
                made, held = rows(file, block, context, _events(each, context, unfinished)), []
                for row in made:
                    held.append(row)
                    if len(held) == chunk:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

        one = own(read).mapInArrow(run, ddl)
        out = one if out is None else out.unionByName(one)
    return out


def _events(block: Iterator[bytes], c: Context, unfinished: bool) -> Iterator[Event]:
    """Events of a block. c is kept up to date: before an event is given, it holds what the event is in; its text is what came since the last tag."""
    state, held = c.state, None
    for record in block:
        if held is not None:
            state, events = step(state, held)
            yield from events
        held = record
    if held is not None:
        yield from step(state, held, not unfinished)[1]


def follow(c: Context, event: Event, watch: Watch) -> None:
    """The context after an event."""
    kind, name, attributes, text = event
    if kind == "text":
        c.text += text
        return
    c.text = ""
    if kind == "open":
        c.path.append(name)
        if name in watch.counted:
            c.counts[name] = c.counts.get(name, 0) + 1
        if name in watch.kept:
            c.kept = attributes
    elif name in c.path:
        while c.path.pop() != name:
            pass


_EVENTS = "file string, block long, k long, event string, name string, attributes map<string,string>, text string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, k, event, name, attributes, text): the open, close and text events of XML files, in order of block and k."""
    from plumbline.sources.tables import materialize

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("event", pa.string()), ("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
    read = records(spark, path)

    def rows(file, block, context, events):
        for k, (kind, name, attributes, text) in enumerate(events):
            yield {"file": file, "block": block, "k": k, "event": kind, "name": name or None, "attributes": list(attributes.items()), "text": text or None}

    return scan(read, materialize(contexts(read, Watch()), "xml-contexts"), rows, schema, _EVENTS)
