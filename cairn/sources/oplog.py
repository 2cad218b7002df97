"""The operation log: numbered JSON files of writes and deletes, the fold that
replays them, and a binary codec for exchange."""

from __future__ import annotations

import datetime as dt
import os
import struct
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..errors import StorageError
from ..schemas import OPS, STORED
from .store import _fs, delete, exists

KINDS = ("insert", "update", "append")


class OpLog:
    """Appends are batches; each is a folder written whole, then named by its
    number: a reader sees all of a batch or none of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[str]:
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p):
            return []
        return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("b"))

    def numbers(self) -> list[int]:
        return [int(b[1:]) for b in self._batches()]

    def append(self, ops: DataFrame, after: int = -1) -> int:
        """Rows of op, kind, id and record, in the order of ``seq``, become a
        batch; its number is the next after all batches and ``after``."""
        done = self._batches()
        number = max(int(done[-1][1:]) if done else -1, after) + 1
        start = number << 40
        path = f"{self.path}/_new-{number}-{os.getpid()}"
        delete(self.spark, path)
        ops.withColumn("seq", F.col("seq") + F.lit(start)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OPS.fields]).write.parquet(path)
        fs, p = _fs(self.spark, path)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/b{number:012d}")
        if fs.exists(target) or not fs.rename(p, target):
            raise StorageError(f"batch {number} of the log exists")
        return number

    def read(self, after: int = -1) -> DataFrame:
        """The ops of all batches after number ``after``."""
        found = [b for b in self._batches() if int(b[1:]) > after]
        if not found:
            return self.spark.createDataFrame([], OPS)
        return self.spark.read.schema(OPS).parquet(*[f"{self.path}/{b}" for b in found])

    def count(self) -> int:
        return self.read().count()

    def size(self) -> int:
        fs, p = _fs(self.spark, self.path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def truncate(self) -> None:
        if exists(self.spark, self.path):
            delete(self.spark, self.path)


@dataclass(frozen=True)
class RotationPolicy:
    """Rotate at either bound; without bounds, never."""

    max_bytes: int | None = None
    max_records: int | None = None

    def due(self, size: int, records: int) -> bool:
        return (self.max_bytes is not None and size >= self.max_bytes) or (self.max_records is not None and records >= self.max_records)


_FIELDS = [f.name for f in STORED.fields]
_LISTS = {f.name: f.dataType for f in STORED.fields if isinstance(f.dataType, ArrayType)}


def apply_ops(records: list[dict], ops: list[dict], compat: bool = False) -> list[dict]:
    """Replay the ops of one id over its rows, oldest first. A delete marks the
    active row; with ``compat`` it marks the first row, which can already be
    marked."""
    rows = [dict(r) for r in records]
    for op in ops:
        if op["op"] == "delete":
            live = [r for r in rows if not r["deleted"]] if not compat else rows[:1]
            if live:
                live[0]["deleted"] = True
        elif op["kind"] == "append":
            if all(r["deleted"] for r in rows):
                rows.append(dict(op["record"]))
        elif rows:
            at = 0 if compat else next((i for i, r in enumerate(rows) if not r["deleted"]), 0)
            rows[at] = dict(op["record"])
        else:
            rows.append(dict(op["record"]))
    return rows


def fold(records: DataFrame, ops: DataFrame, compat: bool = False) -> DataFrame:
    """The table after the log. Ids that the log doesn't name pass through
    untouched; the others are replayed."""
    named = ops.select("id").distinct()
    rest = records.join(named, "id", "left_anti").select(*_FIELDS)
    mine = records.join(named, "id", "left_semi").select(*_FIELDS)
    return rest.unionByName(replay(mine, ops, compat))


_ROW, _DELETE, _APPEND, _PUT = range(4)


def replay(records: DataFrame, ops: DataFrame, compat: bool = False) -> DataFrame:
    """The rows after the ops, as ``apply_ops`` has them. Rows and ops meet once,
    in the order of id and number, and a task replays one id after another as it
    reads them; it holds no id's ops."""
    if not compat:
        ops = reduce_ops(ops)
    step = F.when(F.col("op") == "delete", _DELETE).when(F.col("kind") == "append", _APPEND).otherwise(_PUT)
    old = records.select("id", F.lit(_ROW).alias("step"), F.col("index_id").alias("at"), F.struct(*_FIELDS).alias("record"))
    new = ops.select("id", step.alias("step"), F.col("seq").alias("at"), "record")
    both = old.unionByName(new).repartition("id").sortWithinPartitions("id", F.col("step") != _ROW, F.asc_nulls_last("at"))
    both = both.withColumn("record", _filled(F.col("record")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _Replay(compat)
        for b in batches:
            yield r.read(b)
        yield from r.last()

    return both.mapInArrow(run, STORED)


def _filled(record: Column) -> Column:
    """The record with empty lists for nulls, and what was null. Spark measures
    an Arrow batch at every row, and goes over the nulls since the last list each
    time: a batch without lists would take the square of its rows."""
    lists = {n: F.coalesce(record[n], F.array().cast(t)) for n, t in _LISTS.items()}
    none = [record[n].isNull().alias(f"no {n}") for n in _LISTS]
    return F.struct(*[lists.get(n, record[n]).alias(n) for n in _FIELDS], *none, record.isNull().alias("none"))


def _as_written(filled: pa.StructArray) -> pa.StructArray:
    """The records that ``_filled`` was given."""
    cols = dict(zip([f.name for f in filled.type], filled.flatten(), strict=True))
    for n in _LISTS:
        cols[n] = pc.if_else(cols[f"no {n}"], pa.scalar(None, cols[n].type), cols[n])
    return pa.StructArray.from_arrays([cols[n] for n in _FIELDS], _FIELDS, mask=cols["none"])


class _Replay:
    """``apply_ops`` over a stream. Held are the first row of the current id and
    its active ones, each as a list of the array, the place in it, and whether
    it is deleted; no op reaches another row, so that it leaves at once."""

    def __init__(self, compat: bool):
        self.compat = compat
        self.started, self.id = False, None
        self.out: list[list] = []
        self._next_id()

    def _next_id(self) -> None:
        self.first: list | None = None
        self.live: deque[list] = deque()
        self.beyond = False  # with compat: an active row after the first

    def _end_id(self) -> None:
        if self.first is not None:
            self.out.append(self.first)
        self.out += [r for r in self.live if r is not self.first]
        self._next_id()

    def read(self, b: pa.RecordBatch) -> pa.RecordBatch:
        self.array = _as_written(b.column("record"))
        gone = pc.fill_null(pc.struct_field(self.array, "deleted"), False).to_pylist()
        op = self._compat_op if self.compat else self._op
        for at, (i, step) in enumerate(zip(b.column("id").to_pylist(), b.column("step").to_pylist(), strict=True)):
            if i != self.id or not self.started:
                self._end_id()
                self.started, self.id = True, i
            op(step, at, gone[at])
        done = self._take()
        for r in {id(r): r for r in [self.first, *self.live] if r is not None}.values():
            if r[0] is self.array:  # else the whole batch would stay for it
                r[0], r[1] = self.array.take(pa.array([r[1]])), 0
        return done

    def last(self) -> Iterator[pa.RecordBatch]:
        if self.started:
            self._end_id()
            yield self._take()

    def _add(self, at: int, gone: bool) -> None:
        row = [self.array, at, gone]
        if self.first is None:
            self.first = row
        elif gone or self.compat:
            self.out.append(row)
            self.beyond |= not gone
        if not gone and not self.compat:
            self.live.append(row)

    def _op(self, step: int, at: int, gone: bool) -> None:
        live = self.live
        if step == _DELETE:
            if live:
                row = live.popleft()
                row[2] = True
                if row is not self.first:
                    self.out.append(row)
        elif step == _ROW or (not live if step == _APPEND else self.first is None):
            self._add(at, gone)
        elif step == _PUT:
            row = live[0] if live else self.first
            row[:] = self.array, at, gone
            if live and gone:
                live.popleft()
                if row is not self.first:
                    self.out.append(row)
            elif not live and not gone:
                live.append(row)

    def _compat_op(self, step: int, at: int, gone: bool) -> None:
        first = self.first
        if step == _DELETE:
            if first is not None:
                first[2] = True
        elif step == _ROW or first is None or (step == _APPEND and first[2] and not self.beyond):
            self._add(at, gone)
        elif step == _PUT:
            first[:] = self.array, at, gone

    def _take(self) -> pa.RecordBatch:
        """The rows that have left, those of earlier batches first."""
        before = [r for r in self.out if r[0] is not self.array]
        now = [r for r in self.out if r[0] is self.array]
        rows = pa.concat_arrays([*[r[0] for r in before], self.array.take(pa.array([r[1] for r in now], pa.int64()))])
        if rows.null_count:
            raise StorageError("a write of the log has no record")
        cols = dict(zip(_FIELDS, rows.flatten(), strict=True))
        cols["deleted"] = pc.or_kleene(cols["deleted"], pa.array([r[2] for r in [*before, *now]], pa.bool_()))
        self.out = []
        return pa.record_batch(cols)


#: Ops of the log, by number, that a task reduces together for an id.
STRETCH = 1 << 20


def reduce_ops(ops: DataFrame) -> DataFrame:
    """The ops that can change anything, with the same replay: an append doesn't
    count after a write, nor a write before the next, unless the write before it
    is of a deleted record. However often an id is written, few of its ops are
    left. Stretches of the log are reduced on their own, so that a hot id's ops
    don't meet before."""
    append, put = F.coalesce(F.col("kind") == "append", F.lit(False)), F.coalesce(F.col("kind") != "append", F.lit(True))
    write = F.coalesce(F.col("op") != "delete", F.lit(True))
    gone = F.coalesce(F.col("record.deleted"), F.lit(False)) if "record" in ops.columns else F.lit(False)
    by_seq = Window.partitionBy("id", "_s").orderBy("seq")
    made = ops.select("*", F.floor(F.col("seq") / STRETCH).alias("_s"), (write & append).alias("_a"), (write & put).alias("_p"), (write & ~gone).alias("_w"))
    kept = made.withColumn("_no", F.col("_a") & F.lag("_w", 1, False).over(by_seq)).where("NOT _no")
    left = kept.withColumn("_no", F.col("_p") & F.col("_w") & F.lead("_p", 1, False).over(by_seq)).where("NOT _no")
    return left.select(*ops.columns)


def last_state(ops: DataFrame) -> DataFrame:
    """Of a log without appends: each id's last written record, with
    ``deleted`` if a delete follows it. Sums on the map side, so a hot id is no
    hot task."""
    other = [c for c in ops.columns if c not in ("seq", "op", "id")]
    written = F.when(F.col("op") == "write", F.col("seq"))
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("_d")
    last = ops.groupBy("id").agg(F.max_by(F.struct("seq", *other), written).alias("_r"), F.max(written).alias("_w"), gone).where(F.col("_w").isNotNull())
    return last.select("id", "_r.*", F.coalesce(F.col("_d") > F.col("_w"), F.lit(False)).alias("deleted"))


# --- binary form ----------------------------------------------------------

MAGIC, VERSION = b"CAIRNLG5", 5
_OLD = {b"CAIRNLG%d" % i: f"v{i}" for i in range(1, 5)}
_EPOCH = dt.date(1970, 1, 1)


def _string(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<I", len(raw)) + raw


def _maybe(s: str | None) -> bytes:
    return b"\0" if s is None else b"\1" + _string(s)


def encode_log(ops: list[dict]) -> bytes:
    """Writes as 1, kind and record; deletes as 2 and the id. The record has
    id, optional texts, days since 1970, tags, vector, the flag, and what a
    replay needs to skip embedding: hash, indexed and embed_text."""
    out = [MAGIC, struct.pack("<I", VERSION)]
    for op in ops:
        if op["op"] == "delete":
            out += [b"\2", _string(op["id"])]
            continue
        r = op["record"]
        day = r.get("updated_at")
        out += [b"\1", bytes([KINDS.index(op["kind"]) + 1]), _string(r["id"]), *[_maybe(r.get(k)) for k in ("title", "body", "source")]]
        out.append(b"\0" if day is None else b"\1" + struct.pack("<i", (day - _EPOCH).days))
        tags, vec = list(r.get("tags") or []), list(r.get("embedding") if r.get("embedding") is not None else [])
        out += [struct.pack("<I", len(tags)), *map(_string, tags), struct.pack(f"<I{len(vec)}f", len(vec), *vec)]
        out += [bytes([bool(r.get("deleted"))]), _maybe(r.get("content_hash")), bytes([r.get("indexed") is not False]), _maybe(r.get("embed_text"))]
    return b"".join(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise StorageError("the log ends within a record")
        self.at += n
        return got

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def string(self) -> str:
        try:
            return self.take(self.u32()).decode()
        except UnicodeDecodeError as e:
            raise StorageError(str(e)) from e

    def maybe(self) -> str | None:
        return self.string() if self.take(1) != b"\0" else None


def decode_log(data: bytes) -> Iterator[dict]:
    """Ops with their ``seq``; an empty file has none, an end between two ops
    is the log's end."""
    if not data:
        return
    r = _Reader(data)
    magic = r.take(8)
    if magic in _OLD:
        raise StorageError(f"log {_OLD[magic]} can't be replayed: check that the records are complete, then delete the log")
    if magic != MAGIC:
        raise StorageError(f"invalid log magic: {magic!r}")
    if (version := r.u32()) != VERSION:
        raise StorageError(f"unsupported log version: {version}")
    seq = 0
    while r.at < len(data):
        op = r.take(1)[0]
        if op == 2:
            yield {"seq": seq, "op": "delete", "kind": None, "id": r.string(), "record": None}
        elif op == 1:
            kind = r.take(1)[0]
            if not 1 <= kind <= 3:
                raise StorageError(f"unknown write kind: {kind}")
            rec: dict = {"id": r.string(), "title": r.maybe(), "body": r.maybe(), "source": r.maybe()}
            rec["updated_at"] = None
            if r.take(1) != b"\0":
                try:
                    rec["updated_at"] = _EPOCH + dt.timedelta(days=struct.unpack("<i", r.take(4))[0])
                except OverflowError as e:
                    raise StorageError("invalid date") from e
            rec["tags"] = [r.string().strip().lower() for _ in range(r.u32())]
            n = r.u32()
            rec["embedding"] = list(struct.unpack(f"<{n}f", r.take(4 * n)))
            rec["deleted"] = r.take(1) != b"\0"
            rec["content_hash"] = r.maybe()
            rec["indexed"] = r.take(1) != b"\0"
            rec["embed_text"] = r.maybe()
            rec["index_id"] = None
            yield {"seq": seq, "op": "write", "kind": KINDS[kind - 1], "id": rec["id"], "record": rec}
        else:
            raise StorageError(f"unknown log op: {op}")
        seq += 1


def read_binary_log(spark: SparkSession, path: str) -> DataFrame:
    """The ops of binary log files, decoded on the executors; a missing path
    has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], OPS)

    def decode(batches):
        for pdf in batches:
            for data in pdf["content"]:
                ops = list(decode_log(bytes(data)))
                if ops:
                    yield pd.DataFrame(ops, columns=OPS.fieldNames())

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, OPS)

