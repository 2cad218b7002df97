"""Token ids in bit-packed files.

Every id takes the least number of bits that holds the vocabulary. A file is a
run of blocks of BLOCK ids, each padded to whole bytes, then the document
index (id, validity, first id), the block offsets and a fixed trailer, so that
any block unpacks by itself with numpy and any document is found by one seek.

Documents are in ascending id order over all files: rows are range-partitioned
and sorted by id, the text's hash and a number of the row, so that no id, null
included, and no text that many rows share makes a range longer. One task
encodes a range and writes its files in a stream, and a manifest row names each
file. A task that runs twice writes two files; the manifest has one of them.
Files are read again in groups of about READ_IDS ids.

Defined cases: a null text is an empty one, which encodes as the end id alone;
bytes that are no UTF-8 are U+FFFD. Null ids come last; rows of equal ids are
ordered by their text's hash, and equal rows come together. Texts of any length
are encoded whole, and one longer than a file has a file to itself. Other columns
are ignored. An empty table gives no file and no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import coded_words, fresh, input_bytes, sized, stored, table, text_bytes, valid_text

MAGIC = b"CAIRNBP1"
BLOCK = 65_536
TRAILER = struct.Struct("<8sIIQQQQ")
#: Bytes of input for one range, about.
RANGE_BYTES = 16_000_000
#: Ranges of one shuffle at most, as its bookkeeping grows with their number;
#: beyond, a range has several files, still one after another.
MAX_RANGES = 200_000
#: A task starts another file after so many ids.
FILE_IDS = 1 << 25
#: Ids that one task reads again, about.
READ_IDS = 1 << 24


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class FileWriter:
    """One file; documents come in order."""

    def __init__(self, uri: str, bits: int, vocab_size: int):
        self.uri, self.bits, self.vocab = uri, bits, vocab_size
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.docs: list[int] = []
        self.valid: list[int] = []
        self.starts: list[int] = []
        self.offsets = [0]
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc or 0)
        self.valid.append(doc is not None)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._blocks()

    def _blocks(self, last: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            data = pack(ids[i : min(i + BLOCK, end)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held = [ids[end:]]
        self.n_held = len(ids) - end

    def close(self) -> None:
        self._blocks(last=True)
        self.out.write(np.array(self.docs, "<i8").tobytes() + np.array(self.valid, "u1").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.bits, BLOCK, self.n, len(self.docs), len(self.offsets), self.vocab))
        self.out.close()


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        magic, self.bits, self.block, self.n, docs, offsets, self.vocab = TRAILER.unpack(self.f.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        at = size - TRAILER.size - docs * 17 - offsets * 8
        index = self.f.read_at(docs * 17 + offsets * 8, at)
        self.docs = np.frombuffer(index, "<i8", docs)
        self.valid = np.frombuffer(index, "u1", docs, docs * 8)
        self.starts = np.frombuffer(index, "<u8", docs, docs * 9).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", offsets, docs * 17).astype(np.int64)
        self.ends = np.append(self.starts[1:], self.n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from position ``start`` to ``end``."""
        if end <= start:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(start // self.block, (end - 1) // self.block + 1):
            first = b * self.block
            n = min(self.block, self.n - first)
            data = self.f.read_at(int(self.offsets[b + 1] - self.offsets[b]), int(self.offsets[b]))
            out.append(unpack(data, self.bits, n)[max(0, start - first) : end - first])
        return np.concatenate(out)

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.ends[i]))

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start, ids) of all documents in order; each block is read once."""
        held, base, b = np.zeros(0, np.uint32), 0, 0
        for doc, ok, s, e in zip(self.docs.tolist(), self.valid.tolist(), self.starts.tolist(), self.ends.tolist()):
            parts = [held[s - base :]]
            while base + sum(map(len, parts)) + (s - base if parts[0] is not held else 0) < e and b < len(self.offsets) - 1:
                parts.append(self.ids(b * self.block, min(self.n, (b + 1) * self.block)))
                b += 1
            held, base = np.concatenate(parts) if len(parts) > 1 else parts[0], s
            yield (doc if ok else None), s, held[: e - s]


# --- encoding -------------------------------------------------------------

#: Texts of these characters alone take the word cache; all others go to the
#: library whole. Their lower case, normal form and classes are the same here
#: and in the library.
SAFE = re.compile(r"[\x09-\x0d\x20-\x7e\xa1-\xac\xae-\xff]*")
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_DIGITS}]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of the newer half of the cache; about 200 bytes each.
CACHE = 400_000


def _byte_table() -> dict[int, str]:
    """Latin-1 characters as the printable stand-ins of their UTF-8 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    stand = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(stand[b] for b in chr(c).encode()) for c in range(256)}


class Encoder:
    """Ids by the tokenizers library, through a bounded cache of words.

    A lower-casing word BPE encodes each piece of a text by itself, so the ids
    of a text are those of its pieces joined. The library's own model encodes
    each new piece. Texts of other characters, texts with the strings
    of special tokens and all other tokenizers go to the library whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        spec = json.loads(self.tok.to_str())
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if self.vocab <= 1 << 16 else "<u4"
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [n["type"] for n in norm.get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        spaces = [(n["pattern"], n["content"]) for n in norm.get("normalizers", []) if n["type"] == "Replace"] == [({"Regex": r"\s+"}, " ")]
        self.fast = spaces and kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SPLIT} and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.table = _byte_table()
        self.size = cache
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}
        self.kind = {2: "H", 4: "I"}[np.dtype(self.dtype).itemsize]

    def _piece(self, p: str) -> bytes:
        got = self.old.get(p)
        if got is None:
            got = array(self.kind, [t.id for t in self.model.tokenize(p.translate(self.table))]).tobytes()
        if len(self.pieces) >= self.size:
            self.old, self.pieces = self.pieces, {}
        self.pieces[p] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids' little-endian bytes, two or four for each."""
        return self.encode_all(pa.array([text], pa.string()), None)[0].as_py()

    def encode_all(self, texts: pa.Array, end_id: int | None) -> pa.Array:
        """The ids' bytes of each text, with ``end_id`` appended."""
        easy = [self.fast and SAFE.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts.to_pylist()]
        out = self._easy(texts if all(easy) else texts.filter(pa.array(easy)), end_id)
        if all(easy):
            return out
        end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        done = iter(out.to_pylist())
        return pa.array([next(done) if ok else np.array(self.tok.encode(t.as_py(), add_special_tokens=False).ids, self.dtype).tobytes() + end for ok, t in zip(easy, texts)], pa.binary())

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        easy = np.array([self.fast and SAFE.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts.to_pylist()], bool)
        out = np.zeros(len(texts), np.int64)
        offsets, codes, words = coded_words(pc.utf8_lower(texts.filter(pa.array(easy))))
        sizes = np.fromiter(map(self._count, words), np.int64, len(words))
        out[easy] = np.diff(np.append(0, np.cumsum(sizes[codes]))[offsets])
        for i in np.flatnonzero(~easy).tolist():
            out[i] = len(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids)
        return out

    def _count(self, word: str) -> int:
        """How many ids a word has; a word of letters alone is one piece."""
        get, total = self.counts.get, 0
        for p in (word,) if word.isalpha() else PIECE.findall(word):
            n = get(p)
            if n is None:
                if len(self.counts) >= 2 * self.size:
                    self.counts.clear()
                n = self.counts[p] = len(self.model.tokenize(p.translate(self.table)))
            total += n
        return total

    def _word(self, word: str) -> bytes:
        get, new = self.pieces.get, self._piece
        return b"".join([get(p) or new(p) for p in PIECE.findall(word)])

    def _easy(self, texts: pa.Array, end_id: int | None) -> pa.Array:
        offsets, codes, words = coded_words(pc.utf8_lower(texts))
        found = list(map(self._word, words))
        width = np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
        first = np.append(0, np.cumsum(sizes))[:-1]
        all_ids = np.frombuffer(b"".join(found), self.dtype)
        n = sizes[codes]
        ends = np.append(0, np.cumsum(n))
        ids = all_ids[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])] if len(codes) else all_ids
        bounds = ends[offsets]
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _write(path: str, end_id: int | None, folder: str):
    """Encodes rows (doc, text), which come in order, into files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part = TaskContext.get().partitionId()
        files: list[tuple[int, int, str, int, int]] = []
        out = None

        def close():
            if out is not None:
                out.close()
                files.append((part, len(files), out.uri, len(out.docs), out.n))

        for batch in sized(batches, 1):
            ids = enc.encode_all(pc.fill_null(batch.column(1), ""), end_id)
            for doc, one in zip(batch.column(0).to_pylist(), ids.to_pylist()):
                if out is None or out.n > FILE_IDS:
                    close()
                    out = FileWriter(f"{folder}/{part:06d}-{uuid.uuid4().hex}.bits", bits_for(enc.vocab), enc.vocab)
                out.add(doc, np.frombuffer(one, enc.dtype).astype(np.uint32))
        close()
        if files:
            yield pa.record_batch([pa.array([f[i] for f in files], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["bucket", "part", "path", "n_docs", "n_ids"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Encode and write all documents; returns the manifest: bucket, part,
    path, n_docs, n_ids, one row for each file, in the order of bucket and part."""
    spark = docs.sparkSession
    text = F.coalesce(valid_text(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text_bytes(text_col)).alias("th"), F.monotonically_increasing_id().alias("row"))
    size = input_bytes(docs)
    if size is None:  # not from files
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_RANGES, size // range_bytes + 1)
    order = (F.col("doc").asc_nulls_last(), "th", "row")
    parts = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc", "text")
    manifest = parts.mapInArrow(_write(tokenizer_path, end_id, folder or fresh(spark, "tokens")), "bucket int, part int, path string, n_docs long, n_ids long")
    return stored(manifest, "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            for doc, start, ids in FileReader(path).scan():
                rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) >= 10_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the CRC of
    the ids as 32-bit words, from the files."""
    before = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = int((manifest.agg(F.sum("n_ids")).first()[0] or 0) // READ_IDS + 1)
    # files that begin in the same stretch of ids are one group
    groups = files.repartitionById(n, (F.col("base") / READ_IDS).cast("int"))
    return groups.select("path", "base").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path))
