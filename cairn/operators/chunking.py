"""Chunkers: one document to its chunks, with byte offsets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parts

CHUNK_COLUMNS = "chunk_index long, text string, start_offset long, end_offset long"


def is_space(c: str) -> bool:
    """Unicode White_Space, which lacks the separators U+001C to U+001F."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


_SPACES = "".join(chr(i) for i in range(0x3001) if is_space(chr(i)))
_STOP, _GAP = re.compile(r"[.!?\n]"), re.compile(f"[{re.escape(_SPACES)}]*")


def _offsets(text: str) -> Callable[[int], int]:
    """Byte offset of a code point."""
    if text.isascii():
        return lambda i: i
    sizes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (sizes >= 0x80).astype(np.int64) + (sizes >= 0x800) + (sizes >= 0x10000)
    at = np.append(0, np.cumsum(width))
    return lambda i: int(at[i])


def noop_chunks(text: str) -> list[tuple[str, int, int]]:
    return [(text, 0, len(text.encode()))] if text else []


def fixed_chunks(text: str, size: int = 512, overlap: int = 50) -> list[tuple[str, int, int]]:
    """(text, start, end) of chunks of ``size`` code points, about: a chunk ends
    after the last white space in its last quarter, and the next begins
    ``overlap`` before its end."""
    n, at = len(text), _offsets(text)
    if n <= size:
        return [(text, 0, at(n))] if text else []
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        if end < n:
            for i in range(end, max(end - size // 4, start) - 1, -1):
                if is_space(text[i]):
                    end = i + 1
                    break
        piece = text[start:end]
        kept = piece.strip(_SPACES)
        if kept:
            lead = len(piece) - len(piece.lstrip(_SPACES))
            out.append((kept, at(start + lead), at(start + lead + len(kept))))
        done = end - start
        start += done - overlap if done > overlap else max(done, 1)
    return out


def sentences(text: str) -> list[tuple[str, int, int]]:
    """(trimmed text, start, end): cut after ! ? and line ends, and after a dot
    that white space or the end follows and no single letter precedes. Offsets
    are in code points, untrimmed."""
    out, start, i, n = [], 0, 0, len(text)
    while m := _STOP.search(text, i):
        i = m.start()
        if text[i] == ".":
            follows = i + 1 >= n or is_space(text[i + 1])
            single = i > 1 and _alphabetic(text[i - 1]) and not _alphabetic(text[i - 2])
            if not follows or single:
                i += 1
                continue
        kept = text[start : i + 1].strip(_SPACES)
        if kept:
            out.append((kept, start, i + 1))
        start = i = _GAP.match(text, i + 1).end()
    rest = text[start:].strip(_SPACES)
    if rest:
        out.append((rest, start, n))
    return out


def _alphabetic(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c) in ("Nl", "Mn", "Mc") and unicodedata.combining(c) == 0


def pack_sentences(text: str, parts: list[tuple[str, int, int]], similar: list[float], min_size: int, max_size: int, threshold: float) -> list[tuple[str, int, int]]:
    """Sentences to chunks: a cut where neighbours differ, if the chunk then
    has ``min_size`` to ``max_size`` bytes; what is left is cut by size."""
    size = [len(s.encode()) for s, _, _ in parts]
    total = np.append(0, np.cumsum(size))
    at = _offsets(text)

    def chunk(a: int, b: int) -> tuple[str, int, int]:
        s, e = parts[a][1], parts[b - 1][2]
        return text[s:e].strip(_SPACES), at(s), at(e)

    out, first = [], 0
    for i, value in enumerate(similar, 1):
        if value < threshold and min_size <= total[i] - total[first] <= max_size:
            out.append(chunk(first, i))
            first = i
    if first < len(parts) and total[-1] - total[first] > max_size:
        length = 0
        for i in range(first, len(parts)):
            length += size[i] + 1
            if length > max_size and i > first:
                out.append(chunk(first, i))
                first, length = i, size[i]
    if first < len(parts):
        out.append(chunk(first, len(parts)))
    return out


def _similarity(a: list[float], b: list[float]) -> float:
    x, y = np.asarray(a, np.float64), np.asarray(b, np.float64)
    if len(x) != len(y) or not len(x):
        return 0.0
    size = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(x @ y) / size if size else 0.0


def semantic_chunks(text: str, embed: Callable[[list[str]], list[list[float]]], min_size: int = 100, max_size: int = 1000, threshold: float = 0.5) -> list[tuple[str, int, int]]:
    """Chunks of sentences that belong together by their embeddings; the whole
    text if they can't be embedded."""
    whole = len(text.encode())
    if whole <= max_size:
        return [(text, 0, whole)] if text else []
    parts = sentences(text)
    if len(parts) <= 1:
        at = _offsets(text)
        return [(s, at(a), at(b)) for s, a, b in parts]
    try:
        vectors = embed([s for s, _, _ in parts])
    except Exception:  # an embedder's failure leaves the text whole
        return [(text, 0, whole)]
    similar = [_similarity(a, b) for a, b in zip(vectors, vectors[1:])]
    return pack_sentences(text, parts, similar, min_size, max_size, threshold)


def chunk_frame(docs: DataFrame, chunker: Callable[[str], list[tuple[str, int, int]]], *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """parent_id, chunk_index, text, start_offset, end_offset: row by row, with
    no shuffle. A null text has no chunks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            rows, ids = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = chunker(text) if text else []
                rows += [(k, *c) for k, c in enumerate(found)]
                ids += [i] * len(found)
            cols = [batch.column(0).take(pa.array(ids, pa.int64()))]
            cols += [pa.array([r[j] for r in rows], pa.string() if j == 1 else pa.int64()) for j in range(4)]
            yield pa.record_batch(cols, ["parent_id", "chunk_index", "text", "start_offset", "end_offset"])

    return docs.select(F.col(id_col).alias("parent_id"), F.col(text_col).alias("text")).mapInArrow(run, f"parent_id {kind}, {CHUNK_COLUMNS}")


def sentence_frame(docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """parent_id, chunk_index (of the sentence), text, start and end bytes."""

    def cut(text: str) -> list[tuple[str, int, int]]:
        at = _offsets(text)
        return [(s, at(a), at(b)) for s, a, b in sentences(text)]

    return chunk_frame(docs, cut, id_col=id_col, text_col=text_col)


def lookup_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live chunks of pairs (parent_id, chunk_index)."""
    live = chunks.where(~F.coalesce("deleted", F.lit(False)))
    return live.join(wanted.select("parent_id", "chunk_index").distinct(), ["parent_id", "chunk_index"])
