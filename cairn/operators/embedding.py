"""Embedders: plain functions from texts to vectors, run in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import EngineError
from .batches import parts

Embedder = Callable[[list[str]], list[list[float]]]


class HashingEmbedder:
    """Signed feature hashing of lower-cased words, of unit length."""

    _WORDS = re.compile(r"[^\W_]+")

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        words = [self._WORDS.findall(t.lower()) for t in texts]
        # each distinct word is hashed once
        code: dict[str, int] = {}
        codes = np.fromiter((code.setdefault(w, len(code)) for own in words for w in own), np.int64)
        h = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in code), np.uint64, len(code))
        at, sign = ((h >> np.uint64(1)) % np.uint64(self.dim)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0)
        row = np.repeat(np.arange(len(texts)), list(map(len, words)))
        out = np.bincount(row * self.dim + at[codes], weights=sign[codes], minlength=len(texts) * self.dim).reshape(len(texts), self.dim) if len(texts) else np.zeros((0, self.dim))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(n > 0, out / np.where(n > 0, n, 1.0), self.dim**-0.5).astype(np.float32).tolist()


class HttpEmbedder:
    """POSTs {"texts": [...]} and reads {"embeddings": [...]}."""

    def __init__(self, url: str, batch: int = 64, timeout: float = 300.0):
        self.url, self.batch, self.timeout = url, batch, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            data = json.dumps({"texts": texts[i : i + self.batch]}).encode()
            req = urllib.request.Request(self.url, data, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(req, timeout=self.timeout) as r:
                    out += json.loads(r.read())["embeddings"]
            except urllib.error.HTTPError as e:
                body = e.read().decode("utf-8", "replace")
                try:
                    body = json.loads(body)["detail"]
                except (ValueError, KeyError, TypeError):
                    pass
                raise EngineError(f"embedding server: {body}") from e
        return out


class CommandEmbedder:
    """Runs a command with {"texts": [...]} on its input; its output is the
    embeddings as JSON."""

    def __init__(self, command: list[str]):
        self.command = command

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import subprocess

        done = subprocess.run(self.command, input=json.dumps({"texts": texts}).encode(), capture_output=True)
        if done.returncode:
            raise EngineError(f"embedder failed: {done.stderr.decode('utf-8', 'replace')}")
        found = json.loads(done.stdout)
        return found["embeddings"] if isinstance(found, dict) else found


class NoEmbedder:
    def __call__(self, texts: list[str]) -> list[list[float]]:
        raise EngineError("no embedder is configured")


class ByteSumEmbedder:
    """For tests: each component follows from the sum of the text's bytes."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[((sum(t.encode()) % 2**32 + i + j) % 100) / 100 for j in range(self.dim)] for i, t in enumerate(texts)]


def embed_single(embedder: Embedder, text: str) -> list[float]:
    found = embedder([text])
    if not found:
        raise EngineError("embedder returned no vector")
    return found[0]


def embed_frame(docs: DataFrame, embedder: Embedder, *, text_col: str, one_by_one: bool = False) -> DataFrame:
    """``docs`` with embedding and error: rows of a failed batch (a part of some
    2 MB of texts) have no vector and the message."""
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            asked = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            groups = [[i] for i in asked] if one_by_one else [asked] if asked else []
            for g in groups:
                try:
                    for i, v in zip(g, embedder([texts[i] for i in g])):
                        vectors[i] = v
                except Exception as e:
                    for i in g:
                        errors[i] = str(e)
            yield pa.record_batch([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*batch.schema.names, "embedding", "error"])

    base = docs.drop("embedding", "error")
    return base.mapInArrow(run, _ddl(base) + ", embedding array<float>, error string").select(*[c for c in cols if c not in ("embedding", "error")], "embedding", "error")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
