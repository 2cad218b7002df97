"""Settings, from the environment or given."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from .errors import BadRequest
from .operators.chunking import fixed_chunks, semantic_chunks
from .operators.compaction import TombstonePolicy
from .operators.embedding import CommandEmbedder, Embedder, HashingEmbedder, HttpEmbedder
from .sources.oplog import RotationPolicy

PREFIX = "CAIRN_"


def _number(env: Mapping[str, str], name: str, kind: type, default=None):
    """The value, or the default where it is unset or no number."""
    try:
        v = kind(env[PREFIX + name])
    except (KeyError, ValueError):
        return default
    return default if kind is int and v < 0 else v


@dataclass(frozen=True)
class ChunkConfig:
    kind: str = "none"
    size: int = 512
    overlap: int = 50
    min_size: int = 100
    max_size: int = 1000
    threshold: float = 0.5

    def chunker(self, embedder: Embedder) -> Callable | None:
        if self.kind == "fixed":
            size, overlap = self.size, self.overlap
            return lambda t: fixed_chunks(t, size, overlap)
        if self.kind == "semantic":
            a, b, c = self.min_size, self.max_size, self.threshold
            return lambda t: semantic_chunks(t, embedder, a, b, c)
        return None


@dataclass(frozen=True)
class Config:
    addr: str = "127.0.0.1:8080"
    embed_url: str | None = None
    embed_command: tuple[str, ...] | None = None
    log_enabled: bool = True
    rotation: RotationPolicy = field(default_factory=RotationPolicy)
    tombstones: TombstonePolicy = field(default_factory=lambda: TombstonePolicy(max_ratio=0.3))
    chunks: ChunkConfig = field(default_factory=ChunkConfig)
    default_k: int = 5
    default_ef: int = 100
    allow_batch_with_chunks: bool = False
    #: Keep a vector index from so many rows on; fewer are searched exactly.
    vector_index: bool = True
    index_min_rows: int = 10_000

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Config:
        get = lambda n, d=None: env.get(PREFIX + n, d)
        count, ratio = _number(env, "TOMBSTONE_MAX_COUNT", int), _number(env, "TOMBSTONE_MAX_RATIO", float)
        if count is not None and ratio is not None:
            raise BadRequest(f"{PREFIX}TOMBSTONE_MAX_COUNT and {PREFIX}TOMBSTONE_MAX_RATIO exclude each other: give one")
        kind = get("CHUNK_TYPE", "none").lower()
        return cls(
            addr=get("ADDR", cls.addr),
            embed_url=get("EMBED_URL"),
            embed_command=(get("PYTHON", "python3"), "-m", "embed_text", "--model", get("MODEL")) if get("MODEL") else None,
            log_enabled=get("WAL_ENABLED", "1").lower() not in ("0", "false"),
            rotation=RotationPolicy(_number(env, "WAL_MAX_BYTES", int), _number(env, "WAL_MAX_RECORDS", int)),
            tombstones=TombstonePolicy(count, ratio if ratio is not None or count is not None else 0.3),
            vector_index=get("VECTOR_INDEX", "1").lower() not in ("0", "false"),
            index_min_rows=_number(env, "INDEX_MIN_ROWS", int, 10_000),
            chunks=ChunkConfig(
                kind if kind in ("fixed", "semantic") else "none",
                _number(env, "CHUNK_SIZE", int, 512), _number(env, "CHUNK_OVERLAP", int, 50),
                _number(env, "CHUNK_MIN_SIZE", int, 100), _number(env, "CHUNK_MAX_SIZE", int, 1000),
                _number(env, "CHUNK_THRESHOLD", float, 0.5),
            ),
        )

    def embedder(self) -> Embedder:
        if self.embed_url:
            return HttpEmbedder(self.embed_url)
        return CommandEmbedder(list(self.embed_command)) if self.embed_command else HashingEmbedder()
