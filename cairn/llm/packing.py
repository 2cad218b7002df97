"""Conflict-constrained best-fit packing of documents into training sequences.

Documents longer than a sequence give full sequences and a rest. Items go in
decreasing size to the bin with the least room that holds them and doesn't
conflict: a bin has each duplicate cluster once at most and each source
``source_limit`` times. Bins lie in order of their room; a bitmask over rooms
finds the next roomier class, and the search goes on through the bins of each
class until one is compatible, or a new bin opens. Each bin carries a bitmap of
clusters, and one of sources for each time that a source may occur.

Items are spread by hash over shards of about ``shard_items``, packed on their
own: any number of documents packs in parallel, a hot source or cluster is
spread evenly, and what a shard loses is less than one open bin. The hash takes
an item's values and the count of it among equal items, so that partitions and
reruns don't change the result.

Defined cases: a document of size 0 (null or blank text) takes no room and no
bin: bin_id is null. A null source is a source of its own; a null cluster
conflicts with nothing. Repeated rows are items of their own. Texts of any
length are cut into full sequences; bytes that are no UTF-8 are U+FFFD to a
tokenizer. Items of equal size go by source, then
cluster and id; equal bins by age. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .base import Neutral, join_by_key, numbered, occurrences, sized, stored, table, text_bytes, valid_text, word_count
from .token_file import encoder

CAPACITY = 2048
SOURCE_LIMIT = 4
SHARD_ITEMS = 8192


def best_fit(items: list[tuple[int, object, object]], capacity: int, source_limit: int) -> list[tuple[int, int]]:
    """(bin, start) of each item (size, source, cluster), in the given order.

    Of bins with equal room the one opened first is taken."""
    often = {c for c, n in Counter(c for _, _, c in items if c is not None).items() if n > 1}
    cluster_bit: dict[object, int] = {}
    source_bit: dict[object, int] = {}
    rooms: dict[int, list[int]] = {}
    mask = 0
    clusters: list[int] = []
    sources: list[list[int]] = []
    room: list[int] = []
    out = []
    for size, source, cluster in items:
        c = cluster_bit.setdefault(cluster, 1 << len(cluster_bit)) if cluster in often else 0
        s = source_bit.setdefault(source, 1 << len(source_bit))
        left, chosen = mask >> size, -1
        while left and chosen < 0:
            r = size + (left & -left).bit_length() - 1
            for b in rooms[r]:
                if not clusters[b] & c and not sources[b][-1] & s:
                    chosen = b
                    break
            left &= left - 1
        if chosen < 0:
            chosen = len(room)
            room.append(capacity)
            clusters.append(0)
            sources.append([0] * source_limit)
        else:
            own = rooms[room[chosen]]
            own.remove(chosen)
            if not own:
                mask &= ~(1 << room[chosen])
        out.append((chosen, capacity - room[chosen]))
        room[chosen] -= size
        clusters[chosen] |= c
        planes = sources[chosen]
        for i in range(source_limit):
            if not planes[i] & s:
                planes[i] |= s
                break
        if room[chosen]:
            insort(rooms.setdefault(room[chosen], []), chosen)
            mask |= 1 << room[chosen]
    return out


def _pack(capacity: int, source_limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []  # a shard of bounded size
        for batch in batches:
            rows += list(zip(*(batch.column(i).to_pylist() for i in range(5))))
        if not rows:
            return
        by_shard: dict[int, list] = {}
        for r in rows:
            by_shard.setdefault(r[0], []).append(r[1:])
        for shard, own in by_shard.items():
            key = lambda r: (-(r[1] % capacity), r[1], r[2] is None, r[2] or "", r[3] is None, r[3] or 0, r[0] is None, r[0] or 0)
            own.sort(key=key)
            rest = [(size % capacity, source, cluster) for _, size, source, cluster in own if size % capacity]
            placed = iter(best_fit(rest, capacity, source_limit))
            out, n = [], len(rest)
            for doc, size, _, _ in own:
                for i in range(size // capacity):
                    out.append((doc, i, i * capacity, capacity, (shard << 32) + n, 0))
                    n += 1
                if size % capacity:
                    b, start = next(placed)
                    out.append((doc, size // capacity, size // capacity * capacity, size % capacity, (shard << 32) + b, start))
                elif size == 0:
                    out.append((doc, 0, 0, 0, None, 0))
            names = ["doc", "piece", "first", "n", "bin_id", "start"]
            for i in range(0, len(out), 50_000):
                yield pa.record_batch([pa.array([r[k] for r in out[i : i + 50_000]], pa.int64()) for k in range(6)], names)

    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Place the rows of ``items`` (doc, size, source, cluster): a row for each
    piece with doc, piece, first (unit of the document), n (units), bin_id and
    start (in the bin)."""
    known = ["doc", "size", "source", "cluster"]
    items = stored(numbered(items.select(F.col("doc").cast("long"), F.col("size").cast("long"), F.col("source").cast("string"), F.col("cluster").cast("long"))), "items")
    n = int(items.count() // shard_items + 1)
    items = occurrences(items, known)
    # a row's occurrence spreads repeated rows as well
    spread = F.pmod(F.xxhash64(*known, "occ"), F.lit(n)).cast("int")
    return items.select(spread.alias("shard"), "doc", "size", "source", "cluster").repartitionById(n, F.col("shard")).mapInArrow(_pack(capacity, source_limit), "doc long, piece long, first long, n long, bin_id long, start long")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Pack by words; documents of the same text are one duplicate cluster."""
    n = Neutral(docs)
    text = n[text_col]
    items = n.df.select(F.col(n[id_col]).alias("doc"), word_count(text).alias("size"), F.col(n[source_col]).alias("source"), F.xxhash64(text_bytes(text)).alias("cluster"))
    return _named(pack(items, **options), id_col, "word")


def _named(packed: DataFrame, id_col: str, unit: str) -> DataFrame:
    return packed.withColumnsRenamed({"doc": id_col, "first": f"first_{unit}", "n": f"n_{unit}s"})


def pack_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Pack by a tokenizer's ids; near-duplicates of one component (texts whose
    fingerprints link) are one duplicate cluster, named by its least fingerprint."""
    n = Neutral(docs)
    rows = n.df.select(F.col(n[id_col]).cast("long").alias("doc"), F.col(n[source_col]).cast("string").alias("source"), F.coalesce(valid_text(n[text_col]), F.lit("")).alias("text"))
    sig = stored(rows.mapInArrow(_measured(tokenizer_path), "doc long, source string, size long, fp long"), "fingerprints")
    fps = stored(sig.groupBy("fp").agg(F.count("*").alias("n")), "fps")
    roots = simhash.components(stored(simhash.links(fps), "links"))
    place = stored(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("cluster")), "clusters")
    items = join_by_key(sig, place, "fp", "n", sig.count()).select("doc", "size", "source", "cluster")
    return _named(pack(items, **options), id_col, "token")


def _measured(path: str):
    """Texts as their number of ids and their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in sized(batches, 2):
            fp = np.array([simhash.fingerprint(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.record_batch([*batch.columns[:2], pa.array(enc.count_all(batch.column(2))), pa.array(fp.view(np.int64))], ["doc", "source", "size", "fp"])

    return run


def op8_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack_tokens(table(spark, sf_dir, "documents"), tokenizer_path)
