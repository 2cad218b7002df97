import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.llm import line_dedup as L

from .helpers import doc, frame, with_clashes


def brute(rows, min_docs, min_chars=1, keep_first=False):
    keys = lambda t: [x.strip(b" \t\n\x0b\x0c\r").lower() for x in (t or "").encode().split(b"\n")]
    count, first = Counter(), {}
    for i, t, *_ in rows:
        count.update({k for k in keys(t) if len(k.decode()) >= min_chars})
        for n, k in enumerate(keys(t)):
            if i is not None:
                first[k] = min(first.get(k, (i, n)), (i, n))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for n, (x, k) in enumerate(zip(lines, keys(t))) if count[k] < min_docs or (keep_first and i is not None and first.get(k) == (i, n))]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    pool = ["Common line", " common LINE\t", "é É", "", "  ", "x", "rare one", " ", "a" * 300]
    out = [doc(i, "\n".join(r.choice(pool + [f"own {i} {j}" for j in range(6)]) for j in range(r.randint(1, 9)))) for i in range(60)]
    return out + [doc(70, None), doc(71, ""), doc(None, "Common line\nnull id"), doc(3, out[3][1]), doc(72, "end\r\nx\n")]


@pytest.mark.parametrize("options", [{}, {"keep_first": True}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "keep_first": True}, {"min_chars": 3}, {"max_bits": 1 << 16}])
def test_against_brute_force(spark, rows, options):
    got = L.drop_repeated_lines(with_clashes(frame(spark, rows)), min_docs=4, **options).collect()
    want = brute(rows, 4, options.get("min_chars", 1), options.get("keep_first", False))
    assert sorted([tuple(r) for r in got], key=str) == want


def test_full_filter_and_flush(spark, rows, monkeypatch):
    """A filter that knows everything, and counts that are sent on at once."""
    monkeypatch.setattr(L, "repeat_filter", lambda *a: L.np.full(8192, 255, L.np.uint8))
    got = L.drop_repeated_lines(frame(spark, rows), min_docs=4).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 4)


def test_only_suspects_shuffle(spark):
    """Beyond the broadcast bound, lines found once aren't emitted."""
    rows = [doc(i, "\n".join(["the same line"] + [f"own {i} {j}" for j in range(50)])) for i in range(40)]
    texts = frame(spark, rows).selectExpr("cast(text as binary) text", "doc_id id", "0L h")
    bloom = spark.sparkContext.broadcast(L.repeat_filter(texts, 1, 1 << 29))
    out = texts.mapInArrow(L._emit(bloom, 1), "key binary, id long, h long, line long")
    assert 40 <= out.count() < 40 + 2040 // 50 and out.where("key = cast('the same line' AS binary)").count() == 40


def test_odd_bytes_long_texts_and_files(spark, tmp_path):
    """Bytes that are no UTF-8 stay; a table from files is sized by them."""
    path = str(tmp_path / "documents.parquet")
    d = frame(spark, [doc(i, "Same\n" + "x" * 300_000 + str(i)) for i in range(12)] + [doc(99, None)])
    d.withColumn("text", F.when(F.col("doc_id") == 3, F.expr("cast(concat(cast('same\n' AS binary), X'FFFE') AS string)")).otherwise(F.col("text"))).write.parquet(path)
    assert L.input_bytes(spark.read.parquet(path)) > 0
    got = {x.doc_id: x for x in L.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == 13 and got[3].kept_sha256 == hashlib.sha256(b"\xff\xfe").hexdigest()
    assert got[1].kept_sha256 == hashlib.sha256(b"x" * 300_000 + b"1").hexdigest() and (got[1].n_lines, got[1].n_dropped) == (2, 1)
    assert (got[99].n_lines, got[99].n_dropped) == (1, 0)
    kept = L.drop_repeated_lines(spark.read.parquet(path)).where("doc_id = 3").selectExpr("hex(cast(kept as binary)) h").first()
    assert kept.h == "FFFE"


def test_segments_merge():
    r = random.Random(2)
    bits = 1 << 22
    a, b = ([r.getrandbits(64) for _ in range(500)] for _ in range(2))
    both = a[:50]
    batches = []
    for h in (a, b + both):
        once = L._segments(L.np.array(h, L.np.uint64), bits)
        batches.append(L.pa.record_batch([L.pa.array(list(once), L.pa.int32()), L.pa.array(list(once.values()), L.pa.binary()), L.pa.array([None] * len(once), L.pa.binary())], ["seg", "once", "twice"]))
    bloom = L.np.zeros(bits // 8, L.np.uint8)
    for out in L._merge(iter(batches)):
        at = out.column(0)[0].as_py() * L.SEGMENT_BITS // 8
        piece = L.np.frombuffer(L.zlib.decompress(out.column(1)[0].as_py()), L.np.uint8)
        bloom[at : at + len(piece)] = piece
    at = L._positions(L.np.array(a, L.np.uint64), bits).astype(L.np.int64)
    hit = ((bloom[at >> 3] >> (at & 7).astype(L.np.uint8)) & 1).all(axis=1)
    assert hit[:50].all() and hit[50:].mean() < 0.05


def test_digest_and_empty(spark):
    got = L.drop_repeated_lines(frame(spark, [doc(1, "a\nb")]), digest=True).first()
    assert got.kept == hashlib.sha256(b"a\nb").hexdigest()
    assert L.drop_repeated_lines(frame(spark, [])).count() == 0
