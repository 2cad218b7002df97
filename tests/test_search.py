import datetime as dt

import numpy as np
import pytest

from cairn.errors import BadRequest
from cairn.operators import hybrid
from cairn.operators.bm25 import TextIndex
from cairn.operators.filters import SearchFilter
from cairn.operators.chunking import lookup_chunks
from cairn.operators.ingest import fill_embeddings
from cairn.operators.knn import IvfIndex, exact_knn, percentiles, recall_at_k
from cairn.operators.request import SearchRequest, validate


def hits(spark, texts, q):
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    qs = spark.createDataFrame([(0, q)], "qid long, text string")
    return [r.id for r in TextIndex.build(d).top_k(qs, 10).orderBy("rank").collect()]


def test_bm25_ranks(spark):
    docs = ["the quick brown fox", "the lazy dog", "the quick brown dog"]
    assert hits(spark, docs, "quick fox")[0] == 0
    assert hits(spark, docs, "") == [] and hits(spark, docs, "absent") == []
    rare = ["the common word", "the common phrase", "the rare unique word"]
    assert hits(spark, rare, "rare") == [2] and sorted(hits(spark, rare, "common")) == [0, 1]
    assert hits(spark, ["goodbye world"], "hello") == [] and hits(spark, [None, ""], "x") == []


def test_bm25_against_plain_python(spark):
    import math
    import random

    r = random.Random(5)
    docs = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 12))) for _ in range(40)]
    toks = [d.split() for d in docs]
    n, avg = sum(1 for t in toks if t), sum(map(len, toks)) / sum(1 for t in toks if t)
    want = {}
    for i, t in enumerate(toks):
        s = 0.0
        for term in ("a", "c", "h"):
            df = sum(term in x for x in toks)
            tf = t.count(term)
            s += math.log(1 + (0.5 + n - df) / (0.5 + df)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg)) if tf else 0
        if s:
            want[i] = s
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    got = TextIndex.build(d).scores(spark.createDataFrame([(1, "a c h a")], "qid long, text string")).collect()
    assert {x.id: pytest.approx(x.score) for x in got} == want


def test_scores_dont_leave_their_texts(spark, monkeypatch):
    """A common term's postings don't meet in one task, however many queries."""
    import random

    from cairn.operators import bm25

    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    monkeypatch.setattr(bm25, "SUMS", 20)
    r = random.Random(2)
    docs = [(str(i), " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9)))) for i in range(90)]
    asks = [(i, " ".join(r.choice("abcxyz") for _ in range(4))) for i in range(10)] + [(10, None), (11, "zz")]
    d, q = spark.createDataFrame(docs, "id string, text string").repartition(3), spark.createDataFrame(asks, "qid long, text string")
    found = TextIndex.build(d).scores(q)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    every = {(x.qid, x.id): round(x.score, 9) for x in found.collect()}
    share = {(i, k) for i, t in asks for k, text in docs if set((t or "").split()) & set(text.split())}
    assert set(every) == share
    top = {(x.qid, x.rank): (x.id, x.score) for x in TextIndex.build(d).top_k(q, 4).collect()}
    want = {}
    for i, _ in asks:
        own = sorted((-s, k) for (a, k), s in every.items() if a == i)[:4]
        want |= {(i, n): (k, pytest.approx(-s)) for n, (s, k) in enumerate(own, 1)}
    assert top == want


def test_knn(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, []), (6, [1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0])], "qid long, embedding array<float>")
    found = exact_knn(v, q, 2).orderBy("rank").collect()
    assert [(r.qid, r.id) for r in found] == [(9, 0), (9, 2)] and found[0].distance < 1e-3
    assert exact_knn(v, q, 0).count() == 0 and exact_knn(v.limit(0), q, 3).count() == 0


def test_knn_blocks_and_ties(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-1, 2, 4).astype(float).tolist()) for i in range(200)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    q = v.where("id % 20 = 0").withColumnRenamed("id", "qid")
    got = {(x.qid, x.rank): x.id for x in exact_knn(v, q, 7, query_block=3).collect()}
    a = np.array([x for _, x in rows])
    size = np.linalg.norm(a, axis=1)
    for i in range(0, 200, 20):
        if size[i]:
            ok = [j for j in range(200) if size[j]]
            order = sorted(ok, key=lambda j: (round(1 - a[i] @ a[j] / size[i] / size[j], 9), j))
            assert [got[i, k + 1] for k in range(7)] == order[:7]


def test_a_task_returns_k_of_a_query(spark, monkeypatch):
    import pyarrow as pa

    from cairn.operators import knn

    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    monkeypatch.setattr(knn, "TILE_QUERIES", 3)
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 4))
    v[100:200] = v[0]  # many ties
    q, unit = v[:8], v / np.linalg.norm(v, axis=1, keepdims=True)
    batches = lambda cells: [pa.record_batch([pa.array(map(str, range(i, i + 50))), pa.array(v[i : i + 50].tolist()), pa.array(np.arange(i, i + 50, dtype=np.int32) % cells)], ["id", "embedding", "cell"]) for i in range(0, 300, 50)]
    dist = np.round(1 - unit[:8] @ unit.T, 9)
    want = {(i, s) for i in range(8) for s in sorted(map(str, range(300)), key=lambda s: (dist[i, int(s)], s))[:5]}

    class Shared:
        value = (pa.array(range(8)), unit[:8])

    class Probed:
        value = (pa.array(range(8)), unit[:8], np.ones((300, 8), bool))

    for run in (knn._nearest(Shared, 5)(iter(batches(1))), knn._nearest_in_cells(Probed, 5)(iter(batches(300) + batches(7)))):
        got = [(a, b) for out in run for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert len(got) == 8 * 5 and set(got) == want


def test_ivf_recall_and_round_trip(spark, tmp_path):
    r = np.random.default_rng(1)
    v = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(300)], "id long, embedding array<float>")
    q = v.where("id % 30 = 0").withColumnRenamed("id", "qid")
    index, truth = IvfIndex.build(v), exact_knn(v, q, 10)
    assert recall_at_k(index.search(q, 10), truth, 10).first().recall >= 0.9
    index.save(str(tmp_path / "ivf"))
    again = IvfIndex.load(spark, str(tmp_path / "ivf")).search(q, 10, nprobe=len(index.centroids))
    assert recall_at_k(again, truth, 10).first().recall == 1.0


def records(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, embedding array<float>, title string, source string, tags array<string>, updated_at date")


def test_hybrid_formula(spark):
    rec = records(spark, [
        ("a", "red fox", [1.0, 0.0], None, "s", ["x"], None),
        ("b", "red dog", [0.6, 0.8], None, "t", [], None),
        ("c", "blue", [0.0, 1.0], None, None, None, None),
        ("d", "red red", None, None, "s", ["x"], None),
    ])
    q = spark.createDataFrame([(0, "red", [1.0, 0.0])], "qid long, text string, embedding array<float>")
    rows = {r.id: r for r in hybrid.search(rec, q, k=10, alpha=0.7).collect()}
    best = max(r.bm25_score for r in rows.values() if r.bm25_score is not None)
    assert rows["a"].hybrid_score == pytest.approx(0.7 + 0.3 * rows["a"].bm25_score / best)
    assert rows["b"].hybrid_score == pytest.approx(0.7 * 0.6 + 0.3 * rows["b"].bm25_score / best)
    assert rows["c"].hybrid_score == pytest.approx(0.0, abs=1e-9) and rows["c"].bm25_score is None
    assert rows["d"].distance is None and rows["d"].hybrid_score == pytest.approx(0.3 * rows["d"].bm25_score / best)
    f = SearchFilter(source="s")
    kept = {r.id: r.hybrid_score for r in hybrid.search(rec, q, k=10, filter=f).collect()}
    assert kept == {i: rows[i].hybrid_score for i in ("a", "d")}  # scales are those before the filter
    assert [r.type for r in hybrid.search(rec, q, k=1, alpha=1.0).collect()] == ["vector_only"]
    one = spark.createDataFrame([(0, None, [0.0, 1.0])], "qid long, text string, embedding array<float>")
    assert hybrid.search(rec.where("id = 'a'"), one).first().hybrid_score == pytest.approx(0.7 * 0.0)


def test_hybrid_over_chunks(spark):
    rec = records(spark, [("a", "x", None, None, None, [], None), ("b", "y", None, None, None, [], None)])
    chunks = spark.createDataFrame([("a", 0, "far", [0.0, 1.0], False), ("a", 1, "near", [1.0, 0.0], False), ("b", 0, "mid", [1.0, 1.0], False), ("b", 1, "gone", [1.0, 0.0], True), ("z", 0, "lost", [1.0, 0.0], False)], "parent_id string, chunk_index long, text string, embedding array<float>, deleted boolean")
    q = spark.createDataFrame([(0, None, [1.0, 0.0])], "qid long, text string, embedding array<float>")
    got = hybrid.search(rec, q, alpha=1.0, chunks=chunks).orderBy("rank").collect()
    assert [(r.id, r.best_chunk.chunk_index, r.best_chunk.text_preview) for r in got] == [("a", 1, "near"), ("b", 0, "mid")]


def _matches(spark, f, source="web", tags=("ai", "rust"), day=dt.date(2024, 6, 15)):
    d = spark.createDataFrame([(source, None if tags is None else list(tags), day)], "source string, tags array<string>, updated_at date")
    return d.where(f.column()).count() == 1


@pytest.mark.parametrize("f, row, want", [
    (SearchFilter(source="web"), {}, True), (SearchFilter(source="web"), {"source": None}, False), (SearchFilter(source="Web"), {}, False),
    (SearchFilter(mode="any", tags=(" AI ", "zz")), {}, True), (SearchFilter(mode="any", tags=("zz",)), {}, False), (SearchFilter(mode="any"), {"tags": None}, True),
    (SearchFilter(mode="all", tags=("ai", "rust")), {}, True), (SearchFilter(mode="all", tags=("ai", "zz")), {}, False), (SearchFilter(mode="all", tags=("ai",)), {"tags": None}, False),
    (SearchFilter(updated_at_gte=dt.date(2024, 6, 15)), {}, True), (SearchFilter(updated_at_lte=dt.date(2024, 6, 14)), {}, False), (SearchFilter(updated_at_gte=dt.date(2024, 1, 1)), {"day": None}, False),
    (SearchFilter("web", "any", ("ai",), dt.date(2024, 6, 1), dt.date(2024, 6, 30)), {}, True), (SearchFilter(mode="none", tags=("zz",)), {}, True), (SearchFilter(), {"source": None, "tags": None, "day": None}, True),
])
def test_filters(spark, f, row, want):
    assert _matches(spark, f, **row) is want


def test_filter_json():
    d = {"tags": ["b", " A"], "mode": "any", "source": "s", "updated_at_gte": "2024-01-02"}
    f = SearchFilter.from_dict(d)
    assert f.to_dict() == {"tags": ["a", "b"], "mode": "any", "source": "s", "updated_at_gte": "2024-01-02"}
    with pytest.raises(BadRequest, match="unknown tag filter mode"):
        SearchFilter.from_dict({"mode": "some"})
    with pytest.raises(BadRequest):
        SearchFilter.from_dict({"updated_at_lte": "2024-13-01"})


def test_requests():
    q = validate(SearchRequest(text=" hi "))
    assert (q.mode, q.alpha, q.text, q.k, q.ef, q.search_k, q.search_ef) == ("hybrid", 0.7, "hi", 5, 100, 100, 100)
    assert validate(SearchRequest(text="x", embedding=[1.0], alpha=0.0)).embedding is None
    assert validate(SearchRequest(embedding=[1.0], alpha=1.0, k=50)).search_k == 200
    for bad in (SearchRequest(), SearchRequest(text=" "), SearchRequest(text="x", embedding=[]), SearchRequest(embedding=[1.0], alpha=0.0), SearchRequest(text="x", alpha=1.5), SearchRequest(text="x", alpha=float("nan")), SearchRequest(text="x", k=-1)):
        with pytest.raises(BadRequest):
            validate(bad)


def test_small_helpers(spark):
    assert percentiles([float(i) for i in range(100)]) == [50.0, 95.0, 99.0] and percentiles([]) == [0.0] * 3
    rec = spark.createDataFrame([("a", [1.0]), ("b", []), ("c", [])], "id string, embedding array<float>")
    idx = spark.createDataFrame([("a", [9.0]), ("b", [2.0])], "id string, embedding array<float>")
    assert {r.id: r.embedding for r in fill_embeddings(rec, idx).collect()} == {"a": [1.0], "b": [2.0], "c": []}
    ch = spark.createDataFrame([("a", 0, False), ("a", 1, True)], "parent_id string, chunk_index long, deleted boolean")
    want = spark.createDataFrame([("a", 0), ("a", 1), ("a", 0)], "parent_id string, chunk_index long")
    assert lookup_chunks(ch, want).count() == 1
