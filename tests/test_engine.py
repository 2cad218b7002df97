import datetime as dt
import json
import threading
import urllib.request

import pytest

from cairn.config import ChunkConfig, Config
from cairn.engine import SearchEngine
from cairn.errors import BadRequest, Conflict, NotFound, StorageError
from cairn.http_api import handle, serve
from cairn.jobs import JobStore
from cairn.operators.compaction import TombstonePolicy
from cairn.operators.embedding import ByteSumEmbedder, HashingEmbedder
from cairn.operators.knn import IvfIndex
from cairn.schemas import STORED
from cairn.sources import oplog
from cairn.sources import store as S
from cairn.streaming import ingest_stream

NEVER = Config(tombstones=TombstonePolicy())


def ids(df):
    return sorted(r.id for r in df.collect())


def test_insert_sync_search(spark, tmp_path):
    e = SearchEngine.open(spark, str(tmp_path), NEVER, HashingEmbedder(16))
    bad = e.batch_insert([{"id": ""}, {"id": "   "}, {"id": "z", "updated_at": "soon"}])
    assert (bad["accepted"], bad["failed"]) == (0, 3) and bad["errors"][0] == {"id": "[index 0]", "error": "id is required"}
    got = e.batch_insert([{"id": "a", "title": "old"}, {"id": " a ", "title": "Red fox", "tags": [" X "], "updated_at": "2024-01-02"}, {"id": "b", "title": "Blue", "body": "whale"}, {"id": "n"}])
    assert got["accepted"] == 4 and ids(e.pending_ids()) == ["a", "b", "n"]
    assert e.search({"text": "fox", "alpha": 0.0}).count() == 0
    assert e.sync() == {"total": 3, "indexed": 3, "skipped": 0, "failed": 0}
    hit = e.search({"text": "fox", "alpha": 0.0}).collect()
    assert [(r.id, r.title, r.tags, r.type) for r in hit] == [("a", "Red fox", ["x"], "bm25_only")]
    assert e.search({"text": "whale"}).first().id == "b"
    assert e.search({"text": "whale", "filter": {"mode": "all", "tags": ["x"]}}).count() in (0, 1)
    # the same again is skipped, a change is indexed, an explicit text counts
    e.batch_insert([{"id": "a", "title": "Red fox", "tags": ["x"], "updated_at": "2024-01-02"}, {"id": "b", "title": "Green", "body": "whale"}])
    assert e.sync() == {"total": 2, "indexed": 1, "skipped": 1, "failed": 0}
    e.batch_insert([{"id": "a", "title": "Red fox", "tags": ["x"], "updated_at": "2024-01-02", "text": "zebra"}])
    assert e.sync()["indexed"] == 1 and e.search({"text": "zebra", "alpha": 0.0}).first().id == "a"
    e.check()
    # a second opening finds the same, and pending rows last
    e.batch_insert([{"id": "later", "title": "t"}])
    again = SearchEngine.open(spark, str(tmp_path), NEVER, HashingEmbedder(16))
    assert ids(again.live()) == ["a", "b", "n"] and ids(again.pending_ids()) == ["later"]
    assert again.delete(["b", "missing"]) == 1 and again.search({"text": "whale", "alpha": 0.0}).count() == 0
    again.compact()
    assert again.records().count() == 2 and again.log.count() == 0


def test_crash_before_records_are_written(spark, tmp_path):
    e = SearchEngine.open(spark, str(tmp_path), NEVER, HashingEmbedder(8))
    e.batch_insert([{"id": "x", "title": "one"}, {"id": "y", "title": "two"}])
    e.sync()
    new = e.records().where("id = 'x'").withColumn("title", S.F.lit("three"))
    e._log_sync(e.records(), new)  # and no new version of the records
    again = SearchEngine.open(spark, str(tmp_path), NEVER, HashingEmbedder(8))
    assert {r.id: r.title for r in again.live().collect()} == {"x": "three", "y": "two"}
    n = again.records().count()
    assert SearchEngine.open(spark, str(tmp_path), NEVER).records().count() == n


def test_failed_embedding_stays_pending(spark, tmp_path):
    def fails(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0]] * len(texts)

    e = SearchEngine.open(spark, str(tmp_path), NEVER, fails)
    e.batch_insert([{"id": "1", "title": "bad"}, {"id": "2", "title": "good"}])
    assert e.sync(one_by_one=True) == {"total": 2, "indexed": 1, "skipped": 0, "failed": 1}
    assert ids(e.pending_ids()) == ["1"] and ids(e.live()) == ["2"]


def test_chunked_engine(spark, tmp_path):
    e = SearchEngine.open(spark, str(tmp_path), NEVER, HashingEmbedder(8))
    e.batch_insert([{"id": "a", "body": "alpha beta gamma. " * 10}, {"id": "b", "body": "delta"}])
    e.sync()
    c = SearchEngine.open(spark, str(tmp_path), Config(chunks=ChunkConfig("fixed", 50, 10), tombstones=TombstonePolicy()), HashingEmbedder(8))
    assert c.chunks().where("parent_id = 'a'").count() > 1
    assert c.search({"text": "delta"}).first().id == "b"
    with pytest.raises(BadRequest, match="chunking"):
        c.batch_insert([{"id": "c"}])
    with pytest.raises(BadRequest, match="chunking"):
        c.sync()
    c.delete(["a"])
    assert c.chunks().where("NOT deleted").count() == 1
    c.check()


def test_numbers_follow_ids(spark):
    from cairn.operators.ingest import numbered

    ids_ = [f"k{i:03d}" for i in range(40)]
    got = numbered(spark.createDataFrame([(i,) for i in reversed(ids_)], "id string").repartition(5)).collect()
    assert {r.id: r.place for r in got} == {k: n for n, k in enumerate(ids_)}
    assert numbered(spark.createDataFrame([], "id string")).count() == 0


def test_policies():
    assert TombstonePolicy(max_count=2).due(10, 2) and not TombstonePolicy(max_count=2).due(10, 1)
    assert TombstonePolicy(max_ratio=0.3).due(10, 3) and not TombstonePolicy().due(10, 10)
    for bad in ({"max_count": 1, "max_ratio": 0.1}, {"max_ratio": 1.1}, {"max_ratio": float("nan")}):
        with pytest.raises(BadRequest):
            TombstonePolicy(**bad)
    R = oplog.RotationPolicy
    assert [R(max_records=2).due(0, 2), R(max_records=10).due(0, 2), R(max_bytes=5).due(5, 0), R(max_bytes=1005).due(5, 0), R(5, 10).due(5, 0), R().due(9, 9)] == [True, False, True, False, True, False]


def test_compaction_after_sync(spark, tmp_path):
    e = SearchEngine.open(spark, str(tmp_path), Config(tombstones=TombstonePolicy(max_count=1)), HashingEmbedder(8))
    e.batch_insert([{"id": "a", "title": "one"}])
    e.sync()
    e.batch_insert([{"id": "a", "title": "two"}])
    e.sync()
    assert e.records().count() == 1 and e.live().first().title == "two"


def op(kind, id, title=None):
    rec = {f.name: None for f in STORED.fields} | {"id": id, "title": title, "tags": ["t"], "embedding": [1.0, 2.0], "deleted": False, "indexed": True, "updated_at": dt.date(2024, 1, 2)}
    return {"op": "delete", "kind": None, "id": id, "record": None} if kind == "delete" else {"op": "write", "kind": kind, "id": id, "record": rec}


def frame(spark, ops):
    return spark.createDataFrame([(i, o["op"], o["kind"], o["id"], None if o["record"] is None else tuple(o["record"][f.name] for f in STORED.fields)) for i, o in enumerate(ops)], oplog.OPS)


def state(df):
    return sorted((r.id, r.title, r.deleted) for r in df.collect())


def test_fold(spark):
    empty = spark.createDataFrame([], STORED)
    log = [op("insert", "1", "a"), op("insert", "2", "b"), op("update", "1", "c"), op("delete", "2"), op("update", "3", "d"), op("append", "1", "no"), op("append", "2", "again")]
    got = oplog.fold(empty, frame(spark, log))
    assert state(got) == [("1", "c", False), ("2", "again", False), ("2", "b", True), ("3", "d", False)]
    base = spark.createDataFrame(got.collect(), STORED)
    assert state(oplog.fold(base, frame(spark, [op("insert", "1", "c")]))) == state(base)
    # compat: a delete marks the first row, marked or not
    first = oplog.fold(base.where("id = '2'"), frame(spark, [op("delete", "2")]), compat=True)
    assert len(state(first)) == 2
    simple = [op("insert", "1", "a"), op("delete", "1"), op("insert", "1", "b"), op("insert", "2", "c"), op("delete", "2")]
    last = oplog.last_state(frame(spark, simple)).select("id", "record.title", "deleted")
    assert sorted(map(tuple, last.collect())) == [("1", "b", False), ("2", "c", True)]


def test_reduced_log_replays_alike(spark):
    import random

    r = random.Random(1)
    log = [op(r.choice(["insert", "update", "append", "delete", "delete"]), r.choice("abcd"), str(i)) for i in range(120)]
    base = [op("insert", i, "base")["record"] | {"deleted": i == "b", "index_id": n} for n, i in enumerate("abx")]
    want = []
    for i in "abcdx":
        want += oplog.apply_ops([b for b in base if b["id"] == i], [o for o in log if o["id"] == i])
    records = spark.createDataFrame([tuple(b[f.name] for f in STORED.fields) for b in base], STORED)
    assert state(oplog.fold(records, frame(spark, log))) == sorted((w["id"], w["title"], w["deleted"]) for w in want)
    assert oplog.reduce_ops(frame(spark, [op("update", "a", str(i)) for i in range(50)])).count() == 1


def test_binary_log(spark, tmp_path):
    log = [op("insert", "é", "t"), op("append", "b", None), op("delete", "é")]
    data = oplog.encode_log(log)
    assert [(o["op"], o["kind"], o["id"]) for o in oplog.decode_log(data)] == [("write", "insert", "é"), ("write", "append", "b"), ("delete", None, "é")]
    assert next(iter(oplog.decode_log(data)))["record"]["updated_at"] == dt.date(2024, 1, 2)
    (tmp_path / "log").write_bytes(data)
    assert oplog.read_binary_log(spark, str(tmp_path / "log")).count() == 3
    assert oplog.read_binary_log(spark, str(tmp_path / "none")).count() == 0
    assert list(oplog.decode_log(b"")) == []
    for bad, why in ((b"XXXXXXXX" + data[8:], "magic"), (data[:-1], "ends within"), (data[:12] + b"\x07", "unknown log op"), (data[:12] + b"\1\x09", "unknown write kind"), (data[:8] + b"\x09\0\0\0", "version")):
        with pytest.raises(StorageError, match=why):
            list(oplog.decode_log(bad))
    for i in range(1, 5):
        with pytest.raises(StorageError, match=f"v{i}"):
            list(oplog.decode_log(b"CAIRNLG%d" % i))


def test_jsonl(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"id":"1","title":"t","tags":"A, b","updated_at":"2024-01-02"}\n\n{"id":"2","tags":["X"],"embedding":[1.5],"deleted":true}\n')
    rows = {r.id: r for r in S.read_records_jsonl(spark, str(p)).collect()}
    assert rows["1"].tags == ["a", "b"] and rows["1"].embedding == [] and rows["1"].indexed and rows["1"].updated_at == dt.date(2024, 1, 2)
    assert rows["2"].deleted and rows["2"].embedding == [1.5] and rows["2"].tags == ["x"]
    assert S.read_records_jsonl(spark, str(tmp_path / "no")).count() == 0
    S.write_jsonl(S.read_records_jsonl(spark, str(p)), str(tmp_path / "out"))
    assert S.read_records_jsonl(spark, str(tmp_path / "out")).count() == 2
    q = tmp_path / "p.jsonl"
    q.write_text('{"id":"1","record":{"id":"1","title":"a"},"content_hash":"h"}\n{"id":"1","record":{"id":"1","title":"b"},"content_hash":"i"}\n')
    got = S.read_pending_jsonl(spark, str(q)).collect()
    assert len(got) == 1 and got[0].record.title == "b"
    c = tmp_path / "c.jsonl"
    c.write_text('{"parent_id":"1","chunk_index":0,"text":"x","start_offset":0,"end_offset":1,"embedding":[1.0]}\n')
    assert S.read_chunks_jsonl(spark, str(c)).first().deleted is False
    (tmp_path / "x.csv").write_text('id,title,body,source,updated_at,tags\n1,"a ""q""",b,s,2024-01-02T03:04:05Z,A|b\n')
    r = S.read_csv(spark, str(tmp_path / "x.csv")).first()
    S.embed_csv(spark, str(tmp_path / "x.csv"), str(tmp_path / "csv-out"), HashingEmbedder(4))
    assert len(S.read_records_jsonl(spark, str(tmp_path / "csv-out")).first().embedding) == 4
    assert (r.title, r.tags, r.updated_at) == ('a "q"', ["a", "b"], dt.date(2024, 1, 2))


def test_jobs():
    jobs = JobStore()
    gate = threading.Event()
    job = jobs.run(lambda j: gate.wait(10))
    with pytest.raises(Conflict):
        jobs.create()
    with pytest.raises(NotFound):
        jobs.last()
    gate.set()
    for _ in range(100):
        if job.status != "processing":
            break
        threading.Event().wait(0.05)
    assert jobs.last().id == job.id

    def fails(j):
        raise RuntimeError("boom")

    assert jobs.run(fails, wait=True).status == {"failed": {"error": "boom"}} and jobs.last().id == job.id
    with pytest.raises(NotFound):
        jobs.get("none")


def test_config():
    c = Config.from_env({"CAIRN_WAL_ENABLED": "False", "CAIRN_CHUNK_TYPE": "Fixed", "CAIRN_CHUNK_SIZE": "x", "CAIRN_WAL_MAX_RECORDS": "7"})
    assert not c.log_enabled and c.chunks.kind == "fixed" and c.chunks.size == 512 and c.rotation.max_records == 7 and c.tombstones.max_ratio == 0.3
    assert Config.from_env({"CAIRN_CHUNK_TYPE": "odd"}).chunks.kind == "none"
    with pytest.raises(BadRequest):
        Config.from_env({"CAIRN_TOMBSTONE_MAX_COUNT": "1", "CAIRN_TOMBSTONE_MAX_RATIO": "0.1"})


def test_http(spark, tmp_path):
    e = SearchEngine.open(spark, str(tmp_path), NEVER, HashingEmbedder(8))
    lock = threading.Lock()
    call = lambda m, p, b=None: handle(e, lock, m, p, b"" if b is None else json.dumps(b).encode())
    assert call("GET", "/health") == (200, "ok")
    assert call("GET", "/ingestion/last")[0] == 404 and call("GET", "/ingestion/jobs/x")[0] == 404 and call("GET", "/no")[0] == 404
    assert call("POST", "/documents/batch", {"documents": [{"id": "1", "title": "fox"}]})[1]["accepted"] == 1
    assert call("POST", "/documents/batch", {})[0] == 400
    e.start_sync(wait=True)
    assert call("GET", "/ingestion/last")[1]["progress"]["indexed"] == 1
    status, found = call("POST", "/search", {"text": "fox", "alpha": 0.0})
    assert status == 200 and found["results"][0]["id"] == "1" and "distance" not in found["results"][0]
    assert call("POST", "/search", {"text": " "}) == (400, {"error": "text must not be empty"})
    server = serve(e, "127.0.0.1:0")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health") as r:
        assert r.read() == b"ok"
    server.shutdown()


def test_stream(spark, tmp_path):
    e = SearchEngine.open(spark, str(tmp_path / "e"), NEVER, ByteSumEmbedder())
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text('{"id":"a","title":"one"}\n{"id":"a","title":"two"}\n{"id":"b","title":"three"}\n')
    for _ in range(2):  # the second run finds nothing new
        q = ingest_stream.start(e, ingest_stream.read_landing(e, str(landing)), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert {r.id: r.title for r in e.live().collect()} == {"a": "two", "b": "three"}


def test_replay_queries_take_all_events(spark, tmp_path):
    import random

    from cairn.plans import catalog

    r = random.Random(8)
    events = [(i, r.choice(["purchase", "error", "error", "click"]), r.randrange(12), float(i), "{}") for i in range(150)]
    spark.createDataFrame(events, "event_id long, event_type string, user_id long, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    want = []
    for u in range(12):
        log = [{"op": "delete"} if t == "error" else {"op": "write", "kind": "append" if t == "purchase" else "update", "record": {"id": str(u), "value": v, "deleted": False}} for _, t, x, v, _ in events if x == u]
        want += [(w["id"], w["value"], w["deleted"]) for w in oplog.apply_ops([], log)]
    run = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    assert run("oplog_replay") == sorted(want) and len(want) > len({i for i, _, _ in want})
    gone = sum(d for _, _, d in want)
    assert run("tombstone_stats_replay") == [(len(want), gone, round(gone / len(want), 6))]
    assert run("compact_live_replay") == sorted((i, v) for i, v, d in want if not d)


@pytest.mark.parametrize("name", ["tombstone_stats_replay", "compact_live_replay", "oplog_replay"])
def test_replay_streams_over_one_reading_of_the_events(spark, tmp_path, name, capsys):
    """No Python group per id, and the log isn't computed again for its ids."""
    from cairn.plans import catalog

    spark.createDataFrame([(0, "click", 1, 1.0, "{}")], "event_id long, event_type string, user_id long, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    catalog.QUERIES[name](spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "MapInArrow" in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", ["compact_live_replay", "oplog_replay"])
def test_replay_hands_python_no_null_lists(spark, tmp_path, name, monkeypatch):
    """A batch of null lists, or of deletes, takes the square of its rows."""
    from cairn.plans import catalog

    events = [(i, t, u, float(i), "{}") for u in range(3) for i, t in enumerate(["click", "error", "error", "purchase"], 4 * u)]
    frame = spark.createDataFrame(events, "event_id long, event_type string, user_id long, value double, props string")
    frame.write.parquet(str(tmp_path / "events.parquet"))
    given = []
    real = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, *a, **k: given.append(self) or real(self, *a, **k))
    catalog.QUERIES[name](spark, str(tmp_path))
    assert len(given) == 1 and given[0].count() == 12
    assert given[0].where("record IS NULL OR record.tags IS NULL OR record.embedding IS NULL").count() == 0


@pytest.mark.parametrize("compat", [False, True])
def test_replay_keeps_null_and_empty_lists_apart(spark, compat):
    lists = [(None, None), ([], []), (["a", None], [1.0, None]), (None, []), ([], None), (["b"], [2.0])]
    log = [op("append" if n % 2 else "insert", f"new{n}") for n in range(6)]
    base = [op("insert", f"old{n}")["record"] for n in range(6)]
    for rows in ([o["record"] for o in log], base):
        for row, (tags, vector) in zip(rows, lists, strict=True):
            row |= {"tags": tags, "embedding": vector}
    want = [*base, *[o["record"] for o in log]]
    log += [op("delete", f"old{n}") for n in range(0, 6, 2)]
    log += [op("append", f"old{n}", "again") for n in (1, 3, 5)]  # active: changes nothing
    records = spark.createDataFrame([tuple(b[f.name] for f in STORED.fields) for b in base], STORED)
    got = sorted((r.id, r.tags, r.embedding, r.deleted) for r in oplog.fold(records, frame(spark, log), compat).collect())
    assert got == sorted((b["id"], b["tags"], b["embedding"], b["id"] in ("old0", "old2", "old4")) for b in want)


@pytest.mark.parametrize("compat", [False, True])
def test_replay_of_odd_rows_over_batches(spark, monkeypatch, compat):
    """Ids with several active rows, rows and writes that are deleted already or
    don't say, and ids whose ops lie in several Arrow batches, replay alike."""
    import random

    monkeypatch.setattr(oplog, "STRETCH", 7)
    r = random.Random(4)
    flag = lambda: r.choice([False, False, None, True])
    make = lambda n: [op(r.choice(["insert", "update", "append", "delete", "delete"]), r.choice("abcdefgh"), str(i)) for i in range(n)]
    log = [o if o["record"] is None else o | {"record": o["record"] | {"deleted": flag()}} for o in make(300)]
    base = [op("insert", r.choice("abcz"), f"base{n}")["record"] | {"deleted": flag(), "index_id": n} for n in range(16)]
    base += [op("insert", None, "no id")["record"] | {"index_id": 99}]
    want = [b for b in base if b["id"] in ("z", None)]
    for i in "abcdefgh":
        want += oplog.apply_ops([b for b in base if b["id"] == i], [o for o in log if o["id"] == i], compat)
    records = spark.createDataFrame([tuple(b[f.name] for f in STORED.fields) for b in base], STORED)
    key = lambda rows: sorted((str(x["id"]), x["title"], str(x["deleted"]), x["updated_at"], x["tags"], x["embedding"], str(x["index_id"])) for x in rows)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in (3, 10000):
            spark.conf.set(size, n)
            assert key(oplog.fold(records, frame(spark, log), compat).collect()) == key(want)
    finally:
        spark.conf.set(size, before)


def test_a_write_without_a_record_fails(spark):
    lost = op("insert", "a") | {"record": None}
    with pytest.raises(Exception, match="a write of the log has no record"):
        oplog.fold(spark.createDataFrame([], STORED), frame(spark, [lost])).collect()


def test_indexes_follow_the_records(spark, tmp_path):
    """Searches by the kept indexes are those over all live rows, after every
    kind of change, and after opening the folder again."""
    from cairn.operators import hybrid

    conf = Config(index_min_rows=4, tombstones=TombstonePolicy(max_ratio=1.0))
    e = SearchEngine.open(spark, str(tmp_path / "e"), conf)

    def same(ef=IvfIndex.FULL_EF):
        q = spark.createDataFrame([(0, "red fox", e.embedder(["red fox"])[0]), (1, "grey owl at night", e.embedder(["owl"])[0]), (2, None, e.embedder(["wolf"])[0])], "qid long, text string, embedding array<float>")
        version = e.records_table.version
        assert e.keywords.covers(version) and e.vectors.covers(version)
        got = e.search_batch(q, k=4, ef=ef).drop("index_id")
        want = hybrid.search(e.live(), q, k=4)
        key = lambda df: sorted((r.qid, r["rank"], r.id, round(r.hybrid_score, 6)) for r in df.collect())
        assert key(got) == key(want) and got.count() > 0
        e.check()

    e.batch_insert([{"id": str(i), "title": t, "body": f"note {i}"} for i, t in enumerate(["Red fox", "Grey owl", "Night owl", "Wolf and fox", "Red red wine", "A quiet night", "Owl"])])
    e.sync()
    same()
    segments = len(e.keywords.state()["segments"])
    e.batch_insert([{"id": "1", "title": "Red owl", "body": "changed"}, {"id": "20", "title": "New grey fox"}])
    e.sync()
    assert len(e.keywords.state()["segments"]) == segments + 1 and e.keywords.state()["gone"] and e.vectors.state()["gone"]
    same()
    assert e.delete(["0", "20"]) == 2
    same()
    e = SearchEngine.open(spark, str(tmp_path / "e"), conf)
    same()
    e.compact()
    assert len(e.keywords.state()["segments"]) == 1 and not e.keywords.state()["gone"]
    same()
    few = e.search({"text": "fox", "ef": 1, "k": 3}).collect()
    assert few and all(r.hybrid_score is not None for r in few)
    # a records version that the indexes don't know is searched without them
    e.records_table.write(e.records())
    assert not e.keywords.covers(e.records_table.version)
    assert {r.id for r in e.search({"text": "quiet", "alpha": 0.0}).collect()} == {"5"}
    e = SearchEngine.open(spark, str(tmp_path / "e"), conf)
    same()


def test_pending_writes_are_tried_again(spark, tmp_path, monkeypatch):
    e = SearchEngine.open(spark, str(tmp_path / "e"))
    e.batch_insert([{"id": "1", "title": "x"}])
    write, tries = e.pending_table.write, []

    def failing(df, *a, **k):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("full")
        return write(df, *a, **k)

    monkeypatch.setattr(e.pending_table, "write", failing)
    assert e.sync()["indexed"] == 1 and len(tries) == 3 and e.pending().count() == 0


def test_reduced_in_stretches(spark, monkeypatch):
    """Stretches of the log, reduced on their own first, replay alike."""
    import random

    monkeypatch.setattr(oplog, "STRETCH", 3)
    r = random.Random(5)
    log = [{"seq": i, "op": o, "kind": None if o == "delete" else k, "id": "a", "record": None} for i in range(60) for o, k in [(r.choice(["write", "delete"]), r.choice(["append", "insert", "update"]))]]
    ops = [{**x, "record": None if x["op"] == "delete" else {"id": "a", "title": str(x["seq"]), "deleted": False}} for x in log]
    frame_ = spark.createDataFrame([(x["seq"], x["op"], x["kind"], x["id"]) for x in ops], "seq long, op string, kind string, id string")
    left = {x.seq for x in oplog.reduce_ops(frame_).collect()}
    plain = lambda some: [(x["title"], x["deleted"]) for x in oplog.apply_ops([], some)]
    assert plain([x for x in ops if x["seq"] in left]) == plain(ops) and len(left) < 60


def test_all_errors_are_returned(spark, tmp_path):
    e = SearchEngine.open(spark, str(tmp_path / "e"))
    got = e.batch_insert([{"id": " "}] * 1500 + [{"id": "1", "title": "x"}])
    assert (got["accepted"], got["failed"], len(got["errors"])) == (1, 1500, 1500)


def test_progress_of_a_running_job(spark, tmp_path):
    e = SearchEngine.open(spark, str(tmp_path / "e"))
    e.batch_insert([{"id": "1", "title": "x"}, {"id": "2", "title": "y"}])
    heard = []
    e.sync(on_progress=lambda p: heard.append(dict(p)))
    assert heard[0] == {"total": 2} and heard[-1]["indexed"] == 2


def test_last_line_wins_over_files(spark, tmp_path):
    from cairn.sources import store

    (tmp_path / "p").mkdir()
    line = lambda i, t: json.dumps({"id": i, "record": {"id": i, "title": t}, "content_hash": t}) + "\n"
    (tmp_path / "p" / "a.jsonl").write_text(line("1", "old") * 3000 + line("2", "two"))
    (tmp_path / "p" / "b.jsonl").write_text(line("1", "new"))
    got = {r.id: r.content_hash for r in store.read_pending_jsonl(spark, str(tmp_path / "p")).collect()}
    assert got == {"1": "new", "2": "two"}
