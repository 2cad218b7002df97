import pytest

from cairn.operators import chunking as C


def check_offsets(text, chunks):
    raw = text.encode()
    for t, s, e in chunks:
        assert raw[s:e].decode() == t


def test_noop():
    assert C.noop_chunks("abc") == [("abc", 0, 3)] and C.noop_chunks("") == []


def test_fixed_small():
    assert C.fixed_chunks("Short text", 100, 10) == [("Short text", 0, 10)]
    got = C.fixed_chunks("Some words that are too long for one chunk of twenty.", 20, 5)
    assert len(got) > 1 and all(t for t, _, _ in got)


@pytest.mark.parametrize("text, size, overlap", [
    ("A brown fox leaps over some dogs. They run off quickly, and it rests.", 30, 10), ("word " * 60, 50, 10), ("日本語の長い文章をいくつかの部分に切り分けます。", 10, 2),
    ("One いち two 二つ mixed 文字 three", 15, 3), ("😀😁 😂🤣😃😄 😅😆😉😊 end", 10, 2), (" \n " * 40 + "x", 10, 2), ("a" * 95, 10, 20),
])
def test_fixed_offsets(text, size, overlap):
    got = C.fixed_chunks(text, size, overlap)
    check_offsets(text, got)
    for (_, _, e), (_, s, _) in zip(got, got[1:]):
        assert s <= e or not text.encode()[e:s].strip()


def embed(texts):
    known = [[1, 0, 0], [0.9, 0.1, 0], [0, 1, 0], [0.1, 0.9, 0]]
    return [known[i % 4] for i in range(len(texts))]


def test_semantic():
    text = "First one here. Second one here. Third topic now. Fourth topic now."
    got = C.semantic_chunks(text, embed, 5, 50, 0.7)
    assert len(got) >= 2
    check_offsets(text, got)
    assert C.semantic_chunks("Short text.", embed, 5, 50, 0.7) == [("Short text.", 0, 11)]
    assert C.semantic_chunks("", embed) == []

    def fails(texts):
        raise RuntimeError("no")

    assert C.semantic_chunks(text, fails, 5, 50, 0.7) == [(text, 0, len(text))]


def test_semantic_greedy_rest():
    text = " ".join(f"Sentence number {i} is here." for i in range(30))
    same = lambda ts: [[1.0, 0.0]] * len(ts)
    got = C.semantic_chunks(text, same, 10, 100, 0.5)
    assert all(len(t) <= 100 for t, _, _ in got) and " ".join(t for t, _, _ in got) == text


def test_sentences():
    cut = lambda t: [s for s, _, _ in C.sentences(t)]
    assert cut("Pi is 3.14. Next! Yes?\nLast") == ["Pi is 3.14.", "Next!", "Yes?", "Last"]
    assert cut("By J. Doe. End.") == ["By J. Doe.", "End."]
    assert cut("  ") == [] and cut("終わり。次") == ["終わり。次"]


def test_frame_handles_nulls(spark):
    d = spark.createDataFrame([("a", None), ("b", ""), ("c", "x y")], "id string, text string")
    rows = C.chunk_frame(d, C.fixed_chunks).collect()
    assert [(r.parent_id, r.text, r.end_offset) for r in rows] == [("c", "x y", 3)]
    assert C.chunk_frame(d.limit(0), C.fixed_chunks).count() == 0


def test_texts_go_to_python_functions_in_parts(spark):
    import pyarrow as pa

    from cairn.operators.batches import ROWS, TEXT_BYTES, parts
    from cairn.operators.embedding import embed_frame

    text = "x" * (TEXT_BYTES // 3)
    d = spark.createDataFrame([(i, text) for i in range(10)] + [(10, None), (11, text * 4)], "id long, text string").coalesce(1)
    seen = embed_frame(d, lambda some: [[float(sum(map(len, some)) <= TEXT_BYTES or len(some) == 1)] for _ in some], text_col="text").collect()
    assert sorted(r.id for r in seen) == list(range(12)) and {r.id: r.embedding for r in seen} == {i: None if i == 10 else [1.0] for i in range(12)}
    batch = pa.record_batch([pa.array(range(5 * ROWS // 2)), pa.array(["é", None] * (5 * ROWS // 4))], ["id", "text"])
    found = list(parts(iter([batch, batch.slice(0, 0)]), 1))
    assert [p.num_rows for p in found] == [ROWS, ROWS, ROWS // 2] and pa.Table.from_batches(found).equals(pa.Table.from_batches([batch]))
