import random
import zlib

import numpy as np
import pytest

from cairn.llm import token_file as T

from .helpers import doc, frame, with_clashes

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 20, 32])
def test_pack(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    data = T.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8) and (T.unpack(data, bits, 1003) == ids).all()


@pytest.mark.parametrize("vocab", [2, 1000, 49408, 100_000])
def test_file_round_trip(tmp_path, monkeypatch, vocab):
    monkeypatch.setattr(T, "BLOCK", 64)
    r = np.random.default_rng(1)
    docs = [(i if i != 5 else None, r.integers(0, vocab, n).astype(np.uint32)) for i, n in enumerate([0, 1, 63, 64, 65, 500, 0, 3])]
    w = T.FileWriter(f"file://{tmp_path}/x.bits", T.bits_for(vocab), vocab)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    f = T.FileReader(f"file://{tmp_path}/x.bits")
    got = list(f.scan())
    assert [d for d, _, _ in got] == [d for d, _ in docs] and f.vocab == vocab
    assert all((a == b).all() and len(a) == len(b) for (_, _, a), (_, b) in zip(got, docs))
    assert [s for _, s, _ in got] == np.append(0, np.cumsum([len(x) for _, x in docs]))[:-1].tolist()
    for i in (7, 2, 5):
        assert (f.doc(i) == docs[i][1]).all()
    (tmp_path / "bad").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        T.FileReader(f"file://{tmp_path}/bad")


def test_encoder_is_the_librarys():
    e = T.Encoder(PATH, cache=50)
    r = random.Random(1)
    chars = "".join(map(chr, [*range(9, 14), *range(32, 127), *range(0xA1, 0x100)]))
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["", "it's WE'LL 's", "a <|endoftext|> b", "x\x0by\x1cz\x85w\xa0e\xad", "Σας ΟΔΟΣ ﬁ हिन्दी 漢", "á İ"]
    for t in texts:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert e.count_all(T.pa.array(texts)).tolist() == [len(e.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    byte = T.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not byte.fast and np.frombuffer(byte.encode("Hello  x"), byte.dtype).tolist() == byte.tok.encode("Hello  x").ids


def test_files_of_a_table(spark, tmp_path):
    r = random.Random(2)
    rows = [doc(r.randrange(10**6), " ".join(r.choice(["one", "Two", "thréé", "漢", "x."]) for _ in range(r.randint(0, 40)))) for _ in range(200)]
    rows += [doc(-3, None), doc(0, ""), doc(None, "last"), rows[0], doc(rows[1][0], "same id, other text")]
    df = with_clashes(frame(spark, rows))
    manifest = T.write_token_files(df, PATH, folder=f"file://{tmp_path}/out", range_bytes=1500)
    assert manifest.count() > 2
    got = [tuple(x) for x in T.read_token_files(manifest).orderBy("start").collect()]
    e = T.encoder(PATH)
    want = []
    for i, t, *_ in rows:
        ids = e.tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((d, n, c) for d, _, n, c in got), key=str) == sorted(want, key=str)
    ids = [d for d, *_ in got]
    assert ids[-1] is None and ids[:-1] == sorted(ids[:-1])
    assert [s for _, s, _, _ in got] == np.append(0, np.cumsum([n for _, _, n, _ in got]))[:-1].tolist()
    assert T.read_token_files(T.write_token_files(frame(spark, []), PATH)).count() == 0


def test_hot_ids_are_split(spark, tmp_path):
    """Null ids, one id, and equal rows go over several ranges, in order."""
    rows = [doc(None, f"null {i % 7}") for i in range(200)] + [doc(5, f"text {i}") for i in range(200)] + [doc(9, "the same row")] * 300
    manifest = T.write_token_files(frame(spark, rows), PATH, folder=f"file://{tmp_path}/out", range_bytes=800)
    assert manifest.agg({"n_docs": "max"}).first()[0] < 300 and manifest.count() > 5
    got = T.read_token_files(manifest).orderBy("start").collect()
    ids = [x.doc_id for x in got]
    assert ids == [5] * 200 + [9] * 300 + [None] * 200
    assert [x.start for x in got] == np.append(0, np.cumsum([x.n_tokens for x in got]))[:-1].tolist()


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "READ_IDS", 50)
    rows = [doc(i, t) for i, t in enumerate(["One two", None, "", "x" * 100_000 + " end", "漢 字", "One two"])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = T.op4_token_files(spark, str(tmp_path))
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    at, e = 0, T.encoder(PATH)
    for x, (i, t, *_) in zip(got.orderBy("doc_id").collect(), rows):
        ids = e.tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(x) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_another_replacement_is_not_fast(tmp_path):
    """A tokenizer of the same shape that replaces something else goes to the library."""
    text = open(PATH).read().replace('"Regex":"\\\\s+"', '"Regex":"x"').replace('"Regex": "\\\\s+"', '"Regex": "x"')
    (tmp_path / "t.json").write_text(text)
    e = T.Encoder(str(tmp_path / "t.json"))
    assert not e.fast and np.frombuffer(e.encode("axb c"), e.dtype).tolist() == e.tok.encode("axb c").ids
