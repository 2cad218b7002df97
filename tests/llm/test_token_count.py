import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, normalizers

from cairn.llm import token_count as C

from .helpers import doc, frame, with_clashes

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["", " ", "  a  b ", "Hello world", "naïve café\n\nnext line", "日本語 текст 🙂🙂", "tab\tand\x00nul", "▁already", "<0x0A> <s>", "word " * 50, "a" * 2000, " \n "]


def library(vocab, byte_fallback):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_public_vocabulary(byte_fallback):
    vocab = C.load_vocab(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("abe tn\n.é漢🙂") for _ in range(r.randint(1, 60))) for _ in range(400)]
    t = library(vocab, byte_fallback)
    want = [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]
    assert C.Counter(vocab, byte_fallback).count_all(pa.array(texts, pa.string())).tolist() == want


def test_small_vocabularies_with_ties():
    r = random.Random(2)
    for _ in range(60):
        pieces = {"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))) for _ in range(12)} | {"▁"}
        vocab = [("<unk>", 0.0)] + [(p, float(-r.randint(0, 3))) for p in sorted(pieces)]
        t, c = library(vocab, False), C.Counter(vocab, False)
        texts = ["".join(r.choice("ab c") for _ in range(r.randint(1, 25))) for _ in range(40)]
        want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
        assert c.count_all(pa.array(texts)).tolist() == want


def test_frame(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r.n_tokens for r in C.token_counts(with_clashes(frame(spark, [doc(1, None), doc(2, ""), doc(3, "a b")])), path).collect()}
    assert got == {1: 0, 2: 0, 3: C.counter(path).count("▁a▁b")}
    assert C.token_counts(frame(spark, []), path).count() == 0


def test_many_words_at_a_time():
    """Vectors over words count as one word alone does, with ties and unknowns."""
    r = random.Random(9)
    for fallback in (True, False):
        vocab = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -1.5), ("abab", -4.0), ("bb", -3.0), ("é", -2.0), ("aaa", -2.5), ("x", -20.0), ("▁", -3.0), ("▁a", -2.0)]
        vocab += [(f"<0x{b:02X}>", -30.0) for b in range(256)] if fallback else []
        c = C.Counter(vocab, fallback)
        words = ["", "q", "▁", *["".join(r.choice("abéxq漢𝒜▁") for _ in range(r.randint(1, 30))) for _ in range(3000)]]
        assert c.count_many(words) == [c.count(w) for w in words]
    assert c.count_many([]) == []
