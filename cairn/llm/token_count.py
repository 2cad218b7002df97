"""Token counts of a unigram tokenizer, without its tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each
character. Dynamic programming over the ends carries two numbers for the best
path: its score and its count of pieces. The rules are those of the tokenizers
library's Unigram model: of paths that score alike, the one whose last piece
starts first stays; a character that no piece covers alone may be unknown, at
the least score less 10; runs of unknown characters are one token, or one for
each UTF-8 byte where the vocabulary has all bytes.

Where no piece goes on past a word's end, words are independent, and each
distinct word is counted once in a batch; where unknown characters are bytes,
words are cut as well between characters that no piece has side by side. Words
are counted many at a time: one run of the automaton over all of them, and dynamic programming by character
place, in vectors over the words.

Defined cases: a null or empty text has 0 tokens; bytes that are no UTF-8 are
U+FFFD. Texts and words of any length are counted whole. Paths that score alike
go as said above. Rows repeat as documents of their own. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import sized, table, valid_text

SPACE = "▁"
UNK_PENALTY = 10.0
CACHE = 300_000
#: Words counted at a time, and the longest of them; longer ones go one by one.
WORDS, LONGEST = 20_000, 80


class Counter:
    """Counts pieces of normalised texts: spaces are ``SPACE``, and one leads."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        self.auto = ahocorasick.Automaton()
        for i, (piece, _) in enumerate(vocab):
            if piece:
                self.auto.add_word(piece, i)
        self.auto.make_automaton()
        pieces = {p for p, _ in vocab}
        self.sizes, self.scores = np.array([len(p) for p, _ in vocab]), np.array([float(s) for _, s in vocab])
        self.facts = list(zip(self.sizes.tolist(), self.scores.tolist()))
        #: a character in no piece, which ends all matches
        self.end = next(c for c in map(chr, range(0xE000, 0xF900)) if not any(c in p for p in pieces))
        self.unk = min(s for _, s in vocab) - UNK_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        inner = [p for p in pieces if SPACE in p.lstrip(SPACE)]
        self.by_word = not inner and SPACE in pieces and all(float(s).is_integer() for _, s in vocab)
        # unknown characters are bytes of their own, so parts that no piece joins are independent
        self.by_part = self.by_word and self.bytes
        self.pairs = np.unique([-1, *((ord(a) << 21) | ord(b) for p in pieces for a, b in zip(p, p[1:]))])
        self.cache: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Pieces of one normalised text."""
        n = len(text)
        if not n:
            return 0
        matches = self.auto.iter(text)
        match = next(matches, None)
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            best, at, single, here = None, -1, False, []
            while match is not None and match[0] == e - 1:
                here.append(self.facts[match[1]])
                match = next(matches, None)
            for size, s in sorted(here, reverse=True):  # the longest starts first
                single |= size == 1
                if best is None or s + score[e - size] > best:
                    best, at = s + score[e - size], e - size
            is_unknown = False
            if not single and (best is None or self.unk + score[e - 1] > best):
                best, at, is_unknown = self.unk + score[e - 1], e - 1, True
            score[e], unknown[e] = best, is_unknown
            if not is_unknown:
                pieces[e] = pieces[at] + 1
            elif self.bytes:
                pieces[e] = pieces[at] + len(text[e - 1].encode())
            else:
                pieces[e] = pieces[at] + (not unknown[at])
        return pieces[n]

    def count_many(self, words: list[str]) -> list[int]:
        """count() of each of many short words."""
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(size + 1) - size - 1  # places: one more than characters for each word
        text = self.end.join(words)
        chars = np.frombuffer((text + self.end).encode("utf-32-le"), np.uint32)
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        found = np.fromiter(chain.from_iterable(self.auto.iter(text)), np.int64).reshape(-1, 2)
        word = np.repeat(np.arange(n), size + 1)[found[:, 0]]
        length, gain = self.sizes[found[:, 1]], self.scores[found[:, 1]]
        place = found[:, 0] - base[word] + 1
        order = np.lexsort((-length, word, place))  # of a place and word, the longest starts first
        word, length, gain, place = word[order], length[order], gain[order], place[order]
        score, pieces, unknown, single = (np.zeros(len(chars), t) for t in (np.float64, np.int64, bool, bool))
        single[(base[word] + place)[length == 1]] = True
        by_size = np.argsort(-size, kind="stable")
        most = int(size.max(initial=0))
        longer = np.searchsorted(-size[by_size], -np.arange(1, most + 1), side="right")
        cuts = np.searchsorted(place, np.arange(1, most + 2))
        best, at = np.full(n, -np.inf), np.zeros(n, np.int64)
        for e in range(1, most + 1):
            own = by_size[: longer[e - 1]]
            here = base[own] + e
            best[own] = -np.inf
            a, b = cuts[e - 1], cuts[e]
            if b > a:
                w = word[a:b]
                start = base[w] + e - length[a:b]
                total = gain[a:b] + score[start]
                first = np.flatnonzero(np.diff(w, prepend=-1))
                top = np.maximum.reduceat(total, first)
                hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(first, b - a))))
                hit = hit[np.diff(w[hit], prepend=-1) != 0]
                best[w[hit]], at[w[hit]] = top, start[hit]
            alone = score[here - 1] + self.unk
            out = ~single[here] & (alone > best[own])
            score[here], unknown[here] = np.where(out, alone, best[own]), out
            step = width[here - 1] if self.bytes else (~unknown[here - 1]).astype(np.int64)
            pieces[here] = np.where(out, pieces[here - 1] + step, pieces[at[own]] + 1)
        return pieces[base + size].tolist()

    def learn(self, parts: list[str]) -> None:
        """Have the counts of distinct parts in the cache."""
        new = [p for p in parts if p not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = parts
        short = [p for p in new if len(p) <= LONGEST and self.end not in p]
        for i in range(0, len(short), WORDS):
            some = short[i : i + WORDS]
            self.cache.update(zip(some, self.count_many(some)))
        if len(short) < len(new):
            self.cache.update((p, self.count(p)) for p in new if len(p) > LONGEST or self.end in p)

    def _parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The words with a space before each, cut between characters that no
        piece has side by side, and the first part of each word."""
        text = SPACE + SPACE.join(words)
        first = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = np.append(0, first[:-1])
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = (chars[:-1] << 21) | chars[1:]
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        cut = np.append(True, self.pairs[at] != pairs)
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(text)).tolist()
        return [text[a:b] for a, b in zip(starts.tolist(), ends)], np.searchsorted(starts, first)

    def _words(self, words: list[str]) -> np.ndarray:
        """Of each word with the space before it."""
        if not words:
            return np.zeros(0, np.int64)
        parts, first = self._parts(words) if self.by_part else ([SPACE + w for w in words], np.arange(len(words)))
        self.learn(list(dict.fromkeys(parts)))
        return np.add.reduceat(np.fromiter(map(self.cache.__getitem__, parts), np.int64, len(parts)), first)

    def _cached(self, part: str) -> int:
        got = self.cache.get(part)
        if got is None:
            got = self.cache[part] = self.count(part)
        return got

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        raw = texts.to_pylist()
        if not self.by_word:
            return np.array([self.count(SPACE + t.replace(" ", SPACE)) if t else 0 for t in raw], np.int64)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
        n = self._words(words.dictionary.to_pylist())
        total = np.append(0, np.cumsum(n[words.indices.to_numpy()]))
        out = np.diff(total[offsets - offsets[0]])
        for i, t in enumerate(raw):
            if not t:
                out[i] = 0
            elif "  " in t or t[0] == " " or t[-1] == " ":  # runs of spaces may be pieces
                out[i] = self._runs(SPACE + t.replace(" ", SPACE))
        return out

    def _runs(self, text: str) -> int:
        """Word by word, with runs of spaces before each."""
        out, i, n = 0, 0, len(text)
        while i < n:
            j = i
            while j < n and text[j] == SPACE:
                j += 1
            k = text.find(SPACE, j)
            k = n if k < 0 else k
            out += self._cached(text[i:k])
            i = k
        return out


def load_vocab(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(load_vocab(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocab_path)
        for batch in sized(batches, 1):
            yield pa.record_batch([batch.column(0), pa.array(c.count_all(pc.fill_null(batch.column(1), "")), pa.int64())], ["id", "n_tokens"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), valid_text(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    if vocab_path is None:
        import public_tokenizers

        vocab_path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), vocab_path)
