"""Language identification by words first, then shorter and shorter n-grams.

The score of a known word in a language is the logarithm of its relative
frequency there. A word that no language knows falls back to its character
n-grams of length N; if none of them is known, to those of N - 1, and so on. A
text's score is the sum over its words, and the best language wins.

Word counts cover all training rows: tasks count in bounded tables, and counts
are summed by a shuffle. N-gram counts come from the word counts. The model
keeps the most frequent words and n-grams of each language, as many as
documented parameters say: MODEL_WORDS and MODEL_NGRAMS, or fewer where there
are so many languages that all of them would be more than MODEL_TERMS. What it
leaves out falls back like any unseen word; no language is left out. Terms are
kept as 64-bit hashes with an entry for each language that has them, at most
MODEL_ENTRIES, so that the broadcast takes 16 bytes an entry at any size.

Defined cases: a null text, or one without letters, is ``und`` with score 0,
as is every text where there are no training rows. A word of which no n-gram is
known (the space at its ends is none) says the same of all languages; a text of
such words alone ties. Null languages are never learned from. Ties go to the
language that is first by code point. Rows repeat as documents of their own.
Texts and words of any length count whole; bytes that are no UTF-8 are no
letters. Other columns are ignored or carried. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Neutral, coded_words, sized, stored, table, valid_text

MAX_NGRAM = 4
#: The model's bounds: terms of a language (n-grams: of each length), kept
#: (language, term) pairs, and pairs of kept terms with any language.
MODEL_WORDS = 20_000
MODEL_NGRAMS = 10_000
MODEL_TERMS = 2_000_000
MODEL_ENTRIES = 4_000_000
UNKNOWN = "und"
#: Length of the n-grams whose share tells whether a text is in a language, and
#: the part of a language's training n-grams that its typical ones make up.
SHARE_NGRAM, TYPICAL = 3, 0.9
#: Parts that a group of terms is ranked in first.
SALTS = 64
#: What is no letter; in RE2's terms, as Arrow runs it.
NO_LETTERS = r"[^\pL]+"


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-cased runs of letters: coded_words() of texts without the rest."""
    return coded_words(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), NO_LETTERS, " "))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each batch's words by language; the shuffle's map side sums them."""
    for batch in sized(batches, 1, 16 << 20):
        kinds, of = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
        offsets, codes, words = letter_words(batch.column(1))
        if not len(codes):
            continue
        at = np.repeat(of, np.diff(offsets)) * len(words) + codes
        n = np.bincount(at, minlength=len(kinds) * len(words))
        n.reshape(len(kinds), -1)[:, [i for i, w in enumerate(words) if not w]] = 0
        hit = np.flatnonzero(n)
        terms = pa.array(words, pa.string()).take(pa.array(hit % len(words)))
        yield pa.record_batch([pa.array(kinds.tolist()).take(pa.array(hit // len(words))), terms, pa.array(n[hit].astype(np.int64))], ["lang", "term", "n"])


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, each with a space at its ends, and the word of
    each character."""
    chars = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), np.uint32)
    return chars, np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams of distinct words by language. Four characters below
    U+10000 make one integer; words with others are counted as strings."""
    for batch in sized(batches, 1, 1 << 20):
        langs = batch.column(0).to_pylist()
        words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        found: Counter = Counter()
        wide = {i for i, w in enumerate(words) if not w.isascii() and max(w) > "\uffff"}
        for lang in set(langs):
            own = [i for i, x in enumerate(langs) if x == lang and i not in wide]
            chars, word = _padded([words[i] for i in own])
            c, weight = chars.astype(np.uint64), n[own]
            for k in range(1, MAX_NGRAM + 1):
                if len(c) < k:
                    break
                keys = np.zeros(len(c) - k + 1, np.uint64)
                for j in range(k):
                    keys = (keys << np.uint64(16)) | c[j : len(c) - k + 1 + j]
                inside = word[: len(word) - k + 1] == word[k - 1 :]
                if k == 1:
                    inside &= chars != 32  # the padding
                grams, back = np.unique(keys[inside], return_inverse=True)
                sums = np.bincount(back, weights=weight[word[: len(word) - k + 1][inside]])
                text = b"".join(int(g).to_bytes(2 * k, "big") for g in grams.tolist()).decode("utf-16-be", "surrogatepass")
                for i, total in enumerate(sums.astype(np.int64).tolist()):
                    found[lang, text[i * k : i * k + k]] += total
        for i in wide:
            for k in range(1, MAX_NGRAM + 1):
                for g in ngrams(words[i], k):
                    found[langs[i], g] += int(n[i])
        keys = list(found)
        yield pa.record_batch([pa.array([x for x, _ in keys], pa.string()), pa.array([g for _, g in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "term", "n"])


def ngrams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _top(counts: DataFrame, by: list[str], most: int) -> DataFrame:
    """The most frequent terms of each group with the group's total. A group is
    cut in SALTS parts first, so that no task ranks all of its terms."""
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    order = (F.col("n").desc(), "term")
    some = counts.withColumn("__s", salt).withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__s").orderBy(*order))).where(F.col("__r") <= most)
    best = some.drop("__s").withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= most)
    totals = F.broadcast(counts.groupBy(*by).agg(F.sum("n").alias("total")))
    return best.drop("__r").join(totals, by)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_keys(chars: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` characters in a row."""
    out = np.zeros(max(0, len(chars) - n + 1), np.uint64)
    for j in range(n):
        out = out * _MIX + chars[j : len(out) + j].astype(np.uint64) + np.uint64(1)
    return out


def grams_of(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all words as hashes, and the place of each one's word."""
    chars, word = _padded(words)
    keys = gram_keys(chars, n)
    inside = word[: len(keys)] == word[len(word) - len(keys) :]
    if n == 1:
        inside &= chars != 32
    return keys[inside], word[: len(keys)][inside]


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def _typical_key(gram: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return (gram ^ (gram >> np.uint64(29))) * _MIX + lang.astype(np.uint64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _spread(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of ``rows`` one after another, and their numbers."""
    n = starts[rows + 1] - starts[rows]
    ends = np.cumsum(n)
    return np.repeat(starts[rows] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0), n


def _pieces(words: list[str], which: np.ndarray, chars: int = 1_000_000) -> Iterator[np.ndarray]:
    """``which``, cut where the words have so many characters."""
    sizes = np.cumsum([len(words[i]) + 2 for i in which.tolist()]) // chars
    yield from np.split(which, np.flatnonzero(np.diff(sizes)) + 1)


class Model:
    """For words (kind 0) and n-grams of each length (kinds 1 to MAX_NGRAM): the
    sorted hashes of ``keys``, the first entry of each in ``starts``, and in
    ``lang`` and ``more`` its languages and how much its log frequency there is
    above ``low``, that of a term which the language lacks. ``typical`` has
    hashes of (n-gram, language) for n-grams typical of it, and ``level`` says
    what part of a language's training n-grams its typical ones make up."""

    def __init__(self, langs: list[str], keys: list, starts: list, lang: list, more: list, low: np.ndarray, typical: np.ndarray, level: np.ndarray):
        self.langs, self.keys, self.starts, self.lang, self.more = langs, keys, starts, lang, more
        self.low, self.typical, self.level = low, typical, level

    def __getstate__(self):
        return self.langs, self.keys, self.starts, self.lang, self.more, self.low, self.typical, self.level

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for own in (self.keys, self.starts, self.lang, self.more, [self.low, self.typical, self.level]) for x in own)

    def facts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The kind of each word's terms (-1: nothing is known of it), and its
        entries: first places, languages and values above ``low``."""
        n_lang = max(1, len(self.langs))
        kind = np.full(len(words), -1, np.int64)
        at, ok = _find(self.keys[0], word_keys(words))
        ok &= np.fromiter(map(bool, words), bool, len(words))
        known = np.flatnonzero(ok)
        kind[known] = 0
        flat, n = _spread(self.starts[0], at[known])
        parts = [(np.repeat(known, n), self.lang[0][flat], self.more[0][flat])]
        rest = np.array([i for i in np.flatnonzero(~ok).tolist() if words[i]], np.int64)
        for piece in _pieces(words, rest) if len(rest) else ():
            for k in range(MAX_NGRAM, 0, -1):
                if not len(piece):
                    break
                grams, of = grams_of([words[i] for i in piece.tolist()], k)
                at, ok = _find(self.keys[k], grams)
                at, of = at[ok], of[ok]
                hits = np.bincount(of, minlength=len(piece))
                flat, n = _spread(self.starts[k], at)
                pair, back = np.unique(np.repeat(of, n) * n_lang + self.lang[k][flat], return_inverse=True)
                value = np.bincount(back, weights=self.more[k][flat] / hits[np.repeat(of, n)], minlength=len(pair))
                parts.append((piece[pair // n_lang], pair % n_lang, value))
                kind[piece[hits > 0]] = k
                piece = piece[hits == 0]
        word, lang, value = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))
        return kind, starts, lang[order].astype(np.int64), value[order]

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The best language of each text (-1: none) and its score; and what
        letter_words() says of the texts."""
        offsets, codes, words = letter_words(texts)
        n_lang, best, score = len(self.langs), np.full(len(texts), -1, np.int64), np.zeros(len(texts))
        if n_lang and len(codes):
            kind, starts, lang, value = self.facts(words)
            real = np.fromiter(map(bool, words), bool, len(words))
            step = max(1, 2_000_000 // n_lang)
            for a in range(0, len(texts), step):
                b = min(a + step, len(texts))
                own = codes[offsets[a] : offsets[b]]
                doc = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                k = kind[own]
                of_kind = np.bincount((doc * (MAX_NGRAM + 1) + k)[k >= 0], minlength=(b - a) * (MAX_NGRAM + 1)).reshape(b - a, -1)
                total = (of_kind @ self.low).ravel()
                for i in range(0, len(own), 500_000):
                    flat, n = _spread(starts, own[i : i + 500_000])
                    total += np.bincount(np.repeat(doc[i : i + 500_000], n) * n_lang + lang[flat], weights=value[flat], minlength=len(total))
                total = total.reshape(b - a, n_lang)
                first = total.argmax(axis=1)
                found = 1 / np.exp(total - total[np.arange(b - a), first][:, None]).sum(axis=1)
                has = np.bincount(doc[real[own]], minlength=b - a) > 0
                best[a:b], score[a:b] = np.where(has, first, -1), np.where(has, found, 0.0)
        return best, score, (offsets, codes, words)

    def shares(self, said: tuple, lang: np.ndarray) -> np.ndarray:
        """Each text's share of n-grams typical of its language ``lang``, as a
        part of what training texts have: about 1 for the language, whatever
        the length. Takes what judge() says of the texts."""
        offsets, codes, words = said
        doc, n_lang = np.repeat(np.arange(len(lang)), np.diff(offsets)), len(self.langs)
        pair, back = np.unique(codes * n_lang + lang[doc], return_inverse=True)
        hits, sizes = np.zeros(len(pair)), np.fromiter((len(words[i]) + 3 - SHARE_NGRAM if words[i] else 0 for i in (pair // n_lang).tolist()), np.float64, len(pair))
        some = [words[i] for i in (pair // n_lang).tolist()]
        real = np.flatnonzero(sizes > 0)
        for piece in _pieces(some, real) if len(real) else ():
            grams, of = grams_of([some[i] for i in piece.tolist()], SHARE_NGRAM)
            _, ok = _find(self.typical, _typical_key(grams, (pair % n_lang)[piece][of]))
            hits[piece] = np.bincount(of, weights=ok, minlength=len(piece))
        found = np.bincount(doc, weights=hits[back], minlength=len(lang))
        return found / np.maximum(np.bincount(doc, weights=sizes[back], minlength=len(lang)), 1) / self.level[lang]


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms as hashes."""
    for batch in batches:
        terms, kind = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        keys = np.zeros(len(terms), np.uint64)
        for k in set(kind.tolist()):
            own = np.flatnonzero(kind == k)
            some = [terms[i] for i in own.tolist()]
            keys[own] = word_keys(some) if k == 0 else gram_keys(np.frombuffer("".join(some).encode("utf-32-le"), np.uint32), k)[::k]
        yield pa.record_batch([pa.array(keys.view(np.int64)), *batch.columns[1:]], ["key", *batch.schema.names[1:]])


def _table(found: pa.Table, langs: list[str]) -> Model:
    """The model of rows (key, kind, lang, n, total), in any order. A language
    that lacks a term gets the logarithm of half a count."""
    key, kind, lang, n, total = (found[c].to_numpy() for c in ("key", "kind", "lang", "n", "total"))
    key = key.view(np.uint64)
    low = np.full((MAX_NGRAM + 1, len(langs)), -np.log(2.0))
    low[kind, lang] = -np.log(2.0 * total)
    keys, starts, of, more = [], [], [], []
    for k in range(MAX_NGRAM + 1):
        own = np.flatnonzero(kind == k)
        own = own[np.lexsort((lang[own], key[own]))]
        first = np.flatnonzero(np.append(True, np.diff(key[own]) != 0)) if len(own) else np.zeros(0, np.int64)
        keys.append(key[own][first])
        starts.append(np.append(first, len(own)))
        of.append(lang[own].astype(np.int32))
        more.append(np.log(n[own] / total[own]) - low[k, lang[own]])
    # the most frequent n-grams of a language, until they are TYPICAL of all
    level, typical = np.ones(len(langs)), []
    own = np.flatnonzero(kind == SHARE_NGRAM)
    own = own[np.lexsort((key[own], -n[own], lang[own]))]
    ends = np.searchsorted(lang[own], np.arange(len(langs) + 1))
    for j in range(len(langs)):
        some = own[ends[j] : ends[j + 1]]
        mass = np.cumsum(n[some] / total[some])
        some = some[: int(np.searchsorted(mass, TYPICAL)) + 1]
        if len(some):
            level[j] = mass[len(some) - 1]
        typical.append(_typical_key(key[some], lang[some]))
    return Model(langs, keys, starts, of, more, low, np.sort(np.concatenate(typical)) if typical else np.zeros(0, np.uint64), level)


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", model_words: int = MODEL_WORDS, model_ngrams: int = MODEL_NGRAMS) -> Model:
    """Learn from all rows of ``train`` whose language isn't null."""
    rows = train.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), valid_text(text_col).alias("text"))
    counts = stored(rows.mapInArrow(_count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")), "words")
    grams = counts.mapInArrow(_gram_counts, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).withColumn("kind", F.length("term"))
    grams = stored(grams, "ngrams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    each = max(1, MODEL_TERMS // (MAX_NGRAM + 1) // max(1, len(langs)))
    model_words, model_ngrams = min(model_words, each), min(model_ngrams, each)
    names = F.broadcast(train.sparkSession.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, at int"))
    while True:
        best = _top(counts, ["lang"], model_words).select("term", F.lit(0).alias("kind"))
        # a kept term's counts in all languages
        kept = best.unionByName(_top(grams, ["lang", "kind"], model_ngrams).select("term", "kind")).distinct()
        w = counts.join(F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total"))), "lang").withColumn("kind", F.lit(0))
        g = grams.join(F.broadcast(grams.groupBy("lang", "kind").agg(F.sum("n").alias("total"))), ["lang", "kind"])
        found = stored(w.unionByName(g).join(kept, ["term", "kind"], "left_semi").join(names, "lang").select("term", "kind", F.col("at").alias("lang"), "n", "total"), "model")
        if model_words + model_ngrams <= 2 or found.count() <= MODEL_ENTRIES:
            break
        model_words, model_ngrams = -(-model_words // 2), -(-model_ngrams // 2)
    return _table(found.mapInArrow(_with_keys, "key long, kind int, lang int, n long, total long").toArrow(), langs)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.langs, UNKNOWN], pa.string())
        for batch in sized(batches, 1):
            best, score, _ = model.judge(batch.column(1))
            yield pa.record_batch([batch.column(0), names.take(pa.array(best % (len(model.langs) + 1))), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score: the probability of the language if all are
    equally frequent and words independent."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(id_col).cast("long").alias("id"), valid_text(text_col).alias("text")).mapInArrow(_predict(shared), "id long, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def _keep(shared, min_score: float, min_share: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sized(batches, width):
            best, score, said = model.judge(batch.column(width))
            known = (best >= 0) & (score >= min_score)
            if min_share > 0 and model.langs:
                known = known & (model.shares(said, np.maximum(best, 0)) >= min_share)
            yield batch.select(range(width)).filter(pa.array(known))

    return run


def keep_known(docs: DataFrame, model: Model, *, min_score: float = 0.0, min_share: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose language is known with a score of
    ``min_score`` at least, which goes to 1 as a text grows, and whose n-grams
    are typical of it to ``min_share`` of the training level, at any length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = Neutral(docs)
    rows = n.df.select("*", valid_text(n[text_col]).alias("valid_"))
    return n.restore(rows.mapInArrow(_keep(shared, min_score, min_share, len(n.cols)), n.df.schema))


def is_held_out(id_col: str) -> Column:
    """Whether the CRC of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~is_held_out("doc_id")).select("text", "lang"))
    return predict(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
