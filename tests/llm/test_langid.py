import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import langid as L
from cairn.llm import stages

from .helpers import doc, frame, with_clashes, words


def runs(t):
    return [w for w in re.findall(r"[^\W\d_]+", (t or "").lower())]


def brute(train, texts, most_words, most_grams):
    wc, gc = defaultdict(Counter), defaultdict(Counter)
    for t, lang in train:
        if lang is None:
            continue
        for w in runs(t):
            wc[lang][w] += 1
            for n in range(1, 5):
                gc[lang].update((g,) for g in L.ngrams(w, n))
    langs = sorted(set(wc))
    top = lambda c, m: {x for x, _ in sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:m]}
    kept_w = set().union(*(top(wc[x], most_words) for x in langs)) if langs else set()
    kept_g = set()
    for x in langs:
        for n in range(1, 5):
            kept_g |= {g for (g,) in top(Counter({k: v for k, v in gc[x].items() if len(k[0]) == n}), most_grams)}
    total_w = {x: sum(wc[x].values()) for x in langs}
    total_g = {(x, n): sum(v for (g,), v in gc[x].items() if len(g) == n) for x in langs for n in range(1, 5)}

    def word(w, x):
        if w in kept_w:
            return math.log(wc[x][w] / total_w[x]) if wc[x][w] else -math.log(2 * total_w[x])
        for n in range(4, 0, -1):
            found = [g for g in L.ngrams(w, n) if g in kept_g]
            if found:
                return sum(math.log(gc[x][(g,)] / total_g[x, n]) if gc[x][(g,)] else -math.log(2 * total_g[x, n]) for g in found) / len(found)
        return None

    out = []
    for t in texts:
        scores = {x: [s for w in runs(t) if (s := word(w, x)) is not None] for x in langs}
        if not langs or not runs(t):
            out.append(("und", 0.0))
            continue
        sums = {x: sum(v) for x, v in scores.items()}
        best = max(langs, key=lambda x: sums[x])
        out.append((best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())))
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    kinds = {"aa": "abcd", "bb": "cdef", "cc": "éüñs", "dd": "xyz𝒜"}
    rows = [doc(i, words(r, r.randint(0, 30), kinds[x], 8), x if r.random() < 0.9 else None) for i in range(200) for x in [r.choice(list(kinds))]]
    rows += [doc(900, None, "aa"), doc(901, "", "aa"), doc(902, "123 ... _", "bb"), doc(None, "abab", "aa"), doc(903, "ж", None), doc(904, "ABCD, Éü-x1y", None), doc(905, "a" * 3000, None)]
    df = with_clashes(frame(spark, rows)).drop("score")
    model = L.fit(df, model_words=15, model_ngrams=20)
    got = {x.doc_id: (x.lang_pred, x.score) for x in L.predict(df, model).collect()}
    want = brute([(t, x) for _, t, x, *_ in rows], [t for _, t, *_ in rows], 15, 20)
    for (i, *_), (lang, score) in zip(rows, want):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-6), i
    kept = L.keep_known(df, model, min_score=0.4)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, (p, s) in got.items() if p != "und" and s >= 0.4}


def test_held_out_accuracy(spark):
    r = random.Random(2)
    kinds = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "mnopéü"}
    rows = [doc(i, words(r, 25, kinds[x], 5), x) for i in range(300) for x in [r.choice(list(kinds))]]
    df = frame(spark, rows)
    model = L.fit(df.where(~L.is_held_out("doc_id")))
    got = L.predict(df.where(L.is_held_out("doc_id")), model).collect()
    truth = {i: x for i, _, x, *_ in rows}
    assert len(got) > 40 and sum(x.lang_pred == truth[x.doc_id] for x in got) / len(got) > 0.95


def test_unseen_scripts_say_nothing(spark):
    """The space at a word's ends doesn't make it known."""
    r = random.Random(8)
    model = L.fit(frame(spark, [doc(i, words(r, 20, a), x) for i in range(60) for x, a in (("aa", "abcd"), ("bb", "cdef"), ("cc", "ghij"))]))
    texts = ["ภาษาไทย และ อื่นๆ", "Съешь ещё этих мягких булок", "天地玄黄 宇宙洪荒"]
    got = {x.doc_id: x for x in L.predict(frame(spark, [doc(i, t * 50) for i, t in enumerate(texts)]), model).collect()}
    assert all(x.lang_pred == "aa" and x.score < 0.4 for x in got.values())


def test_many_languages(spark, monkeypatch):
    """No language is left out, and the model stays small."""
    r = random.Random(9)
    kinds = {f"l{i:03d}": [words(r, 1, "abcdefghijklmnop", 7) for _ in range(30)] for i in range(500)}
    rows = [doc(i, " ".join(r.choice(kinds[x]) for _ in range(25)), x) for i, x in enumerate([*kinds] * 2)]
    model = L.fit(frame(spark, rows))
    assert len(model.langs) == 500 and model.nbytes < 300e6
    got = {x.doc_id: x.lang_pred for x in L.predict(frame(spark, rows), model).collect()}
    assert sum(got[i] == x for i, _, x, *_ in rows) / len(rows) > 0.98
    monkeypatch.setattr(L, "MODEL_TERMS", 500 * 5 * 4)
    monkeypatch.setattr(L, "MODEL_ENTRIES", 60_000)
    small = L.fit(frame(spark, rows))
    assert len(small.langs) == 500 and sum(map(len, small.lang)) <= 60_000


def test_query(spark, tmp_path):
    r = random.Random(3)
    rows = [doc(i, words(r, 20, "abcd" if i % 2 else "efgh"), "aa" if i % 2 else "bb") for i in range(80)] + [doc(90, None), doc(91, "1 2"), doc(None, "abcd")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op10_language_id(spark, str(tmp_path)).collect()
    import zlib

    want = {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    assert len(got) == len(rows) and all(x.held_out == want[x.doc_id] and 0 <= x.score <= 1 for x in got)
    train = [(t, x) for i, t, x, *_ in rows if not want[i]]
    brutes = dict(zip((d[0] for d in rows), brute(train, [d[1] for d in rows], L.MODEL_WORDS, L.MODEL_NGRAMS)))
    assert all(x.lang_pred == brutes[x.doc_id][0] and x.score == pytest.approx(brutes[x.doc_id][1], abs=1e-6) for x in got)


def test_odd_bytes_and_long_texts(spark):
    model = L.fit(frame(spark, [doc(i, "abc bcd", "aa") for i in range(9)] + [doc(20, "xyz yzx", "bb")]))
    df = frame(spark, [doc(1, "abc"), doc(2, "abc bcd " * 200_000)]).withColumn("text", F.when(F.col("doc_id") == 1, F.expr("cast(concat(cast('abc ' AS binary), X'FF') AS string)")).otherwise(F.col("text")))
    assert {x.lang_pred for x in L.predict(df, model).collect()} == {"aa"} and L.keep_known(df, model, min_share=0.5).count() == 2


def test_no_training_rows(spark):
    df = frame(spark, [doc(1, "abc", None), doc(2, None, None)])
    assert {(x.lang_pred, x.score) for x in L.predict(df, L.fit(df)).collect()} == {("und", 0.0)}
    assert L.predict(frame(spark, []), L.fit(frame(spark, []))).count() == 0
    one = frame(spark, [doc(1, "abc", "xx")])
    assert L.predict(one, L.fit(one)).first().lang_pred == "xx"


def test_gate_holds_at_any_length(spark):
    """Junk and languages that weren't learned go, clean texts stay, however
    short or long they are."""
    r = random.Random(5)
    parts = {"aa": "the ing er on and re".split(), "bb": "les eau ou ir que ent".split()}
    say = lambda x, n: " ".join("".join(r.choice(parts[x]) for _ in range(r.randint(1, 3))) for _ in range(n))
    model = L.fit(frame(spark, [doc(i, say(x, 40), x) for i, x in enumerate(["aa", "bb"] * 100)]))
    junk = {0: "Съешь ещё этих мягких французских булок", 1: words(r, 12, "abcdefghijklmnopqrstuvwxyz", 9), 2: "pchnąć w tę łódź jeża lub ośm skrzyń fig"}
    rows = [doc(10 * n + i, " ".join([t] * n)) for i, t in junk.items() for n in (1, 5, 100)]
    clean = [doc(5000 + i, say(x, n)) for i, (x, n) in enumerate((x, n) for x in parts for n in (1, 3, 30, 3000))]
    kept = L.keep_known(frame(spark, rows + clean), model, min_share=stages.MIN_SHARE).collect()
    assert {x.doc_id for x in kept} == {d[0] for d in clean}
