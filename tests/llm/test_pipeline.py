import random
from collections import Counter

import corpus_pipeline
import pytest

from cairn.llm import mixing, simhash, stages

from .helpers import ODD, doc, frame, with_clashes, with_odd, words
from .test_line_dedup import brute as line_brute
from .test_packing import check
from .test_simhash import brute as near_brute


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    kinds = {"en": "abcdefgh", "fr": "ijklmnéè"}
    out = []
    for i in range(60):
        x = r.choice(list(kinds))
        lines = [words(r, 12, kinds[x]) for _ in range(r.randint(1, 4))]
        if r.random() < 0.4:
            lines.insert(1, "shared boilerplate line of this site")
        out.append(doc(i, "\n".join(lines), x, r.choice("ab")))
    out += [doc(100 + i, out[0][1], "en", "a") for i in range(15)]  # a group of copies
    out += [doc(200, out[1][1] + " zz", "fr", "b"), doc(300, None), doc(301, ""), doc(302, "12 34 --")]
    return out


def test_stages_against_brute_force(spark, rows):
    """Each stage is held against brute force on what its predecessor kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    docs = with_clashes(frame(spark, rows))
    take = lambda df: [tuple(x)[:5] for x in df.collect()]
    known = stages.identify_language(spark, docs, "")
    assert known.columns == docs.columns
    got = take(known)
    assert Counter(got) == Counter(d for d in rows if d[0] not in (300, 301, 302))

    lined = stages.dedup_lines(spark, frame(spark, [(*d, *["x"] * (len(docs.columns) - 5)) for d in got], docs.schema), "")
    assert lined.columns == docs.columns
    after = take(lined)
    want = Counter((i, t) for i, n, k, t in line_brute(got, 10, keep_first=True) if t.split())
    assert Counter((i, t) for i, t, *_ in after) == want and all(d[4] == len(d[1]) for d in after)

    near = stages.dedup_near(spark, frame(spark, after), "")
    kept = take(near)
    assert {d[0] for d in kept} == {c for _, _, _, c in near_brute(after, simhash.SEEDS)} and len(kept) == len({d[0] for d in kept})

    mixed = stages.mix_sources(spark, frame(spark, kept), "")
    assert mixed.columns == docs.columns[:5]
    stream = take(mixed)
    plan = {x.doc: x.copies for x in mixing.plan(frame(spark, kept)).collect()}
    assert Counter(d[0] for d in stream) == Counter({i: c for i, c in plan.items() if c})

    packed = stages.pack_sequences(spark, frame(spark, stream), "").collect()
    check(stream, packed, 2048, 4)
    total = Counter()
    for x in packed:
        total[x.doc_id] += x.n_words
    assert total == Counter({d[0]: 0 for d in stream}) + Counter({i: n * len(t.split()) for i, n in Counter(d[0] for d in stream).items() for t in [dict((d[0], d[1]) for d in stream)[i]]})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_columns_and_repeated_rows(spark, rows, name, stage):
    """Columns of any name travel with their rows, null ids and repeated rows
    are documents like others."""
    more = [doc(None, rows[2][1], "en", "a"), doc(None, rows[2][1], "en", "a"), doc(7, rows[7][1], "en", "a"), doc(7, rows[7][1], "en", "b"), doc(None, None, None, None)]
    docs = with_odd(frame(spark, rows + more))
    out = stage(spark, docs, "")
    if name == "best_fit_packing":
        assert out.count() >= docs.count()
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert got and all(set(x[5:]) == {None if x[0] is None else str(x[0])} and len(x) == 5 + len(ODD) for x in got)
    assert sum(x[0] is None for x in got) > 0 or name == "simhash_near_dedup"
    assert stage(spark, docs.limit(0), "").count() == 0


def test_run(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str) and out.count() > 10


def test_empty_tables(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = frame(spark, [])
