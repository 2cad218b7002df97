import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import mixing as M

from .helpers import doc, frame, with_clashes


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(sizes.values())
    out = {s: total * w[s] / sum(w.values()) for s in names} if names else {}
    for _ in range(len(names) + 1):
        over = sum(max(0.0, out[s] - most * sizes[s]) for s in names)
        out = {s: min(out[s], most * sizes[s]) for s in names}
        free = [s for s in names if out[s] < most * sizes[s]]
        if over < 1e-12 or not free:
            break
        for s in free:
            out[s] += over * w[s] / sum(w[x] for x in free)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = [doc(i, " ".join("w" for _ in range(r.randint(0, 30))), source=r.choice(["tiny", "b", "é", "Z", "hot", "hot", "hot", None])) for i in range(300) if i]
    out = [d for d in out if d[3] != "tiny" or d[0] < 30]
    return out + [doc(900, None, source="b"), doc(None, "no id here", source="b"), out[3], doc(901, "", source="empty")]


def test_against_brute_force(spark, rows):
    df = with_clashes(frame(spark, rows))
    got = M.plan(df).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    assert Counter((x.doc, x.size, x.source, x.source_size) for x in got) == Counter((i, size(t), s, sizes[s]) for i, t, _, s, _ in rows)
    taken = defaultdict(int)
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.taken == x.copies * x.size and x.copies <= 3
        taken[x.source] += x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 31
    again = M.plan(df.repartition(7)).collect()
    key = lambda x: (str(x.doc), x.th, x.copies, x.position or -1)
    assert sorted(map(key, got)) == sorted(map(key, again))
    # copies of a source follow its order: full passes for all, one more for the first
    for s in sizes:
        own = sorted((x for x in got if x.source == s and x.size), key=lambda x: x.start)
        assert [x.copies for x in own] == sorted((x.copies for x in own), reverse=True)


def test_positions_invert_the_demand(spark):
    for knots in M.SCHEDULES:
        steps = [i / 50 for i in range(51)]
        d = spark.createDataFrame([(x,) for x in steps], "x double")
        got = [r.t for r in d.select(M.invert(F.col("x"), list(knots)).alias("t")).collect()]

        def area(t):
            total = 0.0
            for (a, u), (b, v) in zip(knots, knots[1:]):
                e = min(max(t, a), b)
                mid = u + (v - u) * (e - a) / (b - a)
                total += (e - a) * (u + mid) / 2
            return total

        assert [area(t) / area(1.0) for t in got] == pytest.approx(steps) and got == sorted(got)


def test_mixed_stream(spark, rows):
    df = with_clashes(frame(spark, rows))
    plan = Counter()
    for x in M.plan(df).collect():
        plan[x.doc, x.source, x.th] += x.copies
    out = M.mixed(df)
    assert out.columns == df.columns
    assert Counter(tuple(x) for x in out.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).collect()) == +plan


def test_each_row_has_its_own_copies(spark):
    """The same id and text in two sources, and many rows that are equal."""
    rows = [doc(1, "a b c", source="a"), doc(1, "a b c", source="b")] + [doc(None, "x y", source="b")] * 40 + [doc(2 + i, "p q r", source="a") for i in range(9)]
    got = M.plan(frame(spark, rows, parts=5)).collect()
    want = Counter()
    for x in got:
        want[x.doc, x.source] += x.copies
    assert Counter((x.doc_id, x.source) for x in M.mixed(frame(spark, rows, parts=2)).collect()) == +want
    assert len({x.start for x in got if x.doc is None}) == 40
    key = lambda x: (str(x.doc), x.source, x.start, x.copies, x.position or -1)
    assert sorted(map(key, got)) == sorted(map(key, M.plan(frame(spark, rows, parts=1)).collect()))


def test_query(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op1_mixing(spark, str(tmp_path))
    assert got.dtypes[:5] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert Counter(x.doc_id for x in got.collect()) == Counter(i for i, *_ in rows) and all(0 <= x.taken <= 3 * x.size for x in got.collect())


def test_targets_of_many_sources(spark):
    """Sources that reach their caps one after another."""
    sizes = {f"s{i:04d}": 1 + (i * i) % 997 for i in range(400)}
    src = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {x.source: x.target for x in M.targets(src).collect()}
    want = brute_targets(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_long_text(spark):
    (x,) = M.plan(frame(spark, [doc(1, "word " * 400_000)])).collect()
    assert (x.size, x.target, x.taken) == (400_000, 400_000.0, 400_000)


def test_edges(spark):
    assert M.plan(frame(spark, [])).count() == 0 and M.mixed(frame(spark, [])).count() == 0
    got = M.plan(frame(spark, [doc(1, None), doc(2, " ")])).collect()
    assert [(x.size, x.target, x.taken) for x in got] == [(0, 0.0, 0)] * 2
    many = frame(spark, [doc(i, "a b c", source=f"s{i:03d}") for i in range(50)])
    assert {x.source: x.rank for x in M.plan(many).collect()} == {f"s{i:03d}": i for i in range(50)}
