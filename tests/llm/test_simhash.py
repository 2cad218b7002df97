import random
from collections import Counter

import numpy as np
import xxhash

from cairn.llm import simhash as S

from .helpers import doc, frame, with_clashes, words


def plain_fingerprint(text, seed=42):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))]
    h = [xxhash.xxh64_intdigest(x, seed) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, seeds=(42,)):
    all_fps = [[plain_fingerprint(t, s) for s in seeds] for _, t, *_ in rows]
    fps, n = [x[0] for x in all_fps], len(rows)
    near = [[j for j in range(n) if j != i and any((a ^ b).bit_count() <= 6 for a, b in zip(all_fps[i], all_fps[j]))] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in near[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((rows[i][0], fps[i], len(near[i]), min(ids) if ids else None))
    return out


def test_golay_is_perfect():
    r = np.random.default_rng(1)
    v = r.integers(0, 1 << 23, 5000).astype(np.uint32)
    idx = S.decode(v)
    words_ = np.array([(m << 11) | S._remainder(int(m) << 11) for m in range(4096)], np.uint32)
    assert all((int(x) ^ int(words_[i])).bit_count() <= 3 for x, i in zip(v, idx))


def test_all_pairs_within_six_bits_share_a_key():
    r = random.Random(3)
    fp = [r.getrandbits(64) for _ in range(3000)]
    far = [f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for f in fp]
    keys = lambda x: set(zip(*(a.tolist() for a in S.link_keys(np.array(x, np.uint64)))))
    shared = {i for i, _ in keys(fp) & keys(far)}
    assert shared == set(range(3000))


def test_fingerprints():
    r = random.Random(4)
    for text in ["", " \n", "one", "A b", "a a a a", "é ü x", words(r, 700), "x" * 5000, "\x1c a"]:
        assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(40):
        base = words(r, 60)
        rows.append(doc(10 * i, base))
        for k in range(r.choice([0, 0, 1, 3])):
            w = base.split()
            w[r.randrange(60)] = "zz"
            rows.append(doc(10 * i + k + 1, " ".join(w)))
    rows += [doc(900 + i, rows[0][1].upper()) for i in range(5)] + [doc(950, None), doc(951, ""), doc(952, "\n"), doc(None, rows[5][1]), doc(None, "alone here"), doc(20, rows[2][1])]
    df = with_clashes(frame(spark, rows))
    got = S.near_duplicates(df).collect()
    mine = Counter((x.doc_id, x.fp & (2**64 - 1), x.n_near, x.component_id) for x in got)
    assert mine == Counter(brute(rows))
    kept = S.keep_one_of_each(df)
    assert kept.columns == df.columns and kept.where("doc_id = 950").count() == 1
    want = brute(rows, S.SEEDS)
    assert {c for *_, c in want} - {None} == {x.doc_id for x in kept.collect()} - {None}
    alone = sum(1 for (i, *_, c) in want if c is None)
    assert kept.where("doc_id IS NULL").count() == min(alone, 1)
    # the same texts by one seed
    one = S.keep_one_of_each(df, seeds=(42,)).collect()
    assert {x.doc_id for x in one} - {None} == {c for *_, c in brute(rows)} - {None}


def test_links_and_components(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(300)]
    fps = sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 7))) for b in base for _ in range(4)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(x.a, x.b) for x in S.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 6}
    assert got == want
    # keys with more fingerprints than one task compares
    few = S.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(2), group=2)
    assert Counter((x.a, x.b) for x in few.collect()) == Counter(want)
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 70) if i != 30], "a long, b long")
    roots = {x.node: x.root for x in S.components(chain).collect()}
    assert roots == {i: 0 if i <= 30 else 31 for i in range(71)}


def test_hot_keys_and_hubs(spark):
    """Fingerprints that all share a key are compared in blocks; a hub's edges
    meet its root by broadcast."""
    near = [1 << i | 1 << j for i in range(64) for j in range(i)]
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in near)
    got = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits=2, group=50).collect()
    want = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert len(got) == len(want) and {(x.a, x.b) for x in got} == want
    hub = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(2999, 5000), (6000, 6001)], "a long, b long")
    roots = {x.node: x.root for x in S.components(hub).collect()}
    assert set(map(roots.get, [*range(3000), 5000])) == {0} and roots[6001] == roots[6000] == 6000


def test_query(spark, tmp_path):
    rows = [doc(i, t) for i, t in enumerate(["a b c d e f g", "A B c d e f g", None, "", "other words stand here", "one"])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op7_simhash(spark, str(tmp_path)).collect()
    assert got[0].asDict().keys() == {"doc_id", "fingerprint", "n_near", "component_id"}
    assert sorted((x.doc_id, int(x.fingerprint, 16), x.n_near, x.component_id) for x in got) == sorted(brute(rows)) and all(len(x.fingerprint) == 16 for x in got)


def test_empty(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0
    assert S.keep_one_of_each(frame(spark, [])).count() == 0
