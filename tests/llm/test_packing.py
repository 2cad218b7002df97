import random
from collections import Counter, defaultdict

import pytest

from cairn.llm import packing as P

from .helpers import doc, frame, with_clashes


def brute(items, capacity, limit):
    bins, out = [], []
    for size, source, cluster in items:
        best = None
        for i, b in enumerate(bins):
            if b["room"] >= size and (cluster is None or cluster not in b["c"]) and b["s"][source] < limit:
                if best is None or b["room"] < bins[best]["room"]:
                    best = i
        if best is None:
            bins.append({"room": capacity, "c": set(), "s": Counter()})
            best = len(bins) - 1
        b = bins[best]
        out.append((best, capacity - b["room"]))
        b["room"] -= size
        b["c"].add(cluster)
        b["s"][source] += 1
    return out


def test_best_fit_against_brute_force():
    r = random.Random(1)
    for _ in range(80):
        cap, limit = r.choice([(10, 1), (32, 2), (64, 4)])
        items = [(r.randint(1, cap), r.choice("aaab") if r.random() < 0.9 else None, r.choice([None, 1, 1, 1, 2, 3, 4])) for _ in range(r.randint(0, 120))]
        items.sort(key=lambda x: -x[0])
        assert P.best_fit(items, cap, limit) == brute(items, cap, limit)


def check(rows, got, capacity, limit):
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    spans, bins = defaultdict(list), defaultdict(list)
    for x in got:
        if x.bin_id is None:
            assert size[x.doc_id] == 0
            continue
        spans[x.doc_id].append((x.first_word, x.n_words))
        bins[x.bin_id].append(x)
    text, source = {i: t for i, t, *_ in rows}, {i: s for i, _, _, s, _ in rows}
    for own in bins.values():
        own.sort(key=lambda x: x.start)
        at = 0
        for x in own:
            assert x.start == at
            at += x.n_words
        assert at <= capacity
        assert max(Counter(text[x.doc_id] for x in own).values()) == 1
        assert max(Counter(source[x.doc_id] for x in own).values()) <= limit
    return spans, bins


def test_documents(spark):
    r = random.Random(2)
    rows = [doc(i, " ".join(f"w{i}" for _ in range(r.randint(0, 70))), source=r.choice(["hot", "hot", "b", None])) for i in range(200)]
    rows += [doc(300 + i, rows[5][1], source="c") for i in range(20)] + [doc(400, None), doc(401, ""), doc(402, "x " * 95)]
    got = P.pack_documents(with_clashes(frame(spark, rows)), capacity=32, source_limit=2, shard_items=60).collect()
    spans, bins = check(rows, got, 32, 2)
    for i, t, *_ in rows:
        n, at = len((t or "").split()), 0
        for first, length in sorted(spans.get(i, [])):
            assert first == at
            at += length
        assert at == n
    assert len({b >> 32 for b in bins}) > 1
    twice = P.pack_documents(frame(spark, [rows[7]] * 3), capacity=100).collect()
    assert len({x.bin_id for x in twice}) == 3
    assert P.pack_documents(frame(spark, [])).count() == 0


def test_partitions_do_not_matter(spark):
    r = random.Random(3)
    rows = [doc(i, " ".join(f"w{i}" for _ in range(r.randint(0, 70))), source=r.choice("ab")) for i in range(200)] + [doc(None, "same row")] * 30
    one, two = (sorted(map(str, P.pack_documents(frame(spark, rows, parts=n), capacity=32, shard_items=20).collect())) for n in (3, 5))
    assert one == two


def test_near_copies_share_no_bin(spark, tmp_path):
    base = " ".join(f"word{i} more{i * 7}" for i in range(60))
    rows = [doc(i, base + (" end" if i % 2 else "")) for i in range(10)] + [doc(100 + i, f"short text {i} {i * i}") for i in range(20)] + [doc(200, None)]
    rows += [doc(300, "Many tokens, 漢字! " * 900, source="b")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op8_best_fit_packing(spark, str(tmp_path)).collect()
    enc = P.encoder(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    size = {i: len(enc.tok.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}
    total, room = Counter(), Counter()
    for x in got:
        total[x.doc_id] += x.n_tokens
        room[x.bin_id] += x.n_tokens
    assert total == Counter(size) and size[300] > 2048 and max(v for b, v in room.items() if b is not None) <= 2048
    assert len({x.bin_id for x in got if x.doc_id < 100}) == 10
