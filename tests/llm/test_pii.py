import hashlib
import math
import random
import re
from collections import defaultdict

from cairn.llm import pii as P

from .helpers import doc, frame, with_clashes

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15]
    return [[m.span() for m in re.finditer(p, t) if f(m[0])] for p, f in zip(PATTERNS, ok)]


def test_base_spans_are_the_patterns():
    r = random.Random(1)
    texts = ["".join(r.choice("a1.2@-+ ()é39.5.@") for _ in range(r.randint(0, 40))) for _ in range(20000)]
    texts += ["mail a.b+c@x-y.example.org, 10.0.0.256 10.0.0.1.9.9.9.9 4111 1111-1111 1111 +1 (974) 555-3436", "@", "a@b", "1.2.3", "+1 1"]
    for t in texts:
        assert P.base_spans(t) == plain_spans(t), t
    for long in ("1" * 300_000, "1." * 100_000, "@a" * 100_000, "+1 " * 100_000, "a" * 300_000 + "@"):
        P.base_spans(long)


KEY = bytes(range(16))


def brute_terms(texts):
    """{(entity, term): (pmi, ic, only)} by the definition, of all documents."""
    lower = lambda t: set(map(str.lower, re.findall(r"[^\W_]+", t or "")))
    with_mentions = {t for t in texts if t and any(P.all_spans(t))}
    docs = [t for t in texts if t not in with_mentions] + sorted(with_mentions)
    n, out = len(docs), {}
    holds, near = defaultdict(set), defaultdict(set)
    for t in with_mentions:
        for kind, own in enumerate(P.all_spans(t)):
            for s, e in own:
                left, right = P.Terms(t).context(s, e)
                who = P.entity(kind, t[s:e], KEY)
                holds[who].add(t)
                near[who] |= {*left, *right}
    count = defaultdict(int)
    for t in docs:
        for w in lower(t):
            count[w] += 1
    for who, terms in near.items():
        n_e = len(holds[who])
        p, ic = n_e / n, math.log(n / n_e)
        for w in terms:
            n_et = sum(w in lower(t) for t in holds[who])
            pmi = math.log((n_et + P.SMOOTHING * p) / ((count[w] + P.SMOOTHING) * p))
            if pmi > 0 and pmi * P.ALPHA >= ic:
                out[who, w] = (pmi, ic, n_et == count[w])
    return out


def test_disclosing_terms(spark, monkeypatch):
    monkeypatch.setattr(P, "new_key", lambda: KEY)
    r = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "épsilon"]
    rows = []
    for i in range(60):
        who = r.choice(["ann@x.org", "bob@y.org", "10.1.2.3", "+1 (974) 555-3436", 'token = "4d44c79e8bf7c55759c4958d"'])
        hint = {"ann@x.org": "Gardener", "10.1.2.3": "router"}.get(who, "")
        w = [r.choice(common) for _ in range(8)]
        rows.append(doc(i, f"{' '.join(w[:4])} {hint} {who} {' '.join(w[4:])} tail {hint.upper()}"))
    rows += [doc(100 + i, rows[0][1]) for i in range(30)] + [doc(200, None), doc(201, ""), doc(None, rows[1][1])]
    rows += [doc(300 + i, f"{r.choice(common)} {r.choice(common)} of no one") for i in range(150)]
    texts = [t for _, t, *_ in rows]
    df = with_clashes(frame(spark, rows))
    found = P.scan(df, KEY)
    got = {(x.entity, x.term): x for x in P.corpus_terms(found, P.term_counts(df, KEY), len(rows)).collect()}
    want = brute_terms(texts)
    assert want and got.keys() == {(e, P.term_hash(w, KEY)) for e, w in want}
    for (e, w), (pmi, ic, only) in want.items():
        x = got[e, P.term_hash(w, KEY)]
        assert math.isclose(x.pmi, pmi) and math.isclose(x.ic, ic) and x.only == only
    assert want[P.entity(0, "ann@x.org", KEY), "gardener"][2]
    out = P.sanitisation(df).collect()
    assert len(out) == len(rows)
    by_id = {d[0]: d[1] for d in rows}
    for x in out:
        text = by_id.get(x.doc_id) or ""
        spans = ",".join(filter(None, (x.base, x.secrets)))
        bad = {w: only for (e, w), (_, _, only) in want.items() if any(P.entity(k, text[s:t], KEY) == e for k, own in enumerate(P.all_spans(text)) for s, t in own)}
        assert {text[t.start : t.end].lower() for t in x.terms} == {w for w, *_ in P.Terms(text).outside(P.all_spans(text)) if w in bad}
        assert x.clean == P.redact(text, spans, [tuple(t) for t in x.terms])
        assert "@" not in x.clean and "gardener" not in x.clean.lower() and "4d44" not in x.clean
    assert P.sanitisation(frame(spark, [])).count() == 0


def test_query_against_plain_patterns(spark, tmp_path):
    """The contract's columns, with nulls, repeated rows, long texts and odd bytes."""
    r = random.Random(6)
    texts = ["".join(r.choice("a1.2@-+ ()é39.5.@") for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "mail ann@x.org", "mail ann@x.org", 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!', "word " * 200_000 + "4111 1111 1111 1111"]
    rows = [doc(i, t) for i, t in enumerate(texts)] + [doc(None, "10.0.0.1")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.op9_pii(spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = {x.doc_id: x for x in out.collect()}
    assert len(got) == len(rows) == out.count()
    for i, t, *_ in rows:
        spans = plain_spans(t or "")
        base = ",".join(f"{k}:{s}:{e}" for k, own in zip(P.KINDS, spans) for s, e in own)
        x = got[i]
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(map(len, spans))
        assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and x.spans.startswith(base)
        rest = x.spans[len(base) :].strip(",")
        assert all(p.startswith(("secret:", "term:")) for p in rest.split(",") if p) and len([p for p in rest.split(",") if p]) == x.n_secret + x.n_terms
        if not rest and not base:
            assert x.clean_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[154].n_secret == 1 and "secret:9:49" in got[154].spans


def test_secrets():
    find = lambda t: [t[s:e] for s, e in P._secrets(t)]
    assert find("api_key: 'sk-4d44c79e8bf7C557/59c4' and x=1") == ["sk-4d44c79e8bf7C557/59c4"]
    assert find("see https://a-long-domain-name-here/1234 or a = aaaaaaaaaaaaaaaaaaaaaaa1, b: onlylettersinthislongword") == []


def test_hot_entity_is_spread(spark, monkeypatch):
    """One address in most documents, and one text in many."""
    monkeypatch.setattr(P, "new_key", lambda: KEY)
    rows = [doc(i, f"write to all@x.org about item{i} zebra") for i in range(300)] + [doc(1000 + i, "write to all@x.org about quagga") for i in range(200)] + [doc(2000 + i, "plain words here") for i in range(600)]
    want = brute_terms([d[1] for d in rows])
    for x in P.sanitisation(frame(spark, rows)).collect():
        text = dict((d[0], d[1]) for d in rows)[x.doc_id]
        assert {text[t.start : t.end] for t in x.terms} == ({w for _, w in want} & set(text.split()) if "@" in text else set())


def test_redact():
    assert P.redact("ask Ann at a@b.co now", "email:11:17", [(4, 7, True), (18, 21, False)]) == "ask  at [EMAIL] [TERM]"
    assert P.redact("plain", "", []) == "plain"


def spoken(spark, rows):
    """Per document, the words that sanitisation marks, with ``only``."""
    text = {d[0]: d[1] for d in rows}
    return {x.doc_id: {(text[x.doc_id][t.start : t.end].lower(), t.only) for t in x.terms} for x in P.sanitisation(frame(spark, rows)).collect()}


def test_rare_entities_disclose(spark):
    rows = [doc(i, f"one two three four five p{chr(97 + i // 26)}{chr(97 + i % 26)}@x.org six seven eight nine ten") for i in range(300)]
    rows.append(doc(900, "one two three beekeeper five rare@x.org six seven eight nine ten"))
    assert spoken(spark, rows)[900] == {("beekeeper", True)}


def test_statistics_are_those_of_all_documents(spark):
    """By a mention "ordinary" and "beekeeper" look alike; elsewhere they don't."""
    rows = [doc(i, f"ordinary {'talk' if i % 2 else 'news'} of no one") for i in range(200)]
    rows += [doc(900 + i, f"ordinary beekeeper x{'abc'[i]}y rare@x.org") for i in range(3)] + [doc(950, rows[0][1]), doc(None, "other beekeeping")]
    docs = frame(spark, rows)
    got = {x.term: x for x in P.corpus_terms(P.scan(docs, KEY), P.term_counts(docs, KEY), len(rows)).collect()}
    bee = P.term_hash("beekeeper", KEY)
    assert P.term_hash("ordinary", KEY) not in got and got[bee].only
    n, n_e = 205, 3
    assert math.isclose(got[bee].pmi, math.log((3 + n_e / n) / ((3 + 1) * n_e / n))) and math.isclose(got[bee].ic, math.log(n / n_e))
    assert all(w != "ordinary" for own in spoken(spark, rows).values() for w, _ in own)


def test_terms_go_wherever_they_stand(spark):
    """Far from the mention, and terms of two characters or with digits too."""
    far = "far words between them " * 20
    rows = [doc(i, f"calm {'talk' if i % 2 else 'news'} of no one") for i in range(300)]
    rows += [doc(900, "calm Beekeeper Bo k9x7 rare@x.org news"), doc(901, f"calm rare@x.org news {far} beekeeper, BO and K9X7"), doc(902, f"{far} calm news")]
    got = spoken(spark, rows)
    want = {("beekeeper", True), ("bo", True), ("k9x7", True)}
    assert want <= got[900] and want <= got[901] and not got[902]
    spans = {x.doc_id: x.terms for x in P.sanitisation(frame(spark, rows)).collect()}[901]
    assert {rows[301][1][t.start : t.end] for t in spans} >= {"beekeeper", "BO", "K9X7"}


def test_short_words_take_no_place_in_the_window():
    text = "first a second b third 1 fourth 22 fifth c a@b.org uno x dos tres quattro cinque sei"
    at = text.index("a@b.org")
    assert P.Terms(text).context(at, at + 7) == (text[:at].split(), ["uno", "x", "dos", "tres", "quattro", "cinque"])
