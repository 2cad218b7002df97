import random
from collections import Counter

from cairn.llm import quality as Q

from .helpers import doc, frame, with_clashes


def plain(t):
    t = t or ""
    w = [x.decode() for x in t.encode().split()]
    win = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if win[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), len(cover))


def test_measures_against_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " \n", "a", "a b c a b c", "x " * 100, "\x85a\xa0b c", "É é\né é\n\n"] + [" ".join(r.choice(["a", "b", "c#", "é", "D$\n", "\n"]) for _ in range(r.randint(0, 90))) for _ in range(80)]
    rows = [doc(i, t) for i, t in enumerate(texts)] + [doc(None, "null id"), doc(3, texts[3])]
    led = Q.ledger(with_clashes(frame(spark, rows)).drop("failed"))
    got = Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in led.collect())
    assert got == Counter((i, *plain(t)) for i, t, *_ in rows)
    # ablations by bit patterns against applying each reduced policy
    for p in Q.POLICIES.values():
        base = led.where(Q.passes(p)).count()
        found = {x.rule: x for x in Q.ablations(led, p).collect()}
        for rule in p.rules:
            less = Q.Policy("x", tuple(n for n in p.rules if n != rule), p.may_fail)
            bit = 1 << [n.name for n in Q.RULES].index(rule)
            assert found[rule].n_pass_without == led.where(Q.passes(less)).count() and found[rule].n_pass == base
            assert found[rule].n_fail == sum(1 for x in led.collect() if x.failed & bit)
            assert found[rule].n_alone == sum(1 for x in led.collect() if x.failed & p.mask == bit)
    assert Q.ledger(frame(spark, [])).count() == 0


def test_queries_against_sql(spark, tmp_path):
    """The stored ledger, its policies and ablations, with odd bytes and long texts."""
    import duckdb

    r = random.Random(2)
    rows = [doc(i, " ".join(r.choice(["word", "b", "c#", "é", "D$\n", "\n", "12"]) for _ in range(r.randint(0, 120)))) for i in range(60)] + [doc(70, None), doc(71, "long word " * 50_000)]
    path = str(tmp_path / "documents.parquet")
    frame(spark, rows).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    for query, sql in ((Q.op5_quality_rules, Q.OP5_SQL), (Q.quality_ablations, Q.ABLATIONS_SQL)):
        got = query(spark, str(tmp_path))
        names = got.columns
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    led = Q.write_ledger(frame(spark, rows), str(tmp_path / "ledger"))
    assert Q.read_ledger(spark, str(tmp_path / "ledger")).columns == led.columns and led.where("rules_version = 1").count() == len(rows)
    assert led.where(Q.passes(Q.Policy("x", ("few_words",), rules_version=2)).isNotNull()).count() == 0
    odd = frame(spark, [doc(1, "x")]).selectExpr("doc_id", "cast(X'61FF2062' AS string) text")
    assert [(x.n_words, x.word_chars) for x in Q.ledger(odd).collect()] == [(2, 3)]


def test_rules_fire(spark):
    plain_text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    cases = {"few_words": "a b c", "repeated_words": "one two three " * 40, "symbols": plain_text.replace("word", "#word"), "capitals": plain_text.upper(), "long_words": plain_text.replace("word", "w" * 20), "short_words": " ".join(chr(97 + i % 26) for i in range(26)) + " " + " ".join(chr(0x3B1 + i) for i in range(24)) + " " + " ".join(chr(0x430 + i) for i in range(30)), "no_letters": plain_text + " 12" * 1 + " ".join(str(100 + i) for i in range(60)), "repeated_lines": "\n".join(["same line here"] * 5) + "\n" + plain_text}
    rows = [doc(i, t) for i, t in enumerate(cases.values())] + [doc(99, plain_text)]
    got = {x.doc_id: x.failed for x in Q.ledger(frame(spark, rows)).collect()}
    names = [r.name for r in Q.RULES]
    for i, name in enumerate(cases):
        assert got[i] >> names.index(name) & 1, name
    assert got[99] == 0
