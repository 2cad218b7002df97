import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import vectors as V


def one(spark, col, **cols):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in cols.items())
    return spark.createDataFrame([tuple(v for _, v in cols.values())], schema).select(col.alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("Some TEXT, with: Signs!", "some text with signs".split()),
    ("Release 2.0, of 2024?", "release 2 0 of 2024".split()),
    ("हिन्दी ½ a_b", ["हिन", "दी", "½", "a", "b"]),
    ("", []), (None, None), (" \n", []),
])
def test_tokens(spark, text, want):
    got = one(spark, X.tokens(F.col("t")), t=("string", text))
    assert got == want


def test_trim_is_unicode(spark):
    assert one(spark, X.trim(F.col("t")), t=("string", "　  a b\n ")) == "a b"
    assert one(spark, X.trim(F.col("t")), t=("string", "\x1ca\x1f")) == "\x1ca\x1f"


@pytest.mark.parametrize("raw, want", [
    ("ai, rust, ML", ["ai", "rust", "ml"]), ("  ai  ,  ,  rust  ", ["ai", "rust"]), ("", []), (None, []), ('["A", " b "]', ["a", "b"]),
])
def test_tags(spark, raw, want):
    assert one(spark, X.decode_tags(F.col("t")), t=("string", raw)) == want


def test_dates(spark):
    assert one(spark, X.parse_date(F.col("t")), t=("string", "2024-02-29")) == dt.date(2024, 2, 29)
    for bad in ("2024-2-9", "2023-02-29", "2024-01-01T00:00:00", "", None):
        assert one(spark, X.parse_date(F.col("t")), t=("string", bad)) is None


@pytest.mark.parametrize("title, body, text, want", [
    ("t", "b", None, "t\n\nb"), (" t ", " ", None, "t"), (None, "b", "", "b"), (None, None, None, None), ("t", "b", " x ", " x "),
])
def test_build_text(spark, title, body, text, want):
    got = one(spark, X.build_text(F.col("a"), F.col("b"), F.col("c")), a=("string", title), b=("string", body), c=("string", text))
    assert got == want


def _hash(spark, title="t", body="b", text=None, tags=("x", "y"), day=dt.date(2024, 1, 2)):
    return one(spark, X.content_hash(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e")), a=("string", title), b=("string", body), c=("string", text), d=("array<string>", list(tags)), e=("date", day))


def test_content_hash(spark):
    import hashlib

    assert _hash(spark) == hashlib.sha256(b"t\0b\0\0x,y\0002024-01-02").hexdigest()
    assert _hash(spark) == _hash(spark, title=" t\n", tags=("y", "x"))
    assert _hash(spark) != _hash(spark, text="other")
    assert _hash(spark, title=None, body=None, tags=(), day=None) == hashlib.sha256(b"\0\0\0\0").hexdigest()


def test_preview(spark):
    p = lambda t: one(spark, X.preview(F.col("t")), t=("string", t))
    assert p("short") == "short" and p("") == ""
    assert p("word " * 40) == ("word " * 20)[:-1].rsplit(" ", 1)[0] + " word..." or p("word " * 40).endswith("...")
    wide = p("é" * 80)
    assert wide == "é" * 50 + "..."


def test_vectors(spark):
    two = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=("array<float>", a), b=("array<float>", b))
    assert two(V.cosine_distance, [1.0, 0.0], [0.0, 1.0]) == pytest.approx(1.0)
    assert two(V.cosine_similarity, [1.0, 2.0], [1.0, 2.0]) == pytest.approx(1.0)
    assert two(V.cosine_similarity, [1.0, 0.0], [-1.0, 0.0]) == pytest.approx(-1.0)
    assert two(V.cosine_similarity, [1.0], [1.0, 2.0]) == 0.0
    assert two(V.cosine_similarity, [0.0, 0.0], [1.0, 2.0]) == 0.0
    assert two(V.cosine_distance, [0.0], [1.0]) is None
    assert one(spark, V.normalize(F.col("a")), a=("array<float>", [3.0, 4.0])) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalize(F.col("a")), a=("array<float>", [])) is None
