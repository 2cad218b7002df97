"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the
measurements, one integer whose bit r is set where rule r fails, and the version
of the rules that made it; it is written as a table. Policies are versioned
masks over those bits, so a new policy, or the effect of leaving a rule out, is
bitwise arithmetic over the stored ledger and never reads a text again.

Defined cases: a null text has no words; bytes that are no UTF-8 are U+FFFD.
Words are runs of anything but U+0020 and U+0009 to U+000D. Rows repeat as
documents of their own. Texts of any length are measured whole. A measure equal
to a rule's bound passes it. Other columns are ignored. An empty table gives an
empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import stored, table, valid_text

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_letter_words")


def repeat_words(words: list, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    body = b"".join(words)
    # code points: bytes that don't continue one
    chars = len(body) if raw.isascii() else len(body.decode())
    lettered = sum(1 for w in words if w.isalpha() or any(c.isalpha() for c in w.decode()))
    return (
        len(words),
        chars,
        sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
        dup_lines(raw),
        repeat_words(words),
        raw.count(b"\n") + 1,
        len(text),
        len(body) - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        lettered,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t or "") for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]], ["id", *MEASURES])


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measurements."""

    name: str
    fails: Column | str


#: The version of RULES; a ledger of another one isn't judged by these policies.
RULES_VERSION = 1
#: The rules in bit order. Bits are never reused: a rule that is changed gets a
#: new one. Integer arithmetic throughout, so any engine agrees.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_words", "n_words > 1000000"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "2 * n_upper > word_chars"),
    Rule("no_letters", "5 * n_letter_words < 4 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """The rules that a version of a policy enforces, and how many may fail."""

    name: str
    rules: tuple[str, ...]
    may_fail: int = 0
    version: int = 1
    rules_version: int = RULES_VERSION

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


#: The two base rules alone reject; so does any of these.
POLICIES = {
    "base": Policy("base", ("few_words", "repeated_words")),
    "v1": Policy("v1", ("few_words", "repeated_words", "many_words", "short_words", "long_words", "symbols", "repeated_lines", "capitals", "no_letters")),
    "lenient": Policy("lenient", ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "no_letters"), may_fail=1),
}


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, ``failed`` (bit r: rule r fails) and the version
    of the rules."""
    schema = "id long, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), valid_text(text_col).alias("text")).mapInArrow(_measure, schema)
    failed = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        cond = F.expr(r.fails) if isinstance(r.fails, str) else r.fails
        failed = failed.bitwiseOR(F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("failed", failed).withColumn("rules_version", F.lit(RULES_VERSION)).withColumnRenamed("id", id_col)


def write_ledger(docs: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """The ledger, written to ``path`` (or the shared folder) and read back."""
    led = ledger(docs, **columns)
    if path is None:
        return stored(led, "ledger")
    led.write.mode("errorifexists").parquet(path)
    return read_ledger(docs.sparkSession, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def passes(policy: Policy) -> Column:
    """Whether a ledger row passes the policy; null for rows that other rules
    than the policy's made."""
    ok = F.bit_count(F.col("failed").bitwiseAND(F.lit(policy.mask))) <= policy.may_fail
    return F.when(F.col("rules_version") == policy.rules_version, ok)


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, that it alone
    rejects, and that pass once it is left out. One aggregation over the
    distinct bit patterns, of which there are 2^rules at most."""
    patterns = led.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r.name in policy.rules])
    each = patterns.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    without = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))) <= policy.may_fail
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(hit & (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(without, F.col("n")).otherwise(0)).alias("n_pass_without"),
        F.sum(F.when(F.bit_count("bits") <= policy.may_fail, F.col("n")).otherwise(0)).alias("n_pass"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = write_ledger(table(spark, sf_dir, "documents"))
    base = ~passes(POLICIES["base"])
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(POLICIES["v1"])).alias("kept"), "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strict policy does, over the whole ledger."""
    led = write_ledger(table(spark, sf_dir, "documents"))
    return ablations(led, POLICIES["v1"])


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 3)) AS v(k) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n
  FROM (SELECT doc_id, unnest(l) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN dup ON dup.doc_id = d.doc_id
), f AS (
  SELECT *, (n_words < 50)::BIGINT
    + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_words > 1000000)::BIGINT
    + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 14 * n_words)::BIGINT
    + 32 * (10 * n_symbols > n_words)::BIGINT + 64 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 128 * (2 * n_upper > word_chars)::BIGINT + 256 * (5 * n_letter_words < 4 * n_words)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""

ABLATIONS_SQL = "WITH led AS (" + OP5_SQL + """), rules AS (
  SELECT * FROM (VALUES """ + ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(RULES)) + """) AS v(rule, bit)
)
SELECT rule, CAST(sum((failed & bit <> 0)::INTEGER) AS BIGINT) AS n_fail, CAST(sum((failed = bit)::INTEGER) AS BIGINT) AS n_alone,
       CAST(sum((failed & ~bit = 0)::INTEGER) AS BIGINT) AS n_pass_without, CAST(sum((failed = 0)::INTEGER) AS BIGINT) AS n_pass
FROM led, rules GROUP BY rule
"""
