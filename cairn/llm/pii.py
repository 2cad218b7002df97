"""Personal data: fixed patterns, and words that give it away.

Patterns find the protected entities: mail addresses, IP addresses, card and
phone numbers; and secrets, which are assigned values of high entropy.
Information theory finds more: a term that stands by a mention of an entity is a
candidate, and its pointwise mutual information with the entity, over all
documents of the corpus, is compared with the entity's own information content.
A term with
  PMI(entity; term) >= IC(entity) / ALPHA
discloses it, however rare the entity; SMOOTHING weakens what few documents say.
Copies of a text with mentions count once. Wherever a disclosing term stands in
a document with that entity, it is removed if every document with the term has
the entity, and generalised to its kind otherwise. Terms are runs of letters and
digits of any length.

Texts are read three times: for mentions and terms, for the documents without a
mention, which are their own result, and for those with one, whose texts alone
shuffle, to their disclosing terms. What is stored between has neither texts nor
values: entities and terms are hashes under a key of the run. Counting is by
partial sums over (term, text with mentions), (entity, term) and term; joins by
entity or text spread hot ones.

Defined cases: a null text is an empty one; bytes that are no UTF-8 are U+FFFD.
Offsets are code points, ends exclusive. A term's places inside a span of an
entity are left to it. Rows repeat as documents of their own, with equal
results. Texts of any length are read whole. A term at the threshold discloses.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import secrets
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import join_by_key, join_pairs, stored, table, valid_text

#: The fixed patterns' kinds; what the method protects beside them.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: A mention's context: WINDOW words of three letters or more on each side and
#: the shorter terms among them, the nearest MOST_TERMS of each side.
WINDOW, MOST_TERMS = 5, 25
ALPHA = 1.25
#: Weight, in occurrences, of the assumption that a term tells nothing.
SMOOTHING = 1.0
#: Bits for each character that a secret has at least.
ENTROPY = 3.0

_AT = re.compile("@")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"[=:]\s*+[\"']?+([A-Za-z0-9][A-Za-z0-9+/_-]{19,}+)")
_TERM = re.compile(r"[^\W_]+")
_LONG = re.compile(r"[^\W\d_]{3}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (d := _DOMAIN.match(text, at + 1)):
            end = d.end()
            yield start, end


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts = [p.span() for p in _DIGITS.finditer(text, m.start(), m.end())]
        for i in range(0, len(parts) - 3, 4):
            values = [text[a:b].lstrip("0") for a, b in parts[i : i + 4]]
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                yield parts[i][0], parts[i + 3][1]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 16:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        value = m[1]
        if value.isalpha() or value.isdigit():
            continue
        n = len(value)
        if -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY:
            yield m.span(1)


FINDERS = (_emails, _ips, _cards, _phones)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind in KINDS."""
    return [list(f(text)) for f in FINDERS]


def all_spans(text: str) -> list[list[tuple[int, int]]]:
    """base_spans() and those of secrets."""
    return [*base_spans(text), list(_secrets(text))]


def _join(kinds: tuple[str, ...], spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, own in zip(kinds, spans) for s, e in own)


def new_key() -> bytes:
    """What hashes of a run are keyed with; it is kept nowhere."""
    return secrets.token_bytes(16)


def entity(kind: int, value: str, key: bytes) -> int:
    """A mention's value in one form, as a keyed hash."""
    plain = value.lower() if kind == 0 else re.sub("[^0-9]", "", value) if kind in (2, 3) else value
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8, key=key).digest(), "little", signed=True)


def term_hash(term: str, key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term.encode(), int.from_bytes(key[:8], "little")) - (1 << 63)


def text_hash(text: str, key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text.encode(), int.from_bytes(key[8:], "little")) - (1 << 63)


class Terms:
    """A text's terms in order, lower-cased, and the contexts of its mentions."""

    def __init__(self, text: str):
        found = list(_TERM.finditer(text))
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.terms = [m[0].lower() for m in found]

    def _nearest(self, some: range) -> list[str]:
        out, long = [], 0
        for i in some[:MOST_TERMS]:
            out.append(self.terms[i])
            long += _LONG.search(self.terms[i]) is not None
            if long == WINDOW:
                break
        return out

    def context(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """Terms before and after a mention, each in the text's order."""
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        return self._nearest(range(before - 1, -1, -1))[::-1], self._nearest(range(after, len(self.starts)))

    def outside(self, spans: list[list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
        """Terms with their places that no span touches."""
        taken: list[tuple[int, int]] = []
        for s, e in sorted(x for own in spans for x in own):
            if taken and s <= taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        i = 0
        for t, s, e in zip(self.terms, self.starts, self.ends):
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if i == len(taken) or taken[i][0] >= e:
                yield t, s, e


def _scan(key: bytes):
    """Of the texts with mentions: their hash, mentions and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("entity", pa.int64()), ("terms", pa.list_(pa.int64()))]))
        for batch in batches:
            hashes, found, terms = [], [], []
            for text in batch.column(0).to_pylist():
                spans = all_spans(text or "")
                if not any(spans):
                    continue
                own, near = Terms(text), {}
                code = {t: term_hash(t, key) for t in set(own.terms)}
                for k, places in enumerate(spans):
                    for s, e in places:
                        left, right = own.context(s, e)
                        near.setdefault(entity(k, text[s:e], key), set()).update(map(code.get, left + right))
                hashes.append(text_hash(text, key))
                found.append([{"entity": x, "terms": sorted(t)} for x, t in near.items()])
                terms.append(list(code.values()))
            yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array(found, kind), pa.array(terms, pa.list_(pa.int64()))], ["text", "mentions", "words"])

    return run


def scan(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """A row for each document with mentions: text (its hash), its entities
    with the terms of their contexts, and all of its terms."""
    schema = "text long, mentions array<struct<entity: long, terms: array<long>>>, words array<long>"
    return docs.select(valid_text(text_col).alias("text")).mapInArrow(_scan(key), schema)


#: Terms that a task counts before it hands them on.
COUNTED = 300_000


def _count(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.record_batch([pa.array([term_hash(t, key) for t in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["term", "n"])
            found.clear()
            return got

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update({w.lower() for w in set(_TERM.findall(text or ""))})
                if len(found) > COUNTED:
                    yield out()
        yield out()

    return run


def term_counts(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(term, n): how many documents hold each term, over all of them."""
    return docs.select(valid_text(text_col).alias("text")).mapInArrow(_count(key), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def corpus_terms(found: DataFrame, counts: DataFrame, documents: int, *, alpha: float = ALPHA, smoothing: float = SMOOTHING) -> DataFrame:
    """(entity, term, pmi, ic, only) of terms that disclose an entity, by the
    documents of the whole corpus (``documents`` of them); ``only`` says that
    the entity is in every document with the term."""
    mentioning, texts = found.agg(F.count("*"), F.countDistinct("text")).first()
    each = found.select("text", F.explode("mentions").alias("m")).select("text", "m.entity", "m.terms")
    holds = stored(each.select("entity", "text").distinct(), "entities")
    near = each.select("entity", F.explode("terms").alias("term")).distinct()
    has = stored(found.select("text", F.explode("words").alias("term")).groupBy("term", "text").agg(F.count("*").alias("c")), "held")
    held = has.groupBy("term").agg(F.count("*").alias("n_d"), F.sum("c").alias("c"))
    # copies of texts with mentions count once
    terms = held.join(counts, "term").select("term", "n_d", (F.col("n") - F.col("c") + F.col("n_d")).alias("n_t"))
    n, s = F.lit(float(documents - mentioning + texts)), F.lit(float(smoothing))
    p_e = F.col("n_e") / n
    ic = F.log(n / F.col("n_e"))

    def pmi(joint):
        return F.log((joint + s * p_e) / ((F.col("n_t") + s) * p_e))

    def enough(joint):
        return (pmi(joint) > 0) & (pmi(joint) * F.lit(alpha) >= ic)

    # the documents both share are counted only for pairs they could suffice for
    often = stored(holds.groupBy("entity").agg(F.count("*").alias("n")), "often")
    pairs = stored(near.join(often.withColumnRenamed("n", "n_e"), "entity").join(terms, "term").where(enough(F.least("n_e", "n_d"))), "pairs")
    at = join_pairs(holds, pairs.select("entity", "term"), "entity", often, holds.count())
    both = at.join(has.select("term", "text"), ["term", "text"]).groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    both = pairs.join(both, ["entity", "term"]).where(enough(F.col("n_et")))
    return both.select("entity", "term", pmi(F.col("n_et")).alias("pmi"), ic.alias("ic"), (F.col("n_et") == F.col("n_t")).alias("only"))


def hits(found: DataFrame, bad: DataFrame) -> DataFrame:
    """Of each text (by hash) with mentions: ``n`` documents with it, and
    ``terms``, its entities' disclosing terms with ``only``."""
    holds = stored(found.select("text", F.explode("mentions.entity").alias("entity")).distinct(), "holds")
    often = holds.groupBy("entity").agg(F.count("*").alias("n"))
    each = join_pairs(holds, bad.select("entity", "term", "only"), "entity", often, holds.count())
    each = each.groupBy("text", "term").agg(F.max("only").alias("only")).groupBy("text").agg(F.collect_list(F.struct("term", "only")).alias("terms"))
    return found.groupBy("text").agg(F.count("*").alias("n")).join(each, "text")


def kind_of(term: str) -> str:
    """What a term is generalised to."""
    if term.isdigit():
        return "[NUMBER]"
    if any(map(str.isdigit, term)):
        return "[CODE]"
    return "[NAME]" if term[:1].isupper() else "[TERM]"


def redact(text: str, spans: str, terms: list[tuple[int, int, bool]]) -> str:
    """The text with spans (kind:start:end) as [KIND], disclosing terms removed
    (``only``) or generalised; of spans that overlap, the first stays whole."""
    marks = [(int(s), int(e), f"[{k.upper()}]") for k, s, e in (x.split(":") for x in spans.split(",") if x)]
    marks += [(s, e, "" if only else kind_of(text[s:e])) for s, e, only in terms]
    out, at = [], 0
    for s, e, mark in sorted(marks):
        if e <= at:
            continue
        out.append(text[at : max(s, at)])
        out.append(mark)
        at = e
    return "".join(out) + text[at:]


_OUT = "doc long, " + "".join(f"n_{k} long, " for k in KINDS) + "base string, secrets string, terms array<struct<start: long, end: long, only: boolean>>, clean string"
_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("only", pa.bool_())]))
_NAMES = ["doc", *[f"n_{k}" for k in KINDS], "base", "secrets", "terms", "clean"]


def _digest(text: str, digest: bool) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if digest else text


def _without(digest: bool):
    """Results of the documents without mentions, of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            plain = [not any(all_spans(t)) for t in texts]
            n = sum(plain)
            zero, empty = pa.array([0] * n, pa.int64()), pa.array([""] * n, pa.string())
            yield pa.record_batch([batch.column(0).filter(pa.array(plain, pa.bool_())), *[zero] * 4, empty, empty, pa.array([[]] * n, _PLACES), pa.array([_digest(t, digest) for t, p in zip(texts, plain) if p], pa.string())], _NAMES)

    return run


def _with(key: bytes):
    """(doc, body, text) of the documents with mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t is not None and any(all_spans(t)) for t in batch.column(1).to_pylist()]
            part = batch.filter(pa.array(own, pa.bool_()))
            yield pa.record_batch([*part.columns, pa.array([text_hash(t, key) for t in part.column(1).to_pylist()], pa.int64())], ["doc", "body", "text"])

    return run


def _clean(key: bytes, digest: bool):
    """Results of (doc, body, terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, bad in zip(*(batch.column(i).to_pylist() for i in range(3))):
                spans = all_spans(text)
                known = {t["term"]: t["only"] for t in bad or ()}
                places = []
                if known:
                    own = Terms(text)
                    code = {t: term_hash(t, key) for t in set(own.terms)}
                    places = [(s, e, known[code[t]]) for t, s, e in own.outside(spans) if code[t] in known]
                clean = redact(text, _join((*KINDS, SECRET), spans), places)
                rows.append((doc, *map(len, spans[:4]), _join(KINDS, spans), _join((SECRET,), spans[4:]), [dict(zip(("start", "end", "only"), p)) for p in places], _digest(clean, digest)))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), _PLACES, pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _NAMES)

    return run


def sanitisation(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, smoothing: float = SMOOTHING, digest: bool = False) -> DataFrame:
    """id, the counts, ``base`` and ``secrets`` (spans kind:start:end), ``terms``
    (structs start, end, only of disclosing terms) and ``clean``, the sanitised
    text, or its SHA-256 with ``digest``."""
    key = new_key()
    found = stored(scan(docs, key, text_col), "mentions")
    bad = stored(corpus_terms(found, term_counts(docs, key, text_col), docs.count(), alpha=alpha, smoothing=smoothing), "terms")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), valid_text(text_col).alias("text"))
    own = rows.mapInArrow(_with(key), "doc long, body string, text long")
    joined = join_by_key(own, stored(hits(found, bad), "hits"), "text", "n", found.count(), how="left")
    cleaned = joined.select("doc", "body", "terms").mapInArrow(_clean(key, digest), _OUT)
    return rows.mapInArrow(_without(digest), _OUT).unionByName(cleaned).withColumnRenamed("doc", id_col)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitisation(table(spark, sf_dir, "documents"), digest=True)
    found = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    spans = F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), F.nullif(F.col("secrets"), F.lit("")), F.nullif(F.array_join(found, ","), F.lit("")))
    n_secret = F.size(F.filter(F.split("secrets", ","), lambda x: x != "")).cast("long")
    n_terms = F.size("terms").cast("long")
    counts = [F.col(f"n_{k}") for k in KINDS]
    n_entities = sum(counts[1:], counts[0]) + n_secret
    return out.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), n_secret.alias("n_secret"), n_terms.alias("n_terms"), n_entities.alias("n_entities"), F.col("clean").alias("clean_sha256"))
