"""Column functions over text, tags and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens: anything that is neither alphabetic nor a number.
NOT_TOKEN = r"[^\p{IsAlphabetic}\p{N}]+"


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.filter(F.split(F.lower(c), NOT_TOKEN), lambda x: x != "")


def normal_tag(c: Column) -> Column:
    return F.lower(trim(c))


def normal_tags(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), normal_tag)


def parse_tags(c: Column) -> Column:
    """Tags of a comma-separated list; blank ones drop out."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim)
    return F.transform(F.filter(parts, lambda x: x != ""), F.lower)


def decode_tags(c: Column) -> Column:
    """Tags of a JSON array, a comma-separated list, or nothing."""
    as_list = normal_tags(F.from_json(c, "array<string>"))
    return F.when(F.ltrim(c).startswith("["), as_list).otherwise(parse_tags(c))


def parse_date(c: Column) -> Column:
    """A date written YYYY-MM-DD; null if it isn't one."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def build_text(title: Column, body: Column, text: Column | None = None) -> Column:
    """What is embedded: an explicit text unless blank, else title and body."""
    parts = F.nullif(F.concat_ws("\n\n", blank_to_null(title), blank_to_null(body)), F.lit(""))
    if text is None:
        return parts
    return F.when(blank_to_null(text).isNotNull(), text).otherwise(parts)


def content_hash(title: Column, body: Column, text: Column, tags: Column, updated_at: Column) -> Column:
    """SHA-256 over trimmed title, body and text, sorted tags and the date."""
    def part(c: Column) -> Column:
        return F.coalesce(trim(c), F.lit(""))

    joined = F.array_join(F.array_sort(F.coalesce(tags, F.array().cast("array<string>"))), ",")
    day = F.coalesce(F.date_format(updated_at, "yyyy-MM-dd"), F.lit(""))
    return F.sha2(F.concat_ws("\0", part(title), part(body), part(text), joined, day), 256)


def preview(c: Column, limit: int = 100) -> Column:
    """The text, or its longest prefix of ``limit`` bytes at most, cut at its
    last space, with dots."""
    n = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(limit)), lambda i: F.octet_length(F.left(c, i)) <= limit))
    cut = F.regexp_replace(F.left(c, n), r" [^ ]*\z", "")
    return F.when(F.octet_length(c) > limit, F.concat(cut, F.lit("..."))).otherwise(c)
