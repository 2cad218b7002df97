"""Mixing sources to target weights under a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], piecewise
linear. Its integral is the source's cumulative demand, scaled so that the
whole schedule asks for the source's target. A source's documents, in a fixed
pseudo-random order and repeated as often as the target needs, lie one after
another along its words; inverting the demand at a document's first word gives
its training position, and documents are range-sorted by position.

Targets share all words by weight. No source is repeated more than
``max_repeats`` times: what that leaves over is shared among the others by
weight, until none is above. A document's copies are whole ones: all copies of
the last full pass, and of one pass more the documents up to the remainder, so
a source's taken words miss its target by part of one document.

Hot sources don't make hot tasks: the order within a source is by hash ranges,
whose totals are summed before any window, and rows meet their source by a
broadcast of fewer than a thousand hot sources or by an even shuffle. Rows with
equal id, text and source are told apart by an occurrence number, which spreads
them over the ranges like other rows.

Defined cases: a null source is a source of its own, after all others. Null
and blank texts have size 0 and are taken as often as the pass takes them
(0 words). Null ids and repeated rows are documents like others, each with
copies of its own; which of equal rows has a copy more doesn't show. Texts of
any length count whole. Sources of equal name are one, and documents tie by
nothing but equal hashes, where the id, the text's hash and the occurrence
decide. Other columns are ignored or carried. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Neutral, join_by_key, numbered, occurrences, stored, table, text_bytes, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
#: Weight over time for each of the weight classes: (t, factor) knots. The
#: heaviest class fades as the lightest grows.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.0)))
#: Words of one part of the sorted stream.
PART_WORDS = 4_000_000
#: Hash ranges within a source.
RANGES = 1 << 14


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by source (code points, null last), by
    a range sort and offsets of its parts: no task sees all of them."""
    parts = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__m", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("__m", 33)
    ends = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(part.alias("p")).agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(ends), F.lit(0)).alias("before"))
    at = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(F.broadcast(before), part == F.col("p")).withColumn("rank", F.col("before") + at).drop("__m", "p", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size, ...) with rank, weight and target.

    Sources reach their cap in the order of cap / weight. In that order, with
    all before it at their caps, the words left give a level (words for each
    unit of weight); the first that stays within its own cap is the level of
    all. Running sums go by parts of a range sort, a few jobs for any number of
    sources.
    """
    known = F.array(*[F.lit(float(w)) for w in weights])
    src = ranked(sources).withColumn("weight", F.element_at(known, (F.col("rank") % len(weights)).cast("int") + 1))
    src = src.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("full_at", F.col("cap") / F.col("weight"))
    src = stored(src.repartitionByRange("full_at", "rank").withColumn("part", F.spark_partition_id()), "weights")
    parts = src.groupBy("part").agg(F.sum("cap").alias("c"), F.sum("weight").alias("w"), F.sum("source_size").alias("n"))
    ends, all_rows = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    parts = parts.select("part", F.coalesce(F.sum("c").over(ends), zero).alias("c0"), F.coalesce(F.sum("w").over(ends), zero).alias("w0"), F.sum("w").over(all_rows).alias("w_all"), F.sum("n").over(all_rows).alias("n_all"))
    before = Window.partitionBy("part").orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    each = src.join(F.broadcast(parts), "part")
    capped, used = F.col("c0") + F.coalesce(F.sum("cap").over(before), zero), F.col("w0") + F.coalesce(F.sum("weight").over(before), zero)
    each = each.withColumn("level", (F.col("n_all") - capped) / (F.col("w_all") - used))
    level = each.where(F.col("level") <= F.col("full_at")).agg(F.min_by("level", F.struct("full_at", "rank"))).first()[0] or 0.0
    return src.drop("part", "full_at").withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap")


def invert(demand: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which a schedule's integral, scaled to end at 1, is ``demand``."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole = sum(area)
    out, done = F.lit(float(knots[-1][0])), whole
    for (t0, w0), (t1, w1), s in reversed(list(zip(knots, knots[1:], area))):
        done -= s
        need = F.greatest(demand * F.lit(whole) - F.lit(done), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        if abs(slope) < 1e-12:
            t = need / F.lit(max(w0, 1e-300))
        else:
            t = (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        out = F.when(demand * F.lit(whole) < F.lit(done + s), F.lit(t0) + F.least(t, F.lit(t1 - t0))).otherwise(out)
    return out


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS, schedules=SCHEDULES, seed: int = 17) -> DataFrame:
    """A row for each document: row (``row_col``, or a number given here), doc,
    th (hash of its text), size, source_size, target, copies, taken, and
    ``position`` of its first copy in [0, 1] (null if it isn't taken) with what
    the position of each copy needs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_bytes(text_col)).alias("th"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), *([F.col(row_col).alias("row")] if row_col else []))
    rows = occurrences(stored(rows if row_col else numbered(rows), "sizes"), ["doc", "th", "source"])
    order = F.xxhash64(F.lit(seed), "doc", "th", "occ")
    rows = stored(rows.withColumn("h", order).withColumn("r", F.shiftrightunsigned("h", 64 - (RANGES.bit_length() - 1)).cast("int")), "order")
    by_range = stored(rows.groupBy("source", "r").agg(F.sum("size").alias("range_size"), F.count("*").alias("n")), "ranges")
    sources = by_range.groupBy("source").agg(F.sum("range_size").alias("source_size"), F.sum("n").alias("n"))
    src = stored(targets(sources, weights, max_repeats), "targets")
    total = rows.count()
    before = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select("source", "r", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("source", "r").orderBy("h", F.col("doc").asc_nulls_last(), "th", "occ").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    cell = starts.select(F.col("source").alias("__s"), F.col("r").alias("__r"), "range_start")
    placed = placed.join(cell, F.col("source").eqNullSafe(F.col("__s")) & (F.col("r") == F.col("__r"))).drop("__s", "__r")
    placed = placed.withColumn("start", F.col("range_start") + F.col("offset")).select("row", "doc", "th", "source", "size", "start")
    facts = src.select("source", "n", "rank", "source_size", F.col("target").cast("double").alias("target"))
    out = join_by_key(placed, facts, "source", "n", total)
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("target") - full * F.col("source_size")
    out = out.withColumn("copies", (full + (F.col("start") + F.col("size") / 2 < rest).cast("long")).cast("long"))
    out = out.withColumn("copies", F.least("copies", F.lit(int(max_repeats)).cast("long"))).withColumn("taken", F.col("copies") * F.col("size"))
    return out.withColumn("position", F.when(F.col("copies") > 0, position(F.lit(0), schedules)))


def position(copy: Column, schedules=SCHEDULES) -> Column:
    """Training position of a copy (0, 1, ...) of a row of plan()."""
    demand = F.when(F.col("target") > 0, (F.col("start") + copy * F.col("source_size")) / F.col("target")).otherwise(0.0)
    demand = F.least(demand.cast("double"), F.lit(1.0))
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        out = F.when(F.col("rank") % len(schedules) == i, invert(demand, list(knots))).otherwise(out)
    return out


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The training stream: all columns of ``docs``, a row for each copy,
    range-sorted by position. Rows are numbered and written first, so that each
    has its own copies, whatever else is equal to it, and no join key is hot.
    Texts shuffle twice: to the plan's row and to their place."""
    n = Neutral(docs)
    rows = stored(numbered(n.df), "rows")
    p = plan(rows, id_col=n[id_col], text_col=n[text_col], source_col=n[source_col], row_col="row", **options).where("copies > 0")
    copies = F.transform(F.sequence(F.lit(0), F.col("copies").cast("int") - 1), lambda c: position(c))
    p = stored(p.select("row", "doc", "th", "size", F.posexplode(copies).alias("copy", "pos")), "copies")
    # ranges of positions, as many as the words need, from the narrow plan
    parts = int((p.agg(F.sum("size")).first()[0] or 0) // PART_WORDS + 1)
    p = stored(p.drop("size").repartitionByRange(parts, "pos", "doc", "th", "row").withColumn("part", F.spark_partition_id()), "plan")
    out = rows.join(p, "row").repartitionById(parts, F.col("part"))
    return n.restore(out.sortWithinPartitions("pos", F.col("doc").asc_nulls_last(), "th", "copy", "row"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents"))
    return stored(p.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken", "position"), "mix").orderBy(F.col("position").asc_nulls_last(), "doc_id")
