"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source's documents are laid end to end, epoch after epoch, in an order fixed by a hash. The source's
weight schedule is piecewise linear in training time 0..1; its integral, scaled to the source's target, is the
cumulative token demand D(t). A stretch of tokens that starts at c is due at t with D(t) = c, which is the
document's training position, and the documents are range-sorted by position. What the stream holds beyond the
target is not taken, so a source's taken words equal its target to within one word.

Running sums over a source go in two levels: documents fall into many hash buckets per source, the small table
of bucket sums is summed up over buckets, and documents only within their bucket. A source with a third of
all rows is thus spread over all tasks. Null text has size 0; a null source is a source of its own, last in order;
an empty table gives an empty table; rows repeated in full take their places one after the other; extra columns of any name stay. What
goes through one task is a row for each source, never one for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, packed, unpacked

#: Weights of the sources in code-point order, repeating, and the most often that a document is taken.
WEIGHTS = (1.0, 2.0, 3.0)
EPOCHS = 3
#: Knots of the schedules over training time; sources follow them in turn.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (0.75, 1.5, 0.75))
#: Leading hexadecimal digits of a document's hash that name its bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """A row per source: its size, place in order, and target; one row per source goes through one task.

    The targets solve sum(min(epochs * size, level * weight)) = sum(size): with sources sorted by
    epochs * size / weight, those below the level are the capped ones.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(by_source) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.lit(float(epochs)) * F.col("source_size"))
    capped = W.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(whole)).withColumn("heavy", F.sum("weight").over(whole))
    level = (F.col("all") - F.coalesce(F.sum("most").over(capped), F.lit(0.0))) / (F.col("heavy") - F.coalesce(F.sum("weight").over(capped), F.lit(0.0)))
    s = s.withColumn("level", level)
    # The level holds from the first source on that it does not fill; before that, sources are capped.
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(whole)
    target = F.least(F.col("most"), F.coalesce(fits["level"], F.lit(0.0)) * F.col("weight"))
    return s.select("source", "source_size", "place", target.alias("target"))


def due(c: Column, schedule: tuple[float, ...], target: Column) -> Column:
    """The time at which a schedule (weights at evenly spaced knots, linear between them) has asked for c of target."""
    areas = [(a + b) / 2 for a, b in zip(schedule, schedule[1:])]
    asked = F.try_divide(c, target) * sum(areas)
    out = F.lit(1.0)
    for k in reversed(range(len(areas))):
        a, b = schedule[k], schedule[k + 1]
        rest = asked - sum(areas[:k])
        # rest = a u + (b - a) u^2 / 2, in the form that stays exact as b nears a
        u = 2 * rest / (a + F.sqrt(F.greatest(a * a + 2 * (b - a) * rest, F.lit(0.0))))
        out = F.when(asked < sum(areas[: k + 1]), F.try_divide(k + u, F.lit(float(len(areas))))).otherwise(out)
    return out


def assign(sized: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """sized with source_size, target, taken, positions and slot, in place of columns of these names."""
    own = ("source_size", "target", "taken", "positions", "slot")
    named = packed(sized, F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).alias("size"))
    return unpacked(assigned(named), [c for c in sized.columns if c not in own], *own)


def assigned(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, schedules: tuple = SCHEDULES) -> DataFrame:
    """sized (key, source, size and row, whatever it is) with source_size, target, taken, positions and slot.

    taken counts words over all epochs. positions holds the training time of each pass over the document, and so
    is empty if nothing of it is taken. sized is read twice.
    """
    named = sized.select("row", "source", "size", F.md5(F.coalesce(F.col("key").cast("string"), F.lit(""))).alias("slot"))
    named = named.withColumn("bucket", F.substring("slot", 1, BUCKET_DIGITS))
    sums = named.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    t = targets(sums, weights, epochs)
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("bucket_start"))
    known = starts.alias("b").join(t.alias("t"), F.expr("b.source <=> t.source")).selectExpr("b.source AS s", "b.bucket AS b", "bucket_start", "source_size", "place", "target")
    own = W.partitionBy("source", "bucket").orderBy("slot", "size").rowsBetween(W.unboundedPreceding, -1)
    x = named.withColumn("earlier", F.coalesce(F.sum("size").over(own), F.lit(0)))
    x = x.join(known, F.expr("source <=> s AND bucket = b"))
    x = x.withColumn("start", F.col("bucket_start") + F.col("earlier")).withColumn("quota", F.round("target").cast("long"))
    x = x.withColumn("whole", F.expr("coalesce(quota div nullif(source_size, 0), 0)"))
    part = F.least(F.col("size"), F.col("quota") - F.col("whole") * F.col("source_size") - F.col("start"))
    x = x.withColumn("taken", F.col("whole") * F.col("size") + F.greatest(part, F.lit(0)))
    passes = [F.col("start") + e * F.col("source_size") for e in range(epochs)]
    at = lambda c: F.coalesce(*(F.when(F.col("place") % len(schedules) == j, due(c, s, F.col("target"))) for j, s in enumerate(schedules)))
    times = F.array_compact(F.array(*(F.when((F.col("size") > 0) & (c < F.col("quota")), at(c)) for c in passes)))
    return x.select("row", "size", "source_size", "target", "taken", times.alias("positions"), "slot")


def by_position(placed: DataFrame) -> DataFrame:
    """Range-sorts documents by their first training position; those that are not taken come last."""
    first = placed.withColumn("position", F.try_element_at("positions", F.lit(1)))
    return first.orderBy(F.col("position").asc_nulls_last(), "slot")


def mixture(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The training stream: documents, one row per pass over each, in the order of their positions; same columns."""
    placed = assigned(packed(documents, F.col(key).alias("key"), F.col(source).alias("source"), words(text).alias("size")))
    return unpacked(placed.withColumn("position", F.explode("positions")).orderBy("position", "slot"), documents.columns)


def op2_mixing(documents: DataFrame) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    sized = materialize(documents.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("key"), "source", words().alias("size")), "sizes")
    return by_position(assigned(sized)).select(F.col("row").alias("doc_id"), "size", "source_size", "target", "taken", "position")


def _due_sql(c: str, schedule: tuple[float, ...]) -> str:
    areas = [(a + b) / 2 for a, b in zip(schedule, schedule[1:])]
    asked = f"({c} / nullif(target, 0) * {sum(areas)!r}::DOUBLE)"
    out = ""
    for k, (a, b) in enumerate(zip(schedule, schedule[1:])):
        rest = f"({asked} - {float(sum(areas[:k]))!r}::DOUBLE)"
        u = f"2 * {rest} / ({a!r}::DOUBLE + sqrt(greatest({a * a!r}::DOUBLE + {2 * (b - a)!r}::DOUBLE * {rest}, 0.0::DOUBLE)))"
        out += f" WHEN {asked} < {float(sum(areas[: k + 1]))!r}::DOUBLE THEN ({k} + {u}) / {float(len(areas))!r}::DOUBLE"
    return f"CASE{out} ELSE 1.0::DOUBLE END"


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS slot FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
w AS (SELECT *, (1 + place % 3)::DOUBLE AS weight, {EPOCHS}.0::DOUBLE * source_size AS most FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER before, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM w WINDOW before AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, place, least(most, weight * coalesce(
    (SELECT x.level FROM l x WHERE x.level * x.weight <= x.most ORDER BY x.most / x.weight, x.place LIMIT 1), 0.0::DOUBLE)) AS target
  FROM l),
d AS (
  SELECT z.doc_id, z.size, t.source_size, t.place, t.target, round(t.target)::BIGINT AS quota,
         coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.slot, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (coalesce(quota // nullif(source_size, 0), 0) * size
   + greatest(0, least(size, quota - coalesce(quota // nullif(source_size, 0), 0) * source_size - start)))::BIGINT AS taken,
  CASE WHEN size > 0 AND start < quota THEN
    CASE place % 3 WHEN 0 THEN {_due_sql("start", SCHEDULES[0])} WHEN 1 THEN {_due_sql("start", SCHEDULES[1])} ELSE {_due_sql("start", SCHEDULES[2])} END
  END AS position
FROM d
"""
