"""Operator 3, mixing sources to target weights by weighted fair queueing.

Within its source every document gets a place by a seeded hash. Documents queue as packets of up to `packet` words, and a
packet's virtual finish time is the words of its source up to and including it, over the source's target; a second pass
over the source follows the first on the same clock. All packets are range-sorted over the cluster by that clock and
truncated where their running sum meets the total budget: what stands before the cut is taken, the packet at the cut in
part. A source is hence served to its target but for a packet. With `packet=None` documents are taken whole: a document
is one packet, and the one at the cut is left out.

Running sums never put a source, or the stream, into one task: documents are dealt into hashed lanes of each source and
lanes are summed first; the stream's ranges are summed first, and only the range that holds the cut is summed by rows.

Defined results: null texts have size 0; a null source is a source of its own, after all others; documents of size 0
are taken 0 words; repeated rows are documents of their own, equal ones interchangeable; an empty table gives an empty
mix; further columns pass through `mix`, except those named like its results.
"""

from __future__ import annotations

import functools
import operator
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import count_words, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
EXACT = "decimal(38,0)"


def ranged(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` in ranges of `order`, written, with the number of the range as `_part`."""
    return written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """`rows` with the sums of all rows before each in `order`: within its range, plus the totals of the ranges before."""
    parts = ranged(rows, order, name)
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range: as many as the session has partitions
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_{k}") for k in sums])
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = parts.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(k) for k, c in sums.items()]).join(F.broadcast(offsets), "_part")
    return placed.select(*rows.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, share: Fraction = Fraction(3, 2), weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> tuple[DataFrame, int]:
    """(source, src: its rank, source_size, target), from (source, size), and the budget in whole words.

    Shares of the budget go by weight; one stops at `most` times its source and the excess goes to the others by weight.
    Taken in order of that cap over the weight, the sources that stop come first, so running sums tell where they end.
    """
    each = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    placed = with_sums_before(each, [F.col("source").isNull(), F.col("source")], {"src": F.lit(1)}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    known = placed.select("source", F.col("src").cast("int").alias("src"), "source_size", weight.cast("long").alias("weight"), (most * F.col("source_size")).alias("cap"))
    total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    parts = min(share.numerator * total["n"], share.denominator * most * total["n"])  # the budget times the share's denominator
    exact = lambda c: c.cast(EXACT)
    ratio = F.col("cap") / F.col("weight")
    filled = with_sums_before(known, [ratio, F.col("src")], {"caps": F.col("cap"), "heavy": F.col("weight")}, "mix-caps")
    left, rest = F.lit(parts) - share.denominator * F.col("caps"), F.lit(total["w"]) - F.col("heavy")
    full = exact(share.denominator * F.col("cap")) * exact(rest) <= exact(left) * exact(F.col("weight"))
    judged = written(filled.select("source", "src", "source_size", "weight", "cap", ratio.alias("ratio"), left.alias("left"), rest.alias("rest"), full.alias("full")), "mix-targets")
    first = judged.where("not full").agg(F.min(F.struct("ratio", "src", "left", "rest")).alias("f")).first()["f"]
    open_ = F.lit(None).cast("double") if first is None else exact(F.lit(first["left"]) * F.col("weight")).cast("double") / float(share.denominator * first["rest"])
    return judged.select("source", "src", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_).alias("target")), parts // share.denominator


def packets(placed: DataFrame, packet: int | None, most: int) -> DataFrame:
    """(finish, src, end, words) of every packet of every pass over (src, source_size, target, size, _end)."""
    size, step = F.col("size"), F.col("size") if packet is None else F.lit(packet).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), size - 1, step)
    passes = F.sequence(F.lit(0), F.lit(most - 1))
    each = placed.where("size > 0 AND target > 0").select("src", "source_size", "target", "size", "_end", F.explode(passes).alias("_pass")).select("*", F.explode(starts).alias("_at"))
    words = F.least(step, size - F.col("_at"))
    end = F.col("_end") - size + F.col("_pass") * F.col("source_size") + F.col("_at") + words
    return each.select((end.cast("double") / F.col("target")).alias("finish"), "src", end.alias("end"), words.cast("long").alias("words"))


def truncated(stream: DataFrame, budget: int, partial: bool) -> DataFrame:
    """(src, served): the words of each source before the point at which the sorted stream has spent the budget."""
    order = [F.col(c) for c in ("finish", "src", "end")]
    parts = ranged(stream, order, "mix-stream")
    spent, cut = 0, None
    for r in parts.groupBy("_part").agg(F.sum("words").alias("n")).orderBy("_part").collect():  # a row for each range
        if spent + r["n"] > budget:
            cut = r["_part"]
            break
        spent += r["n"]
    before = parts if cut is None else parts.where(F.col("_part") < cut)
    served = before.select("src", "end")
    if cut is not None:
        own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        row = parts.where(F.col("_part") == cut).withColumn("_before", F.coalesce(F.sum("words").over(own), F.lit(0)))
        left = budget - spent - F.col("_before")
        taken = F.when(F.col("words") <= left, F.col("words")).when(left > 0, left if partial else F.lit(0)).otherwise(0)
        served = served.unionByName(row.where(left > 0).select("src", (F.col("end") - F.col("words") + taken).alias("end")))
    return served.groupBy("src").agg(F.max("end").alias("served"))


def mix(docs: DataFrame, text: str = "text", seed: int = 17, packet: int | None = 100, most: int = 2, sized: bool = False) -> DataFrame:
    """`docs` with size, source_size, target, virtual_finish (of its first pass) and taken (words that the mix takes of it).

    `sized`: docs already has the sizes, as a column `size`.
    """
    new = ["source_size", "target", "virtual_finish", "taken", *["size"] * (not sized)]
    base = docs.drop(*[c for c in new if c in docs.columns])
    base = base if sized else base.withColumn("size", count_words(F.col(text)))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    lane = F.substring(place, 1, 3)  # 4096 lanes for each source
    sums = written(base.select("source", lane.alias("_lane"), "size").groupBy("source", "_lane").agg(F.sum("size").alias("size")), "mix-lanes")
    targets, budget = source_targets(sums, most=most)
    known = written(targets, "mix-known").alias("k")
    by_source = F.col("d.source").eqNullSafe(F.col("k.source"))
    before = sums.alias("d").join(known, by_source).select("k.src", "_lane", "d.size").select("src", "_lane", (F.sum("size").over(W.partitionBy("src").orderBy("_lane").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("_before"))
    own = W.partitionBy("src", "_lane").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)

    def placed(rows: DataFrame, *carried: str) -> DataFrame:
        keyed = rows.alias("d").join(known, by_source).select(*[f"d.{c}" for c in carried], "k.src", "k.source_size", "k.target", place.alias("_h"), lane.alias("_lane"))
        return keyed.join(before, ["src", "_lane"]).withColumn("_end", F.col("_before") + F.sum("size").over(own))

    cut = written(truncated(packets(placed(base.select("doc_id", "source", "size"), "doc_id", "size"), packet, most), budget, packet is not None), "mix-cut")
    whole = placed(base, *base.columns).join(cut, "src", "left")
    left = lambda k: F.coalesce(F.col("served"), F.lit(0)) - (F.col("_end") - F.col("size") + k * F.col("source_size"))
    taken = functools.reduce(operator.add, [F.greatest(F.lit(0), F.least(F.col("size"), left(k))) for k in range(most)])
    finish = F.try_divide(F.col("_end").cast("double"), F.col("target"))
    return whole.select(*[F.col(c) for c in base.columns], "source_size", "target", finish.alias("virtual_finish"), taken.cast("long").alias("taken"))


def query(docs: DataFrame) -> DataFrame:
    sizes = written(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "mix-sizes")  # the texts are read once
    return mix(sizes, sized=True).select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


#: The same in DuckDB SQL: whole windows in place of lanes and ranges.
ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
each AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
weighed AS (SELECT *, 2 * source_size AS cap, CASE src % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM each),
totals AS (SELECT CAST(3 * sum(source_size) AS HUGEINT) AS twice, CAST(sum(weight) AS HUGEINT) AS w FROM weighed),
filled AS (SELECT *, twice - 2 * coalesce(sum(cap) OVER before, 0) AS remains, w - coalesce(sum(weight) OVER before, 0) AS rest FROM weighed, totals WINDOW before AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, 2 * cap * rest <= remains * weight AS is_full FROM filled),
opening AS (SELECT arg_min(remains, (cap / weight, src)) AS remains, arg_min(rest, (cap / weight, src)) AS rest FROM judged WHERE NOT is_full),
known AS (SELECT source, src, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(o.remains * weight AS DOUBLE) / CAST(2 * o.rest AS DOUBLE) END AS target FROM judged, opening o),
placed AS (SELECT d.*, src, source_size, target, sum(size) OVER (PARTITION BY src ORDER BY md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS til FROM sized d JOIN known k ON d.source IS NOT DISTINCT FROM k.source),
packets AS (SELECT src, least(100, size - x) AS words, til - size + p * source_size + x + least(100, size - x) AS fin, target FROM placed, range(2) a(p), LATERAL (SELECT unnest(range(0, size, 100)) AS x) WHERE target > 0),
stream AS (SELECT *, coalesce(sum(words) OVER (ORDER BY CAST(fin AS DOUBLE) / target, src, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM packets),
served AS (SELECT src, max(fin - words + least(words, twice // 2 - spent)) AS served FROM stream, totals WHERE spent < twice // 2 GROUP BY src)
SELECT doc_id, size, source_size, target, CAST(til AS DOUBLE) / nullif(target, 0) AS virtual_finish,
    CAST(greatest(0, least(size, coalesce(served, 0) - (til - size))) + greatest(0, least(size, coalesce(served, 0) - (til - size + source_size))) AS BIGINT) AS taken
FROM placed LEFT JOIN served USING (src)
"""
