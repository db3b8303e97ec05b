"""Dominance counting with a distributed range tree.

For each point (slot, level), count the points of smaller slot and strictly larger level, and their weights. The slots'
dyadic intervals are the tree's nodes: a point emits the nodes above its slot, and asks the nodes that make up all slots before its own.
Of each height, a slot has either the node itself to be found in (a left child: later slots ask for it) or the node left of it to ask, so a point is
as many rows as slots have bits.

Rows are sorted by node, and within a node by falling level, over all tasks: a range of the order is a partition, so the rows of one
node may lie in many, and a node of half of all points is no large task. A running sum along a node answers its questions. What a node has in
earlier partitions is the sum of partitions before, again by dyadic intervals, of the partitions' numbers: it is
aggregated and joined like any other rows, and nothing that grows with the input meets in one task, in the driver or in a broadcast.

Equal points are one point with their number and weight, so a point that a third of all rows share is one. The answers
are written, and each row gets its point's by common.hot_join.

Defined results: rows with a null slot or level are above none and have no counts (null), and so are levels made of
totals that are no numbers or infinite; repeated rows count each, and get the same counts; ties in the slot or the level are not above each
other; an empty table gives an empty one; other columns pass through counted() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common

#: A node's number: its height above this many bits for its place.
HEIGHT_SHIFT = 48
SLOT_SECONDS = 60
LEVELS_A_UNIT = 100

#: What a task gives of its range of the sorted rows: answers to questions (slot and level), and at the end the first and the
#: last node it has seen (no slot). part: its number.
SUMMED = T.StructType([T.StructField(x, T.LongType()) for x in ("slot", "level", "node", "part", "n", "w")])


def dyadic(at: Column, bits: int) -> Column:
    """An array with a struct for each height below bits: node, and whether it is asked (else the place is found in it).

    at: a number from 0 to 2^bits - 1. The nodes asked by a place cover all smaller places once."""

    def row(height: int) -> Column:
        own = F.shiftright(at, height)
        asked = own.bitwiseAND(F.lit(1)) == 1
        return F.struct((F.lit(height << HEIGHT_SHIFT) + own - asked.cast("long")).alias("node"), asked.alias("asked"))

    return F.array(*(row(h) for h in range(bits)))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums along each node of a task's sorted rows (node, level, n, slot, w); rows without n are questions."""
    part = TaskContext.get().partitionId()
    first = last = None
    n = w = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        node, level, count, slot, weight = (batch.column(k).to_numpy() for k in range(5))
        if first is None:
            first = last = int(node[0])
        # Sums so far, with what the batches before have left of the node; each node takes off what stood before it.
        sums, weights = np.cumsum(count), np.cumsum(weight)
        starts = np.flatnonzero(np.concatenate([[node[0] != last], node[1:] != node[:-1]]))
        own = np.searchsorted(starts, np.arange(len(node)), side="right")
        off_n = np.concatenate([[-n], sums[starts] - count[starts]])[own]
        off_w = np.concatenate([[-w], weights[starts] - weight[starts]])[own]
        sums, weights = sums - off_n, weights - off_w
        last, n, w = int(node[-1]), int(sums[-1]), int(weights[-1])
        asked = np.flatnonzero(count == 0)
        columns = [slot[asked], level[asked], node[asked], np.full(len(asked), part), sums[asked], weights[asked]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=SUMMED.names)
    if first is not None:
        ends = [[None, None], [None, None], [first, last], [part, part], [None, n], [None, w]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=SUMMED.names)


def _before(ends: DataFrame) -> DataFrame:
    """(part, node, n0, w0) of the partitions whose first node has rows in earlier ones: the sums of these."""
    bits = 31
    lasts = ends.where("n is not null").select("node", "n", "w", F.inline(dyadic(F.col("part"), bits)).alias("place", "asked")).where("not asked")
    firsts = ends.where("n is null").select("node", "part", F.inline(dyadic(F.col("part"), bits)).alias("place", "asked")).where("asked")
    held = lasts.groupBy("node", "place").agg(F.sum("n").alias("n0"), F.sum("w").alias("w0"))
    return firsts.join(held, ["node", "place"]).groupBy("part", "node").agg(F.sum("n0").alias("n0"), F.sum("w0").alias("w0"))


def answers(points: DataFrame) -> DataFrame:
    """(slot, level, own, n, w) of distinct points (slot, level, n, w), all without nulls: the numbers of points above, and own, the point's own n."""
    spark = points.sparkSession
    common.prepare(spark)
    least, most = points.agg(F.min("slot"), F.max("slot")).first()
    if least is None:
        return points.select("slot", "level", F.col("n").alias("own"), "n", "w")
    bits = max(1, int(most - least).bit_length())
    rows = points.select("slot", "level", "n", "w", F.inline(dyadic(F.col("slot") - F.lit(least), bits)).alias("node", "asked"))
    count = lambda c: F.when(F.col("asked"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    rows = rows.select("node", "level", count("n"), "slot", count("w"))
    # Questions before the points of the same level: those are not above.
    order = [F.col("node"), F.col("level").desc(), F.col("n"), F.col("slot")]
    spread = rows.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    summed = common.written(spread.mapInArrow(_running, SUMMED), "dominance")
    ends = summed.where("slot is null").select("node", "part", "n", "w")
    # A row for each partition at most, and a table of known size: Spark sends it to all tasks below its threshold, and else deals both sides by partition and node.
    asked = summed.where("slot is not null").join(common.written(_before(ends), "before"), ["part", "node"], "left")
    zero = F.lit(0).cast("long")
    each = points.select("slot", "level", F.col("n").alias("own"), zero.alias("n"), zero.alias("w"))
    all_of_them = each.unionAll(asked.select("slot", "level", zero.alias("own"), *((F.col(c) + F.coalesce(f"{c}0", F.lit(0))).alias(c) for c in ("n", "w"))))
    return all_of_them.groupBy("slot", "level").agg(*(F.sum(c).alias(c) for c in ("own", "n", "w")))


def counted(df: DataFrame, slot: str, level: str, weight: Column, n: str = "n_above", w: str = "w_above") -> DataFrame:
    """df with the number of rows above each row, and the sum of their weights (positive whole numbers), both null where slot or level is."""
    key = common.fresh(df.columns, "point")
    known = F.col(slot).isNotNull() & F.col(level).isNotNull()
    own = df.where(known)
    points = own.groupBy(F.col(slot).cast("long").alias("slot"), F.col(level).cast("long").alias("level")).agg(F.count("*").alias("n"), F.sum(weight).cast("long").alias("w"))
    found = common.written(answers(points), "answers").select(F.struct("slot", "level").alias(key), "own", F.col("n").alias(n), F.col("w").alias(w))
    placed = own.withColumn(key, F.struct(F.col(slot).cast("long").alias("slot"), F.col(level).cast("long").alias("level")))
    met = common.hot_join(placed, found, key, "own").select(*df.columns, n, w)
    none = F.lit(None).cast("long")
    return met.unionAll(df.where(~known).withColumns({n: none, w: none}))


def slot_of(at: str, kind: str, seconds: int = SLOT_SECONDS) -> Column:
    """Whole minutes since 1970: of the wall time of a timestamp without a zone, of the instant of one with a zone."""
    whole = F.unix_seconds(F.col(at)) if kind == "timestamp" else F.unix_date(F.to_date(at)).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at)).cast("long")
    return F.floor((whole - F.pmod(whole, F.lit(seconds))) / seconds).cast("long")


def level_of(total: str) -> Column:
    value = F.floor(F.lit(float(LEVELS_A_UNIT)) * F.col(total) + F.lit(0.5))
    odd = F.isnan(total) | (F.abs(total) == F.lit(float("inf")))
    return F.when(~odd, value).cast("long")


def op13_dominance_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of an earlier minute and a larger total, of each sale. A null sale_id stands for one row."""
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    rows = sales.select("sale_id", slot_of("sold_at", sales.schema["sold_at"].dataType.typeName()).alias("slot"), level_of("total").alias("level"))
    weight = F.lit(1) + F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5, F.lit(0))
    return counted(rows, "slot", "level", weight, "n_sales", "n_rows")


#: CRC-32 bit by bit: each byte of the decimal number, then eight shifts.
_CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) for i in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)
ORACLE = f"""WITH s AS (
  SELECT sale_id, CAST(floor(epoch(sold_at) / 60) AS BIGINT) AS slot, CAST(floor(floor(100 * total + 0.5) / 1) AS BIGINT) AS level, 1 + coalesce({_CRC} % 5, 0) AS w FROM sales
), p AS (
  SELECT slot, level, CAST(count(*) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level
), c AS (
  SELECT a.slot, a.level, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_sales, CAST(coalesce(sum(b.w), 0) AS BIGINT) AS n_rows FROM p a LEFT JOIN p b ON b.slot < a.slot AND b.level > a.level GROUP BY a.slot, a.level
)
SELECT sale_id, s.slot, s.level, n_sales, n_rows FROM s LEFT JOIN c ON s.slot = c.slot AND s.level = c.level"""
