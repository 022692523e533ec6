"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into equal segments, and each segment is an index of its own. Radius 0, 1, 2 ...
of every segment is searched for all open queries at once: the query's segment with r bits
turned is joined to the index. Once radius r of all m segments is done, every code within
m * (r + 1) - 1 bits has been seen, so a query is closed as soon as its k-th distance is at
most that: nothing nearer, nor any tie, can be missing. Once a query has k results, the k-th
distance bounds its search: farther codes are refused inside the join, and at radius r only as
many segments are searched as that distance exceeds m * r by (a code whose first j + 1 segments
differ by over r bits and whose others by r or more is over m * r + j bits away). A pair that
several segments find counts at the first of its nearest segments only, so no pass removes repeats.

Equal codes are one entry with its k smallest ids, so a very common code costs no more than
a rare one; of equal distances the smaller id comes first. Rows whose id or code is null are
left out. Repeated rows are separate entries of the index. Fewer than k rows give fewer
results. An empty table gives none.
"""

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvecal.session import materialize

BITS = 64


def sign_code(vector: str) -> Column:
    """64-bit code of a column of 64 numbers: bit i is set where component i is above zero."""
    return F.expr(f"""aggregate(transform(`{vector}`, (x, i) -> CASE WHEN x > 0 THEN shiftleft(1L, i) ELSE 0L END),
                              0L, (a, b) -> a | b)""")


def _segment(code: Column, s: int, width: int) -> Column:
    return F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1))


def hits(open_queries: DataFrame, by_segment: DataFrame, radius: int, segments: int) -> DataFrame:
    """(q, distance, id) of the codes whose nearest segments are ``radius`` bits away; no farther than a query's bound."""
    width = BITS // segments
    masks = [sum(1 << b for b in c) for c in itertools.combinations(range(width), radius)]
    probes = (open_queries
              .select("q", "bound", F.posexplode(F.array(*(_segment(F.col("q"), s, width) for s in range(segments)))).alias("seg", "own"))
              .where(F.col("bound").isNull() | (F.col("seg") <= F.col("bound") - segments * radius))
              .select("q", "bound", "seg", F.explode(F.expr(f"array({', '.join(map(str, masks))})")).alias("mask"), "own")
              .select("q", "bound", "seg", F.col("own").bitwiseXOR(F.col("mask").cast("bigint")).alias("value")))
    # the optimizer does not see how many probes a query makes; they must not be broadcast
    met = probes.withColumnsRenamed({"seg": "s", "value": "v"}).join(
        by_segment.hint("shuffle_hash"), (F.col("s") == F.col("seg")) & (F.col("v") == F.col("value"))
        & (F.bit_count(F.col("q").bitwiseXOR(F.col("code"))) <= F.coalesce("bound", F.lit(BITS))))
    difference = F.col("q").bitwiseXOR(F.col("code"))
    by_bits = F.array(*(F.bit_count(_segment(difference, s, width)) for s in range(segments)))
    return (met.where((F.array_min(by_bits) == radius) & (F.array_position(by_bits, F.lit(radius)) == F.col("seg") + 1))
            .select("q", F.bit_count(difference).alias("distance"), F.explode("ids").alias("id")))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """(query_id, rank, id, distance) for tables with columns id and code (bigint)."""
    width = BITS // segments
    ids = (rows.where("id IS NOT NULL AND code IS NOT NULL")
           .withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
           .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    index = materialize(ids, "hamming-index")
    wanted = materialize(queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code"), "hamming-queries")
    open_queries = wanted.select(F.col("code").alias("q"), F.lit(None).cast("int").alias("bound")).distinct()
    reachable = index.agg(F.sum(F.least(F.size("ids"), F.lit(k)))).first()[0] or 0
    need = min(k, reachable)
    by_segment = index.select("code", "ids", F.posexplode(F.array(*(_segment(F.col("code"), s, width) for s in range(segments))))
                              .alias("seg", "value"))
    best = Window.partitionBy("q").orderBy("distance", "id")
    found = None
    for radius in range(width + 1):
        hit = hits(open_queries, by_segment, radius, segments)
        if found is not None:
            hit = hit.unionByName(found.join(open_queries, "q", "left_semi"))
        # the nearest k of what was seen so far hold the nearest k of all that is covered
        now = materialize(hit.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                          .select("q", "distance", "id"), "hamming-found")
        state = open_queries.select("q").join(now.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far")), "q", "left")
        covered = segments * (radius + 1) - 1  # or, with fewer segments searched, the bound, which holds ``far``
        short = F.coalesce(F.col("n"), F.lit(0)) < need
        remaining = materialize(state.where(short | (F.col("far") > covered)).select(
            "q", F.when(~short, F.col("far")).alias("bound")), "hamming-open")
        closed = now.join(remaining, "q", "left_anti")
        done = closed if radius == 0 else done.unionByName(closed)
        found, open_queries = now, remaining
        if remaining.isEmpty():
            break
    ranked = done.withColumn("rank", F.row_number().over(best))
    return (wanted.withColumnRenamed("id", "query_id").join(ranked, wanted.code == ranked.q)
            .select("query_id", "rank", "id", "distance"))
