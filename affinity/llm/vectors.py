"""What the two vector searches share: usable rows, classes of equal vectors, results by row."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.llm.common import written

#: Salts by which the members of one class are cut before they are ranked.
SALTS = 64


def usable(rows: DataFrame, id_col: str, vec_col: str, zero: bool) -> dict[int, DataFrame]:
    """id and v (array<double>) of the rows that take part, by the length of their vectors.

    Left out: null ids, null or empty vectors, vectors with null or non-finite
    components, and zero vectors unless ``zero``.  Vectors are compared with those
    of their own length; there is a search for each length that occurs.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    inf = float("inf")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    return {n: rows.filter(F.size("v") == n) for n in lengths}


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, rep) and classes (rep, v): one for each distinct vector, named by its least id."""
    unique = written(rows.groupBy("v").agg(F.min("id").alias("rep")), "classes")
    # the join's large partitions, of a very common vector, are split by Spark
    placed = written(rows.join(unique, "v").select("id", "rep"), "rows")
    return placed, unique


def pack(v: Column | np.ndarray, kind=np.float64) -> bytes:
    return np.asarray(v, kind).tobytes()


def matrix(column, kind=np.float64) -> np.ndarray:
    """The rows of a column of packed vectors as a matrix."""
    n = len(column)
    return np.frombuffer(b"".join(column), kind).reshape(n, -1)


def by_row(placed: DataFrame, queries: DataFrame, found: DataFrame, k: int, nearest: bool) -> DataFrame:
    """query_id, rank, vec_id and score from what was found for classes.

    queries: id, rep of the query rows.  found: q (class of a query), rep, score;
    the k + 1 best classes of each.  Every class holds at least one row, so these
    hold the k best rows besides the query itself; of a class its k + 1 least ids
    are enough, and k rows of each.  Rows that repeat an id are candidates each.  A
    query's id that has several vectors asks with all of them, and a candidate
    counts with the best of its scores.
    """
    wanted = found.select("rep").distinct()
    held = placed.join(wanted, "rep", "left_semi").groupBy("rep", "id").agg(F.least(F.count("*"), F.lit(k)).alias("copies")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (["rep", "salt"], ["rep"]):
        held = held.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(f"n <= {k + 1}")
    held = held.select("rep", F.col("id").alias("vec_id"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    order = F.col("score").asc() if nearest else F.col("score").desc()
    best = F.min("score") if nearest else F.max("score")
    rows = queries.distinct().select(F.col("id").alias("query_id"), F.col("rep").alias("q")).join(found, "q").join(held, "rep").filter("query_id <> vec_id")
    rows = rows.groupBy("query_id", "rep", "vec_id", "copy").agg(best.alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))).filter(f"rank <= {k}")
    return rows.select("query_id", "rank", "vec_id", "score")


def together(found: list[DataFrame], k: int, nearest: bool) -> DataFrame:
    """The results of the searches for each length of vector as one."""
    if len(found) == 1:
        return found[0]
    rows = reduce(DataFrame.unionByName, found).drop("rank")
    order = F.col("score").asc() if nearest else F.col("score").desc()
    # only an id with vectors of several lengths has rows in more than one of them
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))).filter(f"rank <= {k}")
    return rows.select("query_id", "rank", "vec_id", "score")


def best_classes(found: DataFrame, k: int, nearest: bool) -> DataFrame:
    """The k best (rep, score) of each q, among pairs that may be repeated."""
    order = F.col("score").asc() if nearest else F.col("score").desc()
    found = found.groupBy("q", "rep").agg(F.first("score").alias("score"))
    return found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(order, "rep"))).filter(f"n <= {k}").drop("n")
