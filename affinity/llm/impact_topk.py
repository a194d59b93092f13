"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are whole numbers.  Vectors are dealt to blocks, and each block is
indexed once and written: for every component its range is cut into levels of
quantised impact, and a segment holds the rows of one level, with the largest and
the least impact in it.  A query takes the segments of all components by the most
that one posting of them adds to a score, largest first, and adds their impacts
up by row.  After a part of the postings it looks whether it may stop: for each row, its sum plus the most that
is left for components that the row was not met in, against a score that k rows
are known to reach.  It stops only when few rows are left that may get there, or
when all segments are through, and those rows are scored exactly; so the result
is proven to be whole.

Each query meets its own block first; its k-th score there is the threshold that
lets the other blocks stop early.  Blocks of vectors and blocks of queries are
of fixed size, so no group grows with the data.

Cases: see ``vectors.usable`` for the rows that take no part (zero vectors do);
queries among them get no result.  Ties go to the smaller id.  Fewer candidates
than asked for are all returned.  Equal vectors are indexed once and handed out
by row, rows that repeat an id included.  Scores must stay below 2^53.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm import vectors
from affinity.llm.common import forget, written

#: Vectors of an index block and queries of a query block.
BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Levels of quantised impact of a component.
LEVELS = 64
#: Shares of the postings after which a query looks whether it may stop, and the part of a block's rows (one in so many) that it scores exactly at once.
LOOKS, EXACT = (0.1, 0.5, 0.65, 0.8, 1.0), 8


def _slim(a: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    for kind in (np.int8, np.int16, np.int32):
        if not a.size or np.iinfo(kind).min <= a.min() and a.max() <= np.iinfo(kind).max:
            return a.astype(kind)
    return a


class ImpactIndex:
    """A block of whole-number vectors by component and level of impact."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, ends: np.ndarray, most: np.ndarray, least: np.ndarray):
        self.x = x.astype(np.float64)  # sums stay exact below 2^53
        # by component: rows from the least level up, those of one component next to each other in memory; where each level ends
        self.rows, self.ends = np.ascontiguousarray(rows), ends.astype(np.int64)
        self.most, self.least = most.astype(np.float64), least.astype(np.float64)  # by component and level
        self.impacts = np.ascontiguousarray(np.take_along_axis(self.x.T, self.rows.astype(np.int64), axis=1))  # by component and posting
        self.reach = np.maximum(np.abs(self.most), np.abs(self.least)).max(axis=1)  # by component: the largest impact, of either sign
        self._rows, self._adds = np.zeros(0, np.int64), np.zeros(0)

    @classmethod
    def parts(cls, x: np.ndarray) -> dict[str, np.ndarray]:
        """The arrays of an index of x, one row for each vector."""
        n, d = x.shape
        low, high = x.min(axis=0), x.max(axis=0)
        step = np.maximum(-(-(high - low + 1) // LEVELS), 1)
        level = (x - low) // step
        order = np.argsort(level, axis=0, kind="stable").T
        sorted_levels = np.take_along_axis(level.T, order, axis=1)
        ends = np.array([np.searchsorted(own, np.arange(LEVELS), "right") for own in sorted_levels])
        impacts = np.take_along_axis(x.T, order, axis=1)
        most, least = np.zeros((d, LEVELS), np.int64), np.zeros((d, LEVELS), np.int64)
        np.maximum.at(full := np.full((d, LEVELS), np.iinfo(np.int64).min), (np.arange(d)[:, None], sorted_levels), impacts)
        np.minimum.at(bare := np.full((d, LEVELS), np.iinfo(np.int64).max), (np.arange(d)[:, None], sorted_levels), impacts)
        some = np.diff(ends, prepend=0, axis=1) > 0
        most[some], least[some] = full[some], bare[some]
        return {"x": _slim(x), "rows": order.astype(np.uint16 if n <= 1 << 16 else np.int64), "ends": ends.astype(np.int32), "most": _slim(most), "least": _slim(least)}

    @classmethod
    def of(cls, x: np.ndarray) -> ImpactIndex:
        return cls(**cls.parts(x))

    @classmethod
    def dump(cls, x: np.ndarray) -> bytes:
        file = io.BytesIO()
        np.savez(file, **cls.parts(x))
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> ImpactIndex:
        with np.load(io.BytesIO(data)) as parts:
            return cls(**parts)

    def top(self, q: np.ndarray, k: int, known: float, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, or of those that reach ``known`` if that proves fewer enough."""
        n = len(self.x)
        parts = np.flatnonzero(q)
        if not len(parts):
            return self._exact(np.arange(n), q, k, known, names)
        w = q[parts].astype(np.float64)
        up = w > 0
        # by component taken: levels in the order in which they are read, what a posting of each adds, and where each ends
        adds = np.where(up[:, None], self.most[parts, ::-1], self.least[parts]) * w[:, None]
        sizes = np.diff(self.ends[parts], prepend=0, axis=1)
        sizes = np.where(up[:, None], sizes[:, ::-1], sizes)
        adds = np.where(sizes > 0, adds, -np.inf)
        ends = np.cumsum(sizes, axis=1)
        bars = adds.ravel()[ranked := np.argsort(-adds, axis=None)]  # equal ones share a bar, so their order is nothing
        through = np.cumsum(sizes.ravel()[ranked])
        total, score, met = int(through[-1]), np.zeros(n), np.zeros(n)
        # one sum holds the impacts of a row and, in steps of over four times what they can come to, how many were met
        step = float(np.exp2(np.ceil(np.log2(4 * (self.reach[parts] * np.abs(w)).sum() + 4))))
        together = step * (len(parts) + 1) < 2.0**53
        done = np.zeros(len(parts), np.int64)  # postings read of each component
        weights, columns = w.tolist(), parts.tolist()
        for share in LOOKS:
            # all segments that add as much as the last one of this share
            bar = bars[min(int(np.searchsorted(through, share * total)), len(bars) - 1)] if share < 1 else -np.inf
            read = np.where((reach := (adds >= bar) & (sizes > 0)).any(axis=1), ends[np.arange(len(parts)), adds.shape[1] - 1 - reach[:, ::-1].argmax(axis=1)], 0) if share < 1 else ends[:, -1]
            (rows, add), m = self._room(int(np.maximum(read - done, 0).sum())), 0
            for d, weight, a, b in zip(columns, weights, done.tolist(), read.tolist()):
                if b > a:
                    part, to = slice(n - b, n - a) if weight > 0 else slice(a, b), slice(m, m + b - a)
                    rows[to] = self.rows[d, part]
                    np.multiply(self.impacts[d, part], weight, out=add[to])
                    m += b - a
            if m and together:
                np.add(add[:m], step, out=add[:m])
                sums = np.bincount(rows[:m], add[:m], n)
                times = np.rint(sums / step)
                met += times
                score += sums - times * step
            elif m:
                score += np.bincount(rows[:m], add[:m], n)
                met += np.bincount(rows[:m], minlength=n)
            done = np.maximum(done, read)
            # the most that is left: by component never met, or the largest of those begun
            left = np.max(np.where((ends > done[:, None]) & (sizes > 0), adds, -np.inf), axis=1)
            begun, over = done > 0, done < n
            unmet = left[~begun].sum()
            ahead = left[begun & over].max(initial=-np.inf)
            rest = begun.sum() - met
            most = score + unmet + np.where(rest > 0, rest * ahead, 0.0) if np.isfinite(ahead) else score + unmet
            first = np.argpartition(-score, min(k, n - 1))[:k]
            if len(first) >= k:
                known = max(known, float((self.x[first] @ q.astype(np.float64)).min()))
            may = np.flatnonzero(most >= known)
            if len(may) * EXACT <= n or share == 1:
                return self._exact(may, q, k, known, names)
        raise AssertionError

    def _room(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Space for the rows and impacts of m postings, kept for the next query."""
        if len(self._rows) < m:
            self._rows, self._adds = np.empty(m, np.int64), np.empty(m)
        return self._rows, self._adds

    def _exact(self, at: np.ndarray, q: np.ndarray, k: int, known: float, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = (self.x[at] @ q.astype(np.float64)).astype(np.int64)
        reach = s >= known
        at, s = at[reach], s[reach]
        best = np.lexsort((names[at], -s))[:k]
        return at[best], s[best]


def whole(v: Column, scale: float) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))


def _packed(rows: DataFrame) -> DataFrame:
    """b, rep and the vector as bytes of whole numbers."""

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"b": pdf["b"], "rep": pdf["rep"], "vec": [np.asarray(v, np.float64).astype(np.int64).tobytes() for v in pdf["v"]]})

    return rows.mapInPandas(pack, "b int, rep long, vec binary")


def _indexed(packed: DataFrame) -> DataFrame:
    """A row for each block: b, the classes in it, and the index of their vectors."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": pdf["b"].iloc[:1], "reps": [pdf["rep"].to_numpy(np.int64).tobytes()], "data": [ImpactIndex.dump(vectors.matrix(pdf["vec"], np.int64))]})

    return packed.groupBy("b").applyInPandas(build, "b int, reps binary, data binary")


def _blocks(index: DataFrame, asked: DataFrame, k: int, n_query_blocks: int) -> DataFrame:
    """(q, rep, score): for every query the best of each block it is asked of.

    index: b, reps, data.  asked: b, c, q, qvec, known.
    """

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            names = np.frombuffer(a["reps"].iat[0], np.int64)
            block = ImpactIndex.load(a["data"].iat[0])
            for q, y, known in zip(b["q"], vectors.matrix(b["qvec"], np.int64), b["known"]):
                at, score = block.top(y, k, known, names)
                out.append(pd.DataFrame({"q": q, "rep": names[at], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "score": []})

    left = index.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    return left.groupBy("b", "c").cogroup(asked.groupBy("b", "c")).applyInPandas(search, "q long, rep long, score long")


def _search(use: DataFrame, is_query, k: int, scale: float) -> DataFrame:
    """The search among vectors of one length."""
    placed, unique = vectors.classes(use.withColumn("v", whole(F.col("v"), scale)))
    queries = placed.filter(is_query)
    n_blocks = max(1, -(-unique.count() // BLOCK))
    packed = written(_packed(unique.select(F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int").alias("b"), "rep", "v")), "packed")
    index = written(_indexed(packed), "index")
    own = packed.join(queries.select("rep").distinct(), "rep", "left_semi").select(F.col("b").alias("own"), F.col("rep").alias("q"), F.col("vec").alias("qvec"))
    n_query_blocks = max(1, -(-own.count() // QUERY_BLOCK))
    own = own.withColumn("c", F.pmod(F.xxhash64("q", F.lit(1)), F.lit(n_query_blocks)).cast("int"))

    # k + 1: a query's own class may hold nothing besides the query
    first = written(_blocks(index, own.select(F.col("own").alias("b"), "c", "q", "qvec", F.lit(float("-inf")).alias("known")), k + 1, n_query_blocks), "first")
    known = first.groupBy("q").agg(F.when(F.count("*") > k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("known"))
    others = own.join(known, "q").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).filter("b <> own")
    rest = _blocks(index, others.select("b", "c", "q", "qvec", "known"), k + 1, n_query_blocks)
    found = written(vectors.best_classes(first.unionByName(rest), k + 1, nearest=False), "found")
    out = written(vectors.by_row(placed, queries, found, k, nearest=False), "nearest")
    for t in (placed, unique, packed, index, first, found):
        forget(t)
    return out


def search(rows: DataFrame, is_query, k: int, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each query row.

    is_query: a condition on ``id``.
    """
    found = [_search(use, is_query, k, scale) for use in vectors.usable(rows, id_col, vec_col, zero=True).values()]
    return vectors.together(found, k, nearest=False) if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
