"""Approximate nearest neighbours over balanced posting lists.

Vectors are dealt to posting lists of about the same length, each around a
centroid.  A vector near the boundary of several lists is copied to all of them
(but to one of several whose centroids are much alike).
Centroids are few enough to be held in memory, where a neighbourhood graph finds
those near a vector.  A query reads the lists whose centroids are at most a given
ratio farther than its nearest one, and in any case a number of the nearest, and
compares whole vectors there.  How many are needed depends on the data: each run
compares some of its queries with every vector and takes the least number that
meets the recall wanted on them.  Where that, or the ratio, asks for more lists
than the graph's search holds, the query ranks all centroids instead.

The centroids are fitted on at most ``SAMPLE`` vectors; every vector is indexed.
Lists grow in number with the vectors up to ``MAX_LISTS`` and in length beyond.
Equal vectors are indexed once and handed out by row.  Lists are cut into blocks
and queries of a list likewise, so no group grows with the data.

Cases: see ``vectors.usable`` for the rows that take no part; queries among them
get no result.  Rows that repeat an id are candidates each.  Ties go to the smaller id.  Fewer candidates than asked for are
all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm import vectors
from affinity.llm.common import forget, written

#: Vectors on which centroids are fitted, centroids at most, and vectors to a list aimed at.
SAMPLE, MAX_LISTS, LIST = 65_536, 16_384, 128
#: Lists that a vector near boundaries is copied to, how much farther than the nearest they may be, and the
#: share of its distance from a list within which two of its centroids count as one.
COPIES, NEAR, ALIKE = 4, 1.10, 0.25
#: Lists that a query reads at least, and how much farther than the nearest the others may be.
LEAST, RATIO = 4, 1.12
#: Queries of a run that are compared with every vector, and the recall wanted on them.
TRIED, RECALL = 128, 0.95
#: Neighbours of a centroid in the graph, and centroids held while a vector is dealt out and while a query is.
DEGREE, BEAM, QUERY_BEAM = 24, 16, 48
#: Most vectors and queries in one task's comparison.
BLOCK, QUERY_BLOCK = 4_096, 1_024


def balanced_centroids(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Centroids of n clusters of about equal size, by repeated balanced bisection."""
    r = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < n:
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 2:
            parts.append(own)
            break
        p = x[own]
        a, b = p[r.integers(len(own))], p[r.integers(len(own))]
        if (a == b).all():
            b = p[np.argmax(((p - a) ** 2).sum(axis=1))]
        for _ in range(8):  # two means, each given half of the points
            side = ((p - a) ** 2).sum(axis=1) - ((p - b) ** 2).sum(axis=1)
            order = np.argsort(side, kind="stable")
            half = len(own) // 2
            new_a, new_b = p[order[:half]].mean(axis=0), p[order[half:]].mean(axis=0)
            if np.allclose(new_a, a) and np.allclose(new_b, b):
                break
            a, b = new_a, new_b
        parts += [own[order[:half]], own[order[half:]]]
    return np.array([x[p].mean(axis=0) for p in parts])


@dataclass
class CentroidGraph:
    """Centroids and, for each, its near neighbours; bounded by ``MAX_LISTS``."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = DEGREE) -> CentroidGraph:
        n = len(centroids)
        degree = min(degree, max(n - 1, 1))
        near = np.zeros((n, degree), np.int64)
        squares = (centroids**2).sum(axis=1)
        for k in range(0, n, 512):
            d = squares[None, :] - 2 * centroids[k : k + 512] @ centroids.T
            d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf if n > 1 else 0
            near[k : k + 512] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        return cls(centroids, near, np.arange(0, n, max(1, n // 64))[:64])

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x, centroids near it and their distances, nearest first (-1, inf: none)."""
        c, n = self.centroids, len(x)
        beam = min(beam, len(c))

        def distances(ids: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(((c[ids] - x[:, None, :]) ** 2).sum(axis=2), 0))

        ids = np.tile(self.entries, (n, 1))
        dist, done = distances(ids), np.zeros(ids.shape, bool)
        rows = np.arange(n)[:, None]
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
            open_ = np.where(done | np.isinf(dist), np.inf, dist)
            pick = np.argsort(open_, axis=1, kind="stable")[:, :4]
            live = np.isfinite(open_[rows, pick])
            if not live.any():
                return np.where(np.isinf(dist), -1, ids), dist
            done[rows, pick] = True
            new = self.neighbours[ids[rows, pick]].reshape(n, -1)
            d = np.where(np.repeat(live, self.neighbours.shape[1], axis=1), distances(new), np.inf)
            ids, dist, done = np.hstack([ids, new]), np.hstack([dist, d]), np.hstack([done, np.zeros(new.shape, bool)])
            # one of each centroid stays, the one already expanded if there is one
            order = np.lexsort((~done, ids), axis=1)
            ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
            dist[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf


def copies(graph: CentroidGraph, x: np.ndarray) -> list[list[int]]:
    """The lists of each row of x."""
    ids, dist = graph.search(x, BEAM)
    out = []
    for near, d in zip(ids, dist):
        own = [int(near[0])]
        for j, dj in zip(near[1:], d[1:]):
            if j < 0 or dj > NEAR * d[0] or len(own) >= COPIES:
                break
            if (((graph.centroids[own] - graph.centroids[j]) ** 2).sum(axis=1) >= (ALIKE * dj) ** 2).all():
                own.append(int(j))
        out.append(own)
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance of each row of x from each of y."""
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0))


def probes(graph: CentroidGraph, x: np.ndarray, least: int = LEAST) -> list[list[int]]:
    """The lists that each row of x, a query, reads."""
    out: list[list[int]] = [[]] * len(x)
    todo = np.arange(len(x))
    if least < QUERY_BEAM < len(graph.centroids):
        ids, dist = graph.search(x, QUERY_BEAM)
        read = (ids >= 0) & ((np.arange(ids.shape[1]) < least) | (dist <= RATIO * dist[:, :1]))
        for i in np.flatnonzero(~read[:, -1]):
            out[i] = ids[i, read[i]].tolist()
        todo = np.flatnonzero(read[:, -1])  # more may be as near as the last one held
    if len(todo):
        dist = _apart(x[todo], graph.centroids)
        order = np.argsort(dist, axis=1, kind="stable")
        dist = np.take_along_axis(dist, order, axis=1)
        read = (np.arange(dist.shape[1]) < least) | (dist <= RATIO * dist[:, :1])
        for i, near, r in zip(todo, order, read):
            out[i] = near[r].tolist()
    return out


def calibrated(unique: DataFrame, asking: DataFrame, graph: CentroidGraph, k: int) -> int:
    """The nearest lists that a query must read so that ``RECALL`` of the k nearest classes are met.

    asking: the classes (rep, v) of queries, of which ``TRIED`` are compared with every class.
    """
    tried = asking.orderBy(F.xxhash64("rep"), "rep").limit(TRIED).toPandas()
    if not len(tried):
        return LEAST
    own, x = tried["rep"].to_numpy(), np.array(tried["v"].tolist(), np.float64)
    shared = unique.sparkSession.sparkContext.broadcast((own, x))  # at most TRIED rows

    def parts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, x = shared.value
        reps, best = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0))
        for pdf in it:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                ids = part["rep"].to_numpy()
                d = _apart(x, np.array(part["v"].tolist(), np.float64))
                d[own[:, None] == ids] = np.inf
                best, reps = np.hstack([best, d]), np.hstack([reps, np.tile(ids, (len(own), 1))])
                order = np.argsort(best, axis=1, kind="stable")[:, :k]
                best, reps = np.take_along_axis(best, order, axis=1), np.take_along_axis(reps, order, axis=1)
        q, keep = np.repeat(own, best.shape[1]), np.isfinite(best.ravel())
        yield pd.DataFrame({"q": q[keep], "rep": reps.ravel()[keep], "score": best.ravel()[keep]})

    found = vectors.best_classes(unique.mapInPandas(parts, "q long, rep long, score double"), k, nearest=True)
    near = unique.join(F.broadcast(found.select("q", "rep")), "rep").select("q", "v").toPandas()  # at most TRIED * k rows
    if not len(near):
        return LEAST
    dist = _apart(x, graph.centroids)
    place = np.argsort(np.argsort(dist, axis=1, kind="stable"), axis=1)
    row = {q: n for n, q in enumerate(own)}
    needed = []
    for q, lists in zip(near["q"], copies(graph, np.array(near["v"].tolist(), np.float64))):
        n = row[q]
        needed.append(0 if (dist[n, lists] <= RATIO * dist[n].min()).any() else int(place[n, lists].min()) + 1)
    return max(LEAST, sorted(needed)[int(np.ceil(RECALL * len(needed))) - 1])


def fit(unique: DataFrame, lists: int | None = None) -> CentroidGraph:
    """The graph of centroids for classes (rep, v)."""
    n = unique.count()
    sample = unique.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toPandas()
    if not len(sample):
        return CentroidGraph.build(np.zeros((1, 1)))
    x = np.array(sample["v"].tolist(), np.float64)
    return CentroidGraph.build(balanced_centroids(x, lists or min(max(n // LIST, 1), MAX_LISTS, max(len(x) // 4, 1))))


def _dealt(rows: DataFrame, graph: CentroidGraph, deal) -> DataFrame:
    """(list, rep, vec) for every list that ``deal`` names for a row."""
    shared = rows.sparkSession.sparkContext.broadcast(graph)  # bounded by MAX_LISTS

    def parts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                x = np.array(part["v"].tolist(), np.float64)
                lists = deal(shared.value, x)
                at = np.repeat(np.arange(len(part)), [len(l) for l in lists])
                yield pd.DataFrame({"list": np.concatenate(lists).astype(np.int32), "rep": part["rep"].to_numpy()[at], "vec": [x[i].tobytes() for i in at]})

    return rows.mapInPandas(parts, "list int, rep long, vec binary")


def _search(use: DataFrame, is_query, k: int) -> DataFrame:
    """The search among vectors of one length."""
    placed, unique = vectors.classes(use)
    graph = fit(unique)
    queries = placed.filter(is_query)
    postings = written(_dealt(unique, graph, copies), "postings")
    asking = unique.join(queries.select("rep").distinct(), "rep", "left_semi")
    least = calibrated(unique, asking, graph, k)
    asked = written(_dealt(asking, graph, lambda g, x: probes(g, x, least)).select("list", F.col("rep").alias("q"), F.col("vec").alias("qvec")), "asked")

    # rows of a list and of its queries, at most MAX_LISTS rows, decide into how many blocks they go
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    sizes = F.broadcast(sizes.join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq")), "list"))
    left = postings.join(sizes, "list").select("list", F.pmod(F.xxhash64("rep"), "nb").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("c"), "rep", "vec")
    right = asked.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.pmod(F.xxhash64("q"), "nq").cast("int").alias("c"), "q", "qvec")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x, reps = vectors.matrix(a["vec"]), a["rep"].to_numpy()
            for q, y in zip(b["q"], vectors.matrix(b["qvec"])):
                d = x - y
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                best = np.lexsort((reps, d))[: k + 1]
                out.append(pd.DataFrame({"q": q, "rep": reps[best], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "score": []})

    keys = ["list", "b", "c"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(compare, "q long, rep long, score double")
    found = written(vectors.best_classes(found, k + 1, nearest=True), "found")
    out = written(vectors.by_row(placed, queries, found, k, nearest=True), "nearest")
    for t in (placed, unique, postings, asked, found):
        forget(t)
    return out


def search(rows: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row.

    is_query: a condition on ``id``.  score: Euclidean distance.
    """
    found = [_search(use, is_query, k) for use in vectors.usable(rows, id_col, vec_col, zero=False).values()]
    return vectors.together(found, k, nearest=True) if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
