"""Approximate and exact vector search."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.llm import ann, impact_topk, queries
from affinity.llm.common import table
from tests.conftest import SMALL

ODD = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 0.0], [1.0, 2.0, 3.0]]


def vectors(spark, rows, odd=ODD):
    data = [(k, [float(c) for c in v]) for k, v in rows] + [(10_000 + 100 * k, v) for k, v in enumerate(odd)] + [(None, [1.0, 1.0])]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "rep": F.lit("r"), "id": F.lit("x"), "score": F.lit(2)})


def nearest(rows, every, k):
    out = {}
    for q, a in rows:
        if q % every == 0:
            d = sorted((float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), i) for i, b in rows if i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


def test_recall(spark):
    sf = SMALL.replace("sf0.001", "sf0.1")
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    want = nearest(rows, 100, 10)
    got = {}
    for r in queries.op1_ann(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["score"])
    hits = sum(len(set(got[q]) & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * 10 * len(want)
    for q, w in want.items():
        assert sorted(x[0] for x in got[q].values()) == list(range(1, 11))
        assert all(got[q][i][1] == pytest.approx(s, abs=1e-12) for i, s in w if i in got[q])


def test_many_lists_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 8)
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 2)) * 10
    rows = [(k, (centres[k % 12] + r.normal(size=2) * 0.3).round(1)) for k in range(400)] + [(400 + k, [1.5, 1.5]) for k in range(150)]
    got = {}
    for x in ann.search(vectors(spark, rows), F.col("id") % 50 == 0, 10).orderBy("rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], pytest.approx(x["score"], abs=1e-9)))
    want = nearest(rows, 50, 10)
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)
    assert got[450] == [(400 + k, 0.0) for k in range(10)] and got[400][0] == (401, 0.0)


def test_recall_where_most_lists_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 8)
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for row in ann.search(vectors(spark, enumerate(x), []).filter("vec_id IS NOT NULL"), F.col("id") % 50 == 0, 10).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    d = np.sqrt(((x[::50, None] - x) ** 2).sum(axis=2))
    want = {50 * n: {i for i in np.argsort(own)[:11].tolist() if i != 50 * n} for n, own in enumerate(d)}
    assert set(got) == set(want)
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 10 * len(want)


def test_search_cases(spark):
    few = ann.search(vectors(spark, [(0, [1, 0]), (1, [0, 1]), (2, [0, 1])]), F.col("id") % 100 == 0, 10).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in few] == [(1, 1), (2, 2)]
    assert ann.search(vectors(spark, []).limit(0), F.lit(True), 3).count() == 0
    assert ann.search(vectors(spark, [(0, [1, 0])], []), F.col("id") == 0, 3).filter("query_id = 0").count() == 0


def test_exact_matches_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = sorted(db.sql("SELECT query_id, rank, vec_id, score FROM (" + queries.oracle_sql()["op7_exact_topk"] + ")").fetchall())
    assert sorted(map(tuple, queries.op7_exact_topk(spark, SMALL).select("query_id", "rank", "vec_id", "score").collect())) == want


@pytest.mark.parametrize("block", [40, 8192])
def test_exact_against_plain_products(spark, monkeypatch, block):
    monkeypatch.setattr(impact_topk, "BLOCK", block)
    monkeypatch.setattr(impact_topk, "QUERY_BLOCK", 5)
    r = np.random.default_rng(1)
    rows = [(k, r.normal(size=6).round(2)) for k in range(150)] + [(150 + k, [0.5, -0.5, 0.5, 0, 0, 0]) for k in range(60)] + [(300, [0.0] * 6), (350, [-1.0] * 6)]
    x = {k: np.floor(256 * np.array(v, float)).astype(int) for k, v in rows}
    got = {}
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [1.0]]
    for g in impact_topk.search(vectors(spark, rows, odd).filter("vec_id IS NOT NULL"), F.col("id") % 50 == 0, 5).orderBy("rank").collect():
        got.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    want = {q: [(i, -s) for s, i in sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]] for q in x if q % 50 == 0}
    assert got == want


def test_stops_only_on_proof():
    r = np.random.default_rng(3)
    x = r.integers(-40, 40, (3000, 16))
    index = impact_topk.ImpactIndex.load(impact_topk.ImpactIndex.dump(x))
    for q in r.integers(-40, 40, (30, 16)):
        scores = x @ q
        want = sorted(scores, reverse=True)[:6]
        at, got = index.top(q, 6, float("-inf"), np.arange(3000))
        assert got.tolist() == want and (scores[at] == got).all()
        assert index.top(q, 6, float(want[2]), np.arange(3000))[1].tolist() == [s for s in want if s >= want[2]]


@pytest.mark.parametrize("top,sums", [(40, 1), (1 << 22, 2)])
def test_a_posting_is_read_once(monkeypatch, top, sums):
    """Impacts and how often a row was met are one sum wherever both fit a double exactly, and a component's postings lie together."""
    r = np.random.default_rng(5)
    x = r.integers(-top, top, (3000, 16))
    index = impact_topk.ImpactIndex.load(impact_topk.ImpactIndex.dump(x))
    assert index.rows.flags.c_contiguous and index.impacts.flags.c_contiguous
    counted, looks, bincount, argpartition = [], [], np.bincount, np.argpartition
    monkeypatch.setattr(np, "bincount", lambda *a, **k: counted.append(1) or bincount(*a, **k))
    monkeypatch.setattr(np, "argpartition", lambda *a, **k: looks.append(1) or argpartition(*a, **k))
    for q in r.integers(-top, top, (10, 16)):
        at, got = index.top(q, 6, float("-inf"), np.arange(3000))
        assert got.tolist() == sorted((x @ q).tolist(), reverse=True)[:6] and (x[at] @ q == got).all()
    assert looks and len(counted) == sums * len(looks)


def test_few_segments_are_enough_where_impacts_differ():
    """One component decides: its postings come first and the rest is never read."""
    r = np.random.default_rng(4)
    x = r.integers(-3, 4, (4000, 12))
    x[:, 0] = r.integers(0, 4000, 4000)
    index, q = impact_topk.ImpactIndex.of(x), np.ones(12, np.int64)
    read = []
    exact = index._exact
    index._exact = lambda at, *rest: read.append(len(at)) or exact(at, *rest)
    at, got = index.top(q, 5, float("-inf"), np.arange(4000))
    assert got.tolist() == sorted(x @ q, reverse=True)[:5] and read[0] * impact_topk.EXACT <= 4000


def test_vectors_of_several_lengths_and_repeated_rows(spark):
    r = np.random.default_rng(5)
    rows = [(k, r.normal(size=3 + k % 2).round(2).tolist()) for k in range(60)] + [(7, r.normal(size=3).tolist()), (9, [1.0, 1.0, 1.0, 1.0]), (9, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search, best, score in ((ann.search, 1, lambda a, b: float(np.linalg.norm(np.array(a) - b))), (impact_topk.search, -1, lambda a, b: int(np.floor(256 * np.array(a)) @ np.floor(256 * np.array(b))))):
        got = {}
        for x in search(df, F.col("id") % 10 == 0, 12).orderBy("rank").collect():
            got.setdefault(x["query_id"], []).append((x["vec_id"], pytest.approx(x["score"])))
        assert set(got) == {0, 10, 20, 30, 40, 50}
        for q, own in got.items():
            a = rows[q][1]
            want = sorted((best * score(a, b), i) for i, b in rows if i != q and len(b) == len(a))[:12]
            assert own == [(i, best * s) for s, i in want]


def test_most_lists_are_pruned_on_clusters(spark, monkeypatch):
    """Over 300 lists: recall against brute force with a small part of the vectors read."""
    monkeypatch.setattr(ann, "LIST", 16)
    r = np.random.default_rng(0)
    centres = r.normal(size=(80, 24))
    x = np.repeat(centres, 75, axis=0) + r.normal(size=(6000, 24)) * 0.25
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    read = {}
    plain = ann._dealt
    monkeypatch.setattr(ann, "_dealt", lambda rows, graph, deal: read.setdefault("graph", graph) and read.setdefault("deals", []).append(deal) or plain(rows, graph, deal))
    got = {}
    for row in ann.search(df, F.col("id") % 100 == 0, 10).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    d = np.linalg.norm(x[::100, None] - x, axis=2)
    want = {100 * n: {i for i in np.argsort(own)[:11].tolist() if i != 100 * n} for n, own in enumerate(d)}
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 10 * len(want)
    graph, (_, ask) = read["graph"], read["deals"]
    lists = [set(l) for l in ann.copies(graph, x)]
    share = np.mean([np.mean([bool(own & set(asked)) for own in lists]) for asked in ask(graph, x[::100])])
    assert len(graph.centroids) >= 300 and share < 0.25
