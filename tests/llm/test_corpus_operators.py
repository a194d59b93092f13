"""Near duplicates, components, mixing, packing, language model and the pipeline."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinity.llm import components, lm_score, mixing, near_dedup, ngram_trie, packing, queries
from affinity.llm.common import table
from affinity.llm.elias_fano import EliasFano
from tests.conftest import SMALL
from tests.llm.test_text_operators import documents


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()


def plain_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


# --- near duplicates


def test_given_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    want = plain_components(texts)
    got = queries.op10_near_dedup(spark, SMALL).collect()
    assert len(got) == len(texts)
    assert all((r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles(texts[r["doc_id"]])), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]) for r in got)


@pytest.mark.parametrize("block", [512, 7])
def test_group_of_near_copies(spark, monkeypatch, block):
    """Near copies of which few are linked with the least id, so that links run through others."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "MASKS", (0,))
    r = random.Random(3)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(80)]
    texts, now = {}, list(base)
    for k in range(60):
        texts[k] = " ".join(now)
        source = list(texts[r.randint(max(0, k - 6), k)].split())
        for _ in range(2):
            source[r.randint(0, 79)] = f"x{r.randint(0, 10**6)}"
        now = source
    texts |= {100 + k: texts[5] for k in range(40)}  # exact copies
    want = plain_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicate_cases(spark):
    docs = documents(spark, [None, "", " \t", "One two", "one  TWO", "ÉTÉ a", "été a", "x " * 20_000, "a b c d e f", "a b c d e f"])
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 6), 7: (1, 7), 8: (2, 8), 9: (2, 8), None: (1, None)}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    two = spark.createDataFrame([(5, "p q r s t"), (5, "k l m n o"), (7, "k l m n o"), (9, "p q r s t")], "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(two).collect()} == {5}


def test_components_against_union_find(spark):
    r = random.Random(1)
    pairs = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5, 5), (None, 3)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["id"]: x["component"] for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


# --- packing


def test_packing_keeps_every_token(spark):
    docs = documents(spark, [None, "", "a b c", "w " * 20_000, *(["t " * k for k in range(1, 300, 7)])])
    got = packing.pack_documents(docs).toPandas()
    total = docs.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)) + 1)).first()[0]
    assert got["length"].sum() == total and set(got["capacity"]) <= set(packing.LENGTHS)
    for _, g in got.sort_values("place").groupby("bin"):
        assert g["place"].tolist() == [0, *g["length"].cumsum()[:-1]]
        least = min(c for c in packing.LENGTHS if c >= g["length"].sum())
        assert set(g["capacity"]) == {least}
    long = got[got["doc_id"] == 3].sort_values("piece")
    assert long["length"].sum() == 20_001 and long["start"].tolist() == [0, 8192, 16384]
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert packing.pack_documents(docs, length="n").agg(F.sum("length")).first()[0] == docs.agg(F.sum(F.coalesce("n", F.lit(0)) + 1)).first()[0]


def test_best_fit_by_hand():
    bins, places, contents = packing.pack([7, 6, 4, 3], [10], float, 10)
    assert bins.tolist() == [0, 1, 1, 0] and places.tolist() == [0, 0, 6, 7] and contents.tolist() == [10, 10]
    # small sizes pay: two bins of 5 cost less than one of 20
    _, _, lengths = packing.best_packing([5, 5], [5, 20], lambda c: c * c)
    assert lengths.tolist() == [5, 5]
    r = np.random.default_rng(0)
    sizes = sorted(r.integers(1, 900, 400).tolist(), reverse=True)
    one = packing.best_packing(sizes, [1024], packing.sequence_cost)[2]
    many = packing.best_packing(sizes, [256, 512, 1024], packing.sequence_cost)[2]
    cost = lambda x: sum(map(packing.sequence_cost, x.tolist()))
    assert cost(many) <= cost(one) and one.sum() < 1.1 * sum(sizes)


def plain_best_fit(sizes, permitted, largest):
    """Each size into the fullest open bin that holds it, else into a new one."""
    bins, rooms, contents = [], [], []
    for size in sizes:
        fits = [(room, -k) for k, room in enumerate(rooms) if room >= size]
        if fits:
            b = -min(fits)[1] if len({r for r, _ in fits}) == len(fits) else None
            least = min(r for r, _ in fits)
            b = [k for k, room in enumerate(rooms) if room == least]
            b = max(b, key=lambda k: last[k])
        else:
            options = [c for c in permitted if c >= size]
            options = [c for c in options if c <= largest] or options[:1]
            room = min(options, key=lambda c: (packing.sequence_cost(c) / c, c))
            b = len(rooms)
            rooms.append(room)
            contents.append(0)
            if b == 0:
                last = {}
        bins.append(b)
        contents[b] += size
        rooms[b] -= size
        last[b] = len(bins)
    return bins, contents


def test_packing_against_plain_best_fit(spark):
    """The query's bins on all given documents are those of a plain best fit over all permitted lengths."""
    got = queries.op2_packing(spark, SMALL).toPandas()
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    tokens = {i: len((t or "").encode().split()) + 1 for i, t in texts.items()}
    assert got.groupby("doc_id")["length"].sum().to_dict() == tokens
    assert sum(tokens.values()) <= packing.GROUP_TOKENS
    sizes = sorted((min(8192, n - at) for n in tokens.values() for at in range(0, n, 8192)), reverse=True)
    best = None
    for largest in packing.LENGTHS:
        _, contents = plain_best_fit(sizes, packing.LENGTHS, largest)
        final = [min(c for c in packing.LENGTHS if c >= n) for n in contents]
        cost = sum(map(packing.sequence_cost, final))
        if best is None or cost < best[0]:
            best = cost, sorted(zip(contents, final))
    bins = got.groupby("bin").agg(n=("length", "sum"), capacity=("capacity", "first"))
    assert sorted(zip(bins["n"].tolist(), bins["capacity"].tolist())) == best[1]


def test_large_ids_beside_a_missing_one(spark):
    ids = [2**53 + 1, None, 2**53 + 3]
    docs = spark.createDataFrame([(i, f"a b c d e f {i}") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in packing.pack_documents(docs).collect()} == set(ids)
    for r in near_dedup.near_duplicates(docs).collect():
        assert r["component_id"] == r["doc_id"] and r["doc_id"] in ids
    assert {r["doc_id"] for r in lm_score.score(docs, F.lit(False)).collect()} == set(ids)


# --- mixing


def test_targets_are_met(spark):
    got = queries.op3_mixing(spark, SMALL).toPandas()
    n = got["n_tokens"].sum()
    for d, w in queries.LANGUAGES.items():
        assert (got[f"p_{d}"] * got["n_tokens"] * got["rate"]).sum() / n == pytest.approx(w, abs=1e-5)
    assert (got["rate"] >= 0).all() and np.allclose(got[[f"p_{d}" for d in queries.LANGUAGES]].sum(axis=1), 1)
    assert ((got["copies"] - got["rate"]).abs() < 1).all()


def test_memberships_against_plain_naive_bayes(spark):
    texts = {r["doc_id"]: (r["text"] or "") for r in table(spark, SMALL, "documents").collect()}
    langs = {r["doc_id"]: r["lang"] for r in table(spark, SMALL, "documents").collect()}
    labelled = {r["doc_id"] for r in table(spark, SMALL, "labels").collect()} & set(texts)
    domains = sorted(queries.LANGUAGES)
    words = {i: set(t.encode().lower().split()) for i, t in texts.items()}
    size = collections.Counter(langs[i] for i in labelled if langs[i] in domains)
    count = {d: collections.Counter(w for i in labelled if langs[i] == d for w in words[i]) for d in domains}
    total = sum(count.values(), collections.Counter())
    least = min(c for c in set(total.values()) if sum(n >= c for n in total.values()) <= mixing.VOCABULARY)
    vocabulary = {w for w, n in total.items() if n >= least}
    n = sum(size.values())
    for r in queries.op3_mixing(spark, SMALL).collect():
        met = words[r["doc_id"]] & vocabulary
        scale = min(1.0, mixing.EVIDENCE / max(len(met), 1))
        logs = [math.log((size[d] + 1) / (n + len(domains))) + scale * sum(math.log((count[d][w] + 0.5) / (size[d] + 1)) for w in met) for d in domains]
        e = [math.exp(x - max(logs)) for x in logs]
        assert all(r[f"p_{d}"] == pytest.approx(x / sum(e), abs=1e-9) for d, x in zip(domains, e))
        assert r["residual"] < 1e-6


def test_targets_that_cannot_be_met(spark):
    rows = spark.createDataFrame([(i, "same words here") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, domain string")
    assert mixing.mix(rows, labels, {"a": 0.9, "b": 0.1}, steps=3).first()["residual"] > 0.1
    with pytest.raises(mixing.TargetsMissed):
        mixing.mix(rows, labels, {"a": 0.9, "b": 0.1}, steps=3, tolerance=0.01)


def test_rates_against_plain_projected_gradient(spark):
    r = np.random.default_rng(2)
    n, p = r.integers(1, 500, 60), r.dirichlet([0.3, 0.3, 0.3], 60)
    targets, floor = [0.7, 0.2, 0.1], 0.6
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n long, p array<double>")
    rate, info = mixing.fit_rates(rows, targets, floor)
    got = np.array([x[0] for x in rows.select(rate.alias("r")).collect()])
    assert (got >= floor - 1e-12).all()
    share, want = n / n.sum(), np.array(targets)
    weigh = np.linalg.inv((p * share[:, None]).T @ p + 1e-9 * np.eye(3))
    plain = np.ones(60)
    for _ in range(info["steps"]):
        plain = np.maximum(floor, plain - p @ (weigh @ ((plain * share) @ p - want)))
    assert np.abs(plain - got).max() < 1e-6


def test_floor_of_one_meets_the_targets(spark):
    docs = table(spark, SMALL, "documents")
    got = mixing.mix(docs, queries.labelled_languages(docs, table(spark, SMALL, "labels")), queries.LANGUAGES, floor=1.0).toPandas()
    assert (got["rate"] >= 1).all() and (got["copies"] >= 1).all() and (got["residual"] < 1e-6).all()
    tokens = {d: (got["rate"] * got["n_tokens"] * got[f"p_{d}"]).sum() for d in queries.LANGUAGES}
    assert all(t / sum(tokens.values()) == pytest.approx(queries.LANGUAGES[d], abs=1e-6) for d, t in tokens.items())


def test_mixing_cases(spark):
    docs = documents(spark).withColumns({"word": F.lit("w"), "met": F.lit(1), "rate": F.lit(9.0)})
    labels = spark.createDataFrame([(3, "a"), (3, "a"), (4, "b"), (5, "zz"), (6, None), (None, "a")], "doc_id long, domain string")
    got = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5})
    assert got.count() == docs.count() and got.filter("rate IS NULL OR rate < 0").count() == 0
    assert mixing.mix(docs, labels.limit(0), {"a": 1.0}).filter("abs(rate - 1) > 1e-6").count() == 0
    assert mixing.mix(docs.limit(0), labels, {"a": 0.5, "b": 0.5}).count() == 0
    more = mixing.mixed(docs, labels, {"a": 0.3, "b": 0.7}, floor=1.0)
    assert more.columns == docs.columns and more.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


# --- language model


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (500, 400), (3000, 10**12), (70_000, 10**6)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top, n).astype(np.uint64))
    e = EliasFano(EliasFano.encode(v).buffer)
    assert (e.decode() == v).all()
    v = np.unique(v)
    e = EliasFano.encode(v)
    asked = np.concatenate([v[:: max(1, len(v) // 50)], np.array([0, 1, 5, top - 1, top + 10], np.uint64)])
    want = [int(np.searchsorted(v, x)) if x in set(v.tolist()) else -1 for x in asked.tolist()]
    assert e.find(asked).tolist() == want
    places = np.arange(0, len(v), max(1, len(v) // 70))
    assert (e.at(places) == v[places]).all()


def test_search_decodes_no_level(monkeypatch):
    monkeypatch.delattr(EliasFano, "decode")
    r = np.random.default_rng(7)
    words, before, follower = (r.integers(1, 60, 4000).astype(np.uint64) for _ in range(3))
    of, n3 = np.arange(4000), r.integers(0, 3, 4000).astype(float)
    first = words + before
    shared = (words + before) % 7 == 0
    trie = ngram_trie.Trie.mapped(ngram_trie.Trie.build(words, before, n3, first.astype(float), shared, of, follower, n3, 100.0).dump())
    two, over, three = (ngram_trie.value(x) for x in trie.lookup(words, before, of, follower))
    c2, c3, types = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    rows = list(zip(words.tolist(), before.tolist(), follower.tolist(), n3.tolist(), shared.tolist()))
    for v, u, w, c, _ in rows:
        c2[v, u] += c
        c3[v, u, w] += c
        if c:
            types[v, u].add(w)
    for k, (v, u, w, _, hot) in enumerate(rows):
        c, m = c2[v, u], 6 * (v + u) ** 0.85
        assert two[k] == pytest.approx(c / (v + u + m), rel=0.001)
        assert over[k] == pytest.approx(0 if hot or not c else 0.9 * len(types[v, u]) / c, rel=0.001)
        assert three[k] == pytest.approx(c3[v, u, w] / 100 if hot else max(c3[v, u, w] - 0.9, 0) / max(c, 1), rel=0.001)


def plain_scores(texts, held_out, shard_tokens):
    toks = {i: (x or "").encode().lower().split() + [b""] for i, x in texts.items()}
    c = [collections.Counter() for _ in range(3)]
    for i, w in toks.items():
        if not held_out(i):
            x = [b"", *w]
            c[0].update(w)
            c[1].update(zip(x, x[1:]))
            c[2].update(zip(x, x[1:], x[2:]))
    of, types = [collections.Counter(), collections.Counter()], collections.Counter()
    for k in (0, 1):
        for g, n in c[k + 1].items():
            of[k][g[:-1]] += n
    for g in c[2]:
        types[g[:-1]] += 1
    n = sum(c[0].values())
    shards = max(8, -(-sum(map(len, toks.values())) // shard_tokens))
    out = {}
    for i, w in toks.items():
        x, base, score = [None, b"", *w], 0.0, 0.0
        for k in range(2, len(x)):
            p = (c[0][x[k]] + 1) / (n + len(c[0]) + 1)
            base += math.log10(p)
            if total := of[0][x[k - 1],]:
                m = 6 * total**0.85
                p = (c[1][x[k - 1], x[k]] + m * p) / (total + m)
            u, v = x[k - 2], x[k - 1]
            if total := of[1][u, v]:
                if 4 * shards * min(c[0][u], c[0][v]) / n > 1:  # its followers are dealt to several shards
                    p = (c[2][u, v, x[k]] + 0.9 * p) / (total + 0.9)
                else:
                    p = (max(c[2][u, v, x[k]] - 0.9, 0) + 0.9 * types[u, v] * p) / total
            score += math.log10(p)
        out[i] = (len(w), sum(c[0][y] > 0 for y in w), base, score)
    return out, n


@pytest.mark.parametrize("size", [lm_score.BLOCK_TOKENS, 3000])
def test_scores_against_plain_counts(spark, monkeypatch, size):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", size)
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", size)
    monkeypatch.setattr(lm_score, "TASK_TOKENS", 10 * size)
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    want, n = plain_scores(texts, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, size)
    got = queries.op9_lm_score(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        tokens, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and abs(r["score"] - score) < 0.0005 * tokens


def one_form_scores(texts, held_out):
    """Scores by plain counts, every pair by the same form."""
    toks = {i: (x or "").encode().lower().split() + [b""] for i, x in texts.items()}
    one, two, three, of_one, of_two, types = (collections.Counter() for _ in range(6))
    for i, w in toks.items():
        if not held_out(i):
            x = [b"", *w]
            one.update(w)
            two.update(zip(x, x[1:]))
            three.update(zip(x, x[1:], x[2:]))
    for (u, _), n in two.items():
        of_one[u] += n
    for (u, v, _), n in three.items():
        of_two[u, v] += n
        types[u, v] += 1
    n, out = sum(one.values()), {}
    for i, w in toks.items():
        score, before = 0.0, (None, b"")
        for t in w:
            p = (one[t] + 1) / (n + len(one) + 1)
            if c := of_one[before[1]]:
                m = 6 * c**0.85
                p = (two[before[1], t] + m * p) / (c + m)
            if c := of_two[before]:
                p = (max(three[*before, t] - 0.9, 0) + 0.9 * types[before] * p) / c
            score, before = score + math.log10(p), (before[1], t)
        out[i] = (len(w), score)
    return out


def test_scores_do_not_depend_on_the_number_of_shards(spark, monkeypatch):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    want = one_form_scores(texts, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    got = []
    for size in (lm_score.SHARD_TOKENS, 3000):  # 8 shards and 27
        monkeypatch.setattr(lm_score, "SHARD_TOKENS", size)
        monkeypatch.setattr(lm_score, "TASK_TOKENS", 4 * size)
        got.append({r["doc_id"]: r["score"] for r in queries.op9_lm_score(spark, SMALL).collect()})
    assert got[0] == got[1] and got[0].keys() == want.keys()
    for i, (tokens, score) in want.items():
        assert abs(got[0][i] - score) < 0.0005 * tokens


def test_scores_do_not_depend_on_rows_held_out(spark, monkeypatch):
    """What is not learnt from adds shards, here 8 to 72, and nothing else."""
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 10_000)
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    more = docs.unionByName(docs.crossJoin(spark.range(1, 9)).select((F.col("doc_id") + F.col("id") * 10**6).alias("doc_id"), "text"))
    few, many = (lm_score.score(d, F.col("id") >= 10**6).filter("doc_id < 1000000").collect() for d in (docs, more))
    assert len(few) == docs.count() and {r["doc_id"]: r for r in few} == {r["doc_id"]: r for r in many}


def test_repeated_requests_are_searched_once(monkeypatch):
    """Many blocks ask for the same n-grams; each is searched once and handed to all."""
    r = np.random.default_rng(9)
    words, before, follower = (r.integers(1, 60, 500).astype(np.uint64) for _ in range(3))
    of, n3, shared = np.arange(500), r.integers(0, 3, 500).astype(float), (words + before) % 7 == 0
    trie = ngram_trie.Trie.mapped(ngram_trie.Trie.build(words, before, n3, (words + before).astype(float), shared, of, follower, n3, 100.0).dump())
    alone, searched, find = trie.places(words, before, of, follower), [], EliasFano._find
    monkeypatch.setattr(EliasFano, "_find", lambda self, v: searched.append(len(v)) or find(self, v))
    trie.places(words, before, of, follower)
    once = sum(searched)
    searched.clear()
    many = trie.places(*(np.tile(a, 30) for a in (words, before)), np.concatenate([of + 500 * k for k in range(30)]), np.tile(follower, 30))
    assert sum(searched) == once
    assert all((m.reshape(30, 500) == a).all() for m, a in zip(many, alone))


def test_dealt_counts_of_a_shard():
    r = np.random.default_rng(8)
    words, before, follower = (r.integers(1, 40, 4000).astype(np.uint64) for _ in range(3))
    of, n3 = np.arange(4000), r.integers(0, 3, 4000).astype(float)
    shared = (words + before) % 3 == 0
    trie = ngram_trie.Trie.mapped(ngram_trie.Trie.build(words, before, n3, (words + before).astype(float), shared, of, follower, n3, 100.0).dump())
    count, types, entries = trie.dealt(*trie.places(words, before, of, follower))
    c2, c3, met = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    rows = list(zip(words.tolist(), before.tolist(), follower.tolist(), n3.tolist(), shared.tolist()))
    for v, u, w, c, _ in rows:
        c2[v, u] += c
        c3[v, u, w] += c
        met[v, u] |= {w} if c else set()
    want = [(c2[v, u], len(met[v, u]), c3[v, u, w]) if hot else (0, 0, 0) for v, u, w, _, hot in rows]
    assert list(zip(count.tolist(), types.tolist(), entries.tolist())) == want


def test_language_model_cases(spark):
    docs = documents(spark)
    got = lm_score.score(docs, F.lit(False)).collect()
    assert len(got) == docs.count() and all(r["score"] <= 1e-9 and r["n_known"] == r["n_tokens"] for r in got)
    assert sum(r["doc_id"] is None for r in got) == 1
    none = lm_score.score(docs, F.lit(True)).collect()
    assert all((r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0, 0) for r in none)
    assert lm_score.score(docs.limit(0), F.lit(False)).count() == 0


# --- pipeline


def test_pipeline(spark):
    docs, sizes = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        if name != "packing":
            assert after.columns == docs.columns
        before, docs = docs, after.persist()
        sizes.append(docs.count())
        if name == "near_dedup":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            assert {r["doc_id"] for r in docs.collect()} == {k for k, v in plain_components(texts).items() if k == v}
        if name == "mixing":
            assert docs.select("doc_id").distinct().count() == sizes[-2]
    labels = table(spark, SMALL, "labels").filter("quality = 1")
    assert table(spark, SMALL, "documents").count() > sizes[0] >= labels.count() * 0.97
    assert corpus_pipeline.run(spark, SMALL).count() == sizes[-1]


ODD = {
    "nulls": [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "a b c d e f", None, None, None), (2**53 + 1, "a b c d e f", "de", "s", 11)],
    "repeated": [(1, "one two three four five six", "en", "s", 27)] * 3,
    "empty": [],
}


@pytest.mark.parametrize("case", ODD)
def test_pipeline_cases(spark, tmp_path, case):
    docs = spark.createDataFrame(ODD[case], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(7) for c in ("id", "n", "row", "_copies", "rate", "bin")}).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (2, None, 0), (None, 0, 0)] if case != "empty" else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # without labels of both classes nothing is rejected; equal texts are one document
    ids = {r["doc_id"] for r in got}
    assert ids == ({1, 2, None} if case == "nulls" else {1} if case == "repeated" else set())
