"""Mixing domains to target weights by soft membership.

A naive Bayes classifier over the words of labelled documents predicts for every
document how likely it belongs to each domain.  Documents then get rates: how
often each is to be seen.  The rates are fitted by projected gradient steps so
that the expected tokens of each domain, summed over documents, meet the target,
starting from one and never falling below a floor.

Only DataFrame operations run: the words of a document meet a vocabulary of
bounded size in a broadcast join, and a step needs one sum for each domain.  The
rate of a row is an expression over its memberships and the steps, which are data
of the expression and not nested in it; rates are written now and then, so that
neither plans nor work grow with the steps made before.

Residuals are weighed by the inverse of the domains' overlap matrix.  In the
metric of token shares the fit then has a Lipschitz constant of one, and steps
of length one converge at once where the floor is not met, and fast otherwise.

With a floor of one no domain can have fewer tokens than it holds.  At the least
total that allows for that, only rows without a trace of the domain that decides
it could be seen more often, and the targets are hardly met; so the total is a
little larger, by the part ``room``.

The size of the vocabulary, the labelled documents that it is counted on, the
evidence that a membership may rest on and the steps are parameters of the model.
What the fit misses of the targets is reported, as a share of all tokens, in
``residual``; a caller that cannot do with it names a ``tolerance``.

Cases: null and empty texts have no words and get the prior as memberships and no
tokens.  Labelled rows with a null or unknown domain do not count.  Repeated rows
get rates of their own.  Without any tokens all rates are one.  Domains without
labelled rows keep the smoothed prior; targets of zero are allowed.  Targets that
no rates meet are come near to, with the residual saying how near.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import ASCII_UPPER, SPACE, forget, written

#: Words of the vocabulary at most, and labelled documents that its counts use at most.
VOCABULARY, MAX_LABELLED = 2_000, 20_000
#: Ids up to this many go to all executors; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Words of evidence that a document's membership may rest on; more are scaled down to so many.
EVIDENCE = 20.0
STEPS, CLOSE = 60, 1e-7
#: Part by which the total exceeds the least one that a floor of one allows.
ROOM = 0.02
#: After so many steps the rates are written, so that a step costs the same however many came before it.
WRITTEN_STEPS = 10
WORD = r"[^\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """Distinct words, A-Z lower-cased."""
    return F.array_distinct(F.filter(F.split(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()), SPACE), lambda w: w != ""))


class TargetsMissed(ValueError):
    """Rates that leave more of the targets unmet than is tolerated."""


def word_model(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, vocabulary: int = VOCABULARY) -> tuple[DataFrame, list[float]]:
    """The words' log-probabilities by domain (word, l0, l1, ...) and the domains' log priors.

    labelled: id, domain.  The words in most of the labelled documents make the
    vocabulary: all that are in as many or more, for the least number of documents
    at which they are no more than ``vocabulary``.
    """
    chosen = labelled.filter(F.col("domain").isin(domains) & F.col("id").isNotNull()).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    known = written(docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words")).join(F.broadcast(chosen), "id"), "labelled")
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    priors = [float(np.log((sizes.get(d, 0) + 1) / (n + len(domains)))) for d in domains]
    by_word = known.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"c{k}") for k, d in enumerate(domains)])
    most = sum((F.col(f"c{k}") for k in range(len(domains))), F.lit(0))
    by_word = written(by_word.withColumn("most", most), "by_word")
    # how many words are in so many documents: at most a row for each labelled document
    sizes_of = {r["most"]: r["n"] for r in by_word.groupBy("most").agg(F.count("*").alias("n")).collect()}
    least, taken = None, 0
    for m in sorted(sizes_of, reverse=True):
        taken += sizes_of[m]
        if taken > vocabulary and least is not None:
            break
        least = m
    chosen_words = by_word.filter(F.col("most") >= F.lit(least if least is not None else 0))
    if least is not None and sizes_of[max(sizes_of)] > vocabulary:  # too many that are all in as many documents
        chosen_words = chosen_words.orderBy("word").limit(vocabulary)
    logs = [F.log((F.col(f"c{k}") + 0.5) / F.lit(sizes.get(d, 0) + 1.0)).alias(f"l{k}") for k, d in enumerate(domains)]
    found = written(chosen_words.select("word", *logs), "vocabulary")
    forget(by_word)
    forget(known)
    return found, priors


def memberships(docs: DataFrame, model: DataFrame, priors: list[float], id_col: str, text_col: str, evidence: float = EVIDENCE) -> DataFrame:
    """row, id, n (tokens) and p (membership in each domain) of every row."""
    k = range(len(priors))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n"), _words(F.col(text_col)).alias("words"))
    met = rows.select("row", "id", "n", F.explode_outer("words").alias("word")).join(F.broadcast(model), "word", "left")
    sums = met.groupBy("row", "id", "n").agg(F.count("l0").alias("met"), *[F.coalesce(F.sum(f"l{j}"), F.lit(0.0)).alias(f"s{j}") for j in k])
    scale = F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest(F.col("met"), F.lit(1)))
    logs = [F.lit(priors[j]) + F.col(f"s{j}") * scale for j in k]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    sums = sums.select("row", "id", "n", *[F.exp(l - top).alias(f"e{j}") for j, l in enumerate(logs)])
    whole = sum((F.col(f"e{j}") for j in k), F.lit(0.0))
    return sums.select("row", "id", "n", F.array(*[F.col(f"e{j}") / whole for j in k]).alias("p"))


def fit_rates(rows: DataFrame, targets: list[float], floor: float = 0.0, total: float | None = None, steps: int = STEPS, room: float = ROOM) -> tuple[Column, dict]:
    """The rate of a row (n, p) as an expression, and what the fit reached.

    targets: weights of the domains.  total: tokens wanted in all; without it, the
    tokens there are, or with a floor of one the least total at which no domain
    needs fewer tokens than it has, and the part ``room`` of it more.
    """
    k = len(targets)
    w = np.array(targets, float) / sum(targets)
    n, p = F.col("n").cast("double"), [F.col("p")[j] for j in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(F.sum(n), *[F.sum(n * p[j]) for j in range(k)], *[F.sum(n * p[i] * p[j]) for i, j in pairs]).first()
    tokens = float(sums[0] or 0)
    if not tokens:
        return F.lit(1.0), {"tokens": 0.0, "steps": 0, "residual": 0.0}
    held = np.array(sums[1 : 1 + k], float)
    overlap = np.zeros((k, k))
    for (i, j), s in zip(pairs, sums[1 + k :]):
        overlap[i, j] = overlap[j, i] = s / tokens
    if total is None:
        total = tokens if floor < 1 else max(tokens, max((h / x for h, x in zip(held, w) if x > 0), default=tokens)) * (1 + room)
    wanted = w * total
    weigh = np.linalg.pinv(overlap + 1e-9 * np.eye(k))

    def after(start: Column, pushes: list[list[float]]) -> Column:
        """The rate that these steps lead to; the steps are data, so the expression is the same for any number."""
        return F.aggregate(F.lit(pushes), start, lambda r, push: F.greatest(F.lit(float(floor)), r - sum((p[j] * push[j] for j in range(k)), F.lit(0.0)))) if pushes else start

    state, kept = rows.select("n", "p", F.lit(1.0).alias("rate")), None
    pushes, since, reached, done = [], 0, held, 0
    for done in range(steps + 1):
        residual = (reached - wanted) / tokens
        if np.abs(residual).max() <= CLOSE or done == steps:
            break
        pushes.append(np.round(weigh @ residual, 12).tolist())
        now = state.select("n", "p", after(F.col("rate"), pushes[since:]).alias("rate"))
        if len(pushes) - since == WRITTEN_STEPS:  # later steps start from here
            now, before = written(now, "rates"), kept
            state, kept, since = now, now, len(pushes)
            if before is not None:
                forget(before)
        reached = np.array(now.agg(*[F.sum(F.col("rate") * F.col("n") * F.col("p")[j]) for j in range(k)]).first(), float)
    if kept is not None:
        forget(kept)
    return after(F.lit(1.0), pushes), {"tokens": tokens, "total": float(total), "steps": done, "wanted": wanted.tolist(), "reached": reached.tolist(), "residual": float(np.abs((reached - wanted) / tokens).max())}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", floor: float = 0.0, total: float | None = None, *, vocabulary: int = VOCABULARY, evidence: float = EVIDENCE, steps: int = STEPS, room: float = ROOM, tolerance: float | None = None) -> DataFrame:
    """id, n_tokens, p_<domain> for every target, rate, copies and residual of every row.

    labelled: id_col and ``domain``.  copies: the rate, rounded up or down by a hash
    of the id so that the expected number of copies is the rate.  residual: the
    largest part of all tokens by which a domain misses its target, the same in
    all rows; above ``tolerance``, TargetsMissed is raised.
    """
    domains = sorted(targets)
    model, priors = word_model(docs, labelled.select(F.col(id_col).alias("id"), "domain"), domains, id_col, text_col, vocabulary)
    rows = written(memberships(docs, model, priors, id_col, text_col, evidence), "memberships")
    forget(model)
    rate, fitted = fit_rates(rows, [targets[d] for d in domains], floor, total, steps, room)
    if tolerance is not None and fitted["residual"] > tolerance:
        raise TargetsMissed(f"{fitted['residual']:.6f} of the tokens are missed after {fitted['steps']} steps")
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.withColumn("rate", rate)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), *[F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(domains)], "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"), F.lit(fitted["residual"]).alias("residual"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` says.

    Rows that repeat an id get the copies of the one with most; rows without an id stay once.
    """
    copies = mix(docs, labelled, targets, id_col, text_col, **how).filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("copies").alias("copies"))
    copies = written(copies, "copies")
    few = copies.count() <= BROADCAST_IDS
    # the row travels whole, so its columns' names meet no others
    rows = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("doc")).join(F.broadcast(copies) if few else copies, "id", "left")
    times = F.coalesce("copies", F.lit(1))
    return rows.filter(times > 0).select("doc", F.explode(F.sequence(F.lit(1), times)).alias("time")).select("doc.*")
