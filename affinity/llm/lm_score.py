"""Language-model scoring by a distributed Elias-Fano n-gram trie.

The corpus is read once, into blocks of documents as word numbers.  What blocks
need from the whole corpus they ask for and get back as packed arrays:

1. Each block sends its distinct words with their training counts to shards by
   hash; a shard adds them up and answers with a number and the count for each.
   Frequent words get small numbers.
2. Each block sends its distinct pairs of words, with the count of the first, the
   words that follow each and training counts, to shards by pair.  A shard builds
   the trie of what it got (``ngram_trie``), maps it into memory, looks up what the
   blocks asked by successor search on the coded levels, and answers with the
   quantised probabilities and weights.  If its executor is lost, the shard is
   built again from the requests.
3. What follows the most frequent pairs is dealt to several shards.  These send how
   many different words they hold after each such pair to the pair's first shard,
   which adds them up and answers with the pair's count and the weight it leaves.
4. Each block scores its documents from the answers.

Blocks and shards are of fixed size and tasks hold a fixed number of them, so
their number grows with the corpus, and no task, and nothing on the driver, does.
A block names each n-gram once, however often it has it, and sends nothing to
shards that it has nothing for: messages are never more than n-grams.  Blocks are
a table bucketed by block, so only what is asked and answered is shuffled.  What
follows pairs so frequent that they would fill a shard is dealt to several by a
hash of the follower.  Which are depends on the size of the corpus, the scores do
not: they come from the same counts by the same form.

Cases: null, empty and white-space texts are one token, the end.  Rows without an
id, like all whose remainder is not the held-out one, are learnt from.  Repeated
rows are scored, and learnt from, each by itself.  Without any training rows the
probabilities are those of the smoothed single words.  There can be up to 2^32
distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import forget, written
from affinity.llm.ngram_trie import Trie, after_one, after_two, distinct, first, left_over, one_weight, pairs, quantised, second, value
from affinity.llm.shingles import mixed, word_hashes
from affinity.storage import bucketed

#: Words of a block, words of the corpus for each shard, and words of the blocks or shards of one task.
BLOCK_TOKENS, SHARD_TOKENS, TASK_TOKENS = 1_000_000, 500_000, 2_000_000
#: Pairs whose words may fill more than one part in so many of a shard are dealt to several.
SHARED = 4
#: Stands for the end of a text, and as context for its start; no word has this hash.
END = np.uint64(0)
_ANSWER = "block long, kind int, shard long, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, byte plane by byte plane."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [a.itemsize, len(a)]
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.compress(np.array(head, np.int64).tobytes() + b"".join(body), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    """Unsigned arrays from ``pack``."""
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8), 8 + 16 * n, []
    for size, length in head.reshape(n, 2).tolist():
        planes = np.frombuffer(data, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(f"u{size}").ravel() if length else np.zeros(0, f"u{size}"))
        at += size * length
    return out


def _slim(a: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """block, n and data: ids, missing ids, held out, lengths, words of the block (sorted hashes), the tokens as places in them."""

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 24, 0
        ids, out, texts, n = [], [], [], 0

        def block() -> pd.DataFrame:
            lengths = np.array([len(t) for t in texts], np.uint32)
            words, tokens = np.unique(np.concatenate(texts), return_inverse=True)
            missing = np.array([i is None or i != i for i in ids], bool)
            numbers = np.array([0 if m else int(i) for i, m in zip(ids, missing)], np.int64)
            data = pack(numbers.view(np.uint64), missing.view(np.uint8), np.array(out, bool).view(np.uint8), lengths, _slim(tokens))
            return pd.DataFrame({"block": [base + made], "n": [int(lengths.sum())], "words": [pack(_delta(words))], "data": [data]})

        for pdf in it:
            for i, h, text in zip(pdf["id"].tolist(), pdf["held_out"].tolist(), pdf["text"]):
                w = word_hashes(text)
                ids.append(i)
                out.append(bool(h))
                texts.append(np.append(np.maximum(w, np.uint64(1)), END))
                n += len(w) + 1
                if n >= BLOCK_TOKENS:
                    yield block()
                    ids, out, texts, n = [], [], [], 0
                    made += 1
        if ids:
            yield block()

    # ids travel as text: a missing one would turn numbers into floats
    rows = docs.select(F.col("id").cast("string").alias("id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInPandas(cut, "block long, n long, words binary, data binary")


def _word_answers(blocks: DataFrame, bits: int, tasks: int) -> DataFrame:
    """By block and shard: number and count of each of its words; rows of block -1: a shard's totals."""
    shards = 1 << bits

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for block, words, data in zip(pdf["block"], pdf["words"], pdf["data"]):
                (words,), (_, _, out, lengths, tokens) = unpack(words), unpack(data)
                words = np.cumsum(words, dtype=np.uint64)
                train = np.repeat(out == 0, lengths)
                counts = np.bincount(tokens[train], minlength=len(words))
                bounds = np.searchsorted(words >> np.uint64(64 - bits), np.arange(shards + 1, dtype=np.uint64)).tolist()
                to = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
                parts = [slice(bounds[s], bounds[s + 1]) for s in to]
                yield pd.DataFrame({"shard": to, "block": block, "data": [pack(_delta(words[own]), _slim(counts[own])) for own in parts]})

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iat[0])
        asked = [(np.cumsum(w, dtype=np.uint64), n) for w, n in (unpack(d) for d in pdf["data"])]
        words, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([a[1] for a in asked]).astype(np.float64), len(words)).astype(np.int64)
        number = np.empty(len(counts), np.int64)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(counts))  # the most frequent first
        number = np.where(counts > 0, number * shards + shard + 1, 0)
        if number.max(initial=0) >= 1 << 32:
            raise OverflowError("more than 2^32 distinct words")
        out, at = [], 0
        for block, (w, _) in zip(pdf["block"], asked):
            own = inverse[at : at + len(w)]
            at += len(w)
            out.append((block, 0, shard, pack(number[own].astype(np.uint32), _slim(counts[own]))))
        out.append((-1, int((counts > 0).sum()), int(counts.sum()), None))
        return pd.DataFrame(out, columns=["block", "kind", "shard", "data"])

    asked = blocks.select("block", "words", "data").mapInPandas(ask, "shard long, block long, data binary")
    return asked.repartition(tasks, "shard").groupBy("shard").applyInPandas(answer, _ANSWER.replace("kind int", "kind long"))


class _Block:
    """A block's documents, and its words by number once they are answered."""

    def __init__(self, data: bytes, answers: list[bytes]):
        self.ids, self.missing, out, self.lengths, tokens = unpack(data)
        self.ids, self.out = self.ids.view(np.int64), out != 0
        parts = [unpack(a) for a in answers]  # in the order of the shards, which is that of the words
        number, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        self.word, self.count = number[tokens].astype(np.uint64), count[tokens].astype(np.float64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        first = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        place = np.arange(len(self.word)) - first[self.doc]
        end, end_count = self.word[-1], self.count[-1]  # every text ends so
        self.last, self.last_count = np.roll(self.word, 1), np.roll(self.count, 1)
        self.last[place == 0], self.last_count[place == 0] = end, end_count
        self.train = ~self.out[self.doc]
        self.inner = place > 0

    def grams(self, shards: int, tokens: int) -> _Grams:
        """Distinct pairs of known words, what follows them, and where they go."""
        known = (self.word > 0) & (self.last > 0)
        k2, own = np.unique(pairs(self.last[known], self.word[known]), return_inverse=True)
        pair = np.full(len(self.word), -1)
        pair[known] = own
        n2 = np.bincount(own[self.train[known]], minlength=len(k2))
        context = np.roll(pair, 1)  # the pair that ends where a token's own begins
        context[~self.inner] = -1
        known3 = context >= 0  # unknown followers too: their contexts are asked for
        k3, own = np.unique(pairs(context[known3], self.word[known3]), return_inverse=True)
        triple = np.full(len(self.word), -1)
        triple[known3] = own
        n3 = np.bincount(own[self.train[known3]], minlength=len(k3))
        of, s = (k3 >> np.uint64(32)).astype(np.int64), second(k3)

        # a pair is in its first shard; what follows frequent ones goes to further shards
        some = np.empty(len(k2), np.int64)
        some[pair[known]] = np.flatnonzero(known)
        most = np.minimum(self.last_count[some], self.count[some])
        parts = np.maximum(np.ceil(SHARED * shards * most / max(tokens, 1)), 1).astype(np.uint64)
        base, many, home = mixed(k2), np.uint64(shards), _home(k2, shards)
        to = mixed(base[of] + mixed(s) % parts[of]) % many
        away = to != home[of]
        rows = np.sort(np.concatenate([pairs(home, np.arange(len(k2))), distinct(np.sort(pairs(to[away], of[away])))]))
        shard, at = (rows >> np.uint64(32)).astype(np.int64), second(rows).astype(np.int64)
        order = second(np.sort(pairs(to, np.arange(len(k3))))).astype(np.int64)  # triples come by their pair, so within a shard they still do
        row3 = np.searchsorted(rows, pairs(to[order], of[order]))
        return _Grams(pair, triple, context, k2, n2, self.last_count[some], parts > 1, shard, at, shard == home[at].astype(np.int64), s[order], n3[order], np.bincount(row3, minlength=len(rows)), order)


def _home(pair: np.ndarray, shards: int) -> np.ndarray:
    """The first shard of each pair."""
    return mixed(mixed(pair)) % np.uint64(shards)


@dataclass
class _Grams:
    pair: np.ndarray  # by token: its pair, its triple, and the pair before it; -1 for none
    triple: np.ndarray
    context: np.ndarray
    keys: np.ndarray  # by pair: its words, its count, that of its first word, and whether its followers are dealt to several shards
    n: np.ndarray
    of_first: np.ndarray
    shared: np.ndarray
    shard: np.ndarray  # by row sent, in the order of the shards: where it goes, its pair, and whether that is the pair's first shard
    at: np.ndarray
    home: np.ndarray
    follower: np.ndarray  # by triple, in the order of the rows
    n3: np.ndarray
    followers: np.ndarray  # by row: how many triples go with it
    order: np.ndarray


def _gram_requests(shards: int, tokens: int):
    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = int(left["block"].iat[0])
        g = _Block(left["data"].iat[0], right.sort_values("shard")["data"].tolist()).grams(shards, tokens)
        bounds = np.searchsorted(g.shard, np.arange(shards + 1))
        ends = np.concatenate([[0], np.cumsum(g.followers)])[bounds]
        keys, n = g.keys[g.at], np.where(g.home, g.n[g.at], 0)
        out = []
        for s in np.flatnonzero(np.diff(bounds)):
            own, of = slice(bounds[s], bounds[s + 1]), slice(ends[s], ends[s + 1])
            at = g.at[own]
            data = pack(_delta(first(keys[own])), second(keys[own]).astype(np.uint32), _slim(n[own]), _slim(g.of_first[at].astype(np.int64)), g.shared[at].view(np.uint8), _slim(g.followers[own]), g.follower[of].astype(np.uint32), _slim(g.n3[of]))
            out.append((int(s), block, data))
        return pd.DataFrame(out, columns=["shard", "block", "data"])

    return ask


def _delta(ascending: np.ndarray) -> np.ndarray:
    return _slim(np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)))


def _gram_answers(shards: int, tasks: int, tokens: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """Build the shard's trie of what all blocks sent, and answer each.

        Rows of kind 2 and 3 are for ``_dealt_answers``, by the group that stands in
        place of the block.
        """
        shard, asked = int(pdf["shard"].iat[0]), [unpack(d) for d in pdf["data"]]
        before = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked])
        word, n, of_first, shared, followers, follower, n3 = (np.concatenate([a[k].astype(np.uint64) for a in asked]) for k in range(1, 8))
        of, shared = np.repeat(np.arange(len(word)), followers.astype(np.int64)), shared > 0
        trie = Trie.mapped(Trie.build(word, before, n.astype(float), of_first.astype(float), shared, of, follower, n3.astype(float), tokens).dump())
        context, entry = trie.places(word, before, of, follower)
        two, left, three = trie.codes(context, entry)
        hot3 = shared[of]
        counts = trie.dealt(context[:0], entry[hot3])[2]
        out, ends2, ends3 = [], *(np.cumsum([0, *(len(a[k]) for a in asked)]) for k in (1, 6))
        ends_hot = np.concatenate([[0], np.cumsum(hot3)])[ends3]
        for k, block in enumerate(pdf["block"]):
            own, own3 = slice(ends2[k], ends2[k + 1]), slice(ends3[k], ends3[k + 1])
            plain = ~shared[own]
            data = pack(two[own][plain], left[own][plain & (followers[own] > 0)], three[own3][~hot3[own3]], _slim(counts[ends_hot[k] : ends_hot[k + 1]]))
            out.append((block, 1, shard, data))

        # pairs dealt out: their followers here, and which blocks are to hear of them
        rows = np.flatnonzero(shared)
        keys, one, inverse = np.unique(pairs(before[rows], word[rows]), return_index=True, return_inverse=True)
        count, types, _ = trie.dealt(context[rows[one]], entry[:0])
        home = _home(keys, shards)
        group = home % np.uint64(tasks)
        some = types > 0
        for g in np.unique(group[some]).tolist():
            own = some & (group == g)
            out.append((g, 2, shard, pack(_delta(first(keys[own])), second(keys[own]).astype(np.uint32), _slim(types[own]))))
        here = home == shard
        if here.any():
            number = np.cumsum(here) - 1
            named = here[inverse]
            of_block = (np.searchsorted(ends2, rows[named], "right") - 1).astype(np.int64)
            lengths = np.bincount(of_block, minlength=len(asked))
            data = pack(_delta(first(keys[here])), second(keys[here]).astype(np.uint32), _slim(count[here]), pdf["block"].to_numpy(np.int64).view(np.uint64), _slim(lengths), _slim(number[inverse[named]]))
            out.append((shard % tasks, 3, shard, data))
        return pd.DataFrame(out, columns=["block", "kind", "shard", "data"])

    return answer


def _dealt_answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add up the followers of pairs that are dealt out; to each block counts of the pairs and codes of the weights they leave."""
    parts = [unpack(d) for d in pdf.loc[pdf["kind"] == 2, "data"]]
    keys, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_keys(p) for p in parts)]), return_inverse=True)
    types = np.append(np.bincount(inverse, np.concatenate([np.zeros(0), *(p[2] for p in parts)]), len(keys)), 0.0)
    out = []
    for shard, data in pdf.loc[pdf["kind"] == 3, ["shard", "data"]].itertuples(index=False):
        data = unpack(data)
        own, count, (blocks, lengths, asked) = _keys(data), data[2].astype(np.float64), data[3:]
        at = np.searchsorted(keys, own)
        at[np.append(keys, np.uint64(0))[at] != own] = len(keys)  # nothing was met after it
        over, ends = quantised(left_over(types[at], count)), np.cumsum(lengths, dtype=np.int64)
        for block, i in zip(blocks.view(np.int64).tolist(), np.split(asked, ends[:-1])):
            if len(i):
                out.append((block, 2, shard, pack(_slim(data[2][i]), over[i])))
    return pd.DataFrame(out, columns=["block", "kind", "shard", "data"])


def _keys(data: list[np.ndarray]) -> np.ndarray:
    return pairs(np.cumsum(data[0], dtype=np.uint64), data[1])


def _scores(shards: int, tokens: int, types: int):
    whole = tokens + types + 1

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["kind", "shard"])
        b = _Block(left["data"].iat[0], right.loc[right["kind"] == 0, "data"].tolist())
        g = b.grams(shards, tokens)
        codes = [unpack(d) for d in right.loc[right["kind"] == 1, "data"]]
        two, over, three, counts = (np.concatenate([np.zeros(0, np.uint16), *(c[k] for c in codes)]) for k in range(4))
        # the last of each for tokens without one
        met2, over2, met3 = np.zeros(len(g.keys) + 1), np.zeros(len(g.keys) + 1), np.zeros(len(g.order) + 1)
        hot = g.shared[g.at]
        met2[g.at[~hot]] = value(two)
        over2[g.at[~hot & (g.followers > 0)]] = value(over)
        # pairs dealt out: what their first shards added up
        codes, of_hot, at = [unpack(d) for d in right.loc[right["kind"] == 2, "data"]], np.zeros(len(g.keys)), g.at[hot & g.home]
        of_hot[at], over = (np.concatenate([np.zeros(0, np.uint16), *(c[k] for c in codes)]) for k in (0, 1))
        met2[at] = value(quantised(after_one(of_hot[at], g.of_first[at])))
        over2[at] = value(over)
        hot3 = np.repeat(hot, g.followers)
        met3[g.order[~hot3]] = value(three)
        met3[g.order[hot3]] = value(quantised(after_two(counts.astype(np.float64), of_hot[np.repeat(g.at, g.followers)[hot3]])))
        p = (b.count + 1) / whole
        base = np.log10(p)
        # after one word
        weight = one_weight(b.last_count)
        p = np.where((b.last > 0) & (b.last_count > 0), np.minimum(met2[g.pair] + weight / (b.last_count + weight) * p, 1.0), p)
        # after two
        p = np.where(met2[g.context] > 0, np.minimum(met3[g.triple] + over2[g.context] * p, 1.0), p)
        total = lambda x: np.bincount(b.doc, x, len(b.lengths))
        ids = pd.array(b.ids, dtype="Int64")
        ids[b.missing != 0] = pd.NA
        return pd.DataFrame({"id": ids, "held_out": b.out, "n_tokens": b.lengths.astype(np.int64), "n_known": total(b.count > 0).astype(np.int64), "base_score": total(base), "score": total(np.log10(p))})

    return score


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    held_out: a condition on ``id``; those rows are scored but not learnt from.
    score: the log10 probability of the text's words and its end.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = written(_blocks(docs, held_out), "blocks")
    n = made.agg(F.sum("n")).first()[0] or 0
    # tasks of fixed size: their number, not what one reads, grows with the corpus
    tasks, shards = max(8, -(-n // TASK_TOKENS)), max(8, -(-n // SHARD_TOKENS))
    bits = max(3, (n // SHARD_TOKENS).bit_length())
    words = written(_word_answers(made, bits, tasks), "words")
    types, tokens = words.filter("block = -1").agg(F.sum("kind"), F.sum("shard")).first()
    types, tokens = types or 0, tokens or 0
    words = words.filter("block >= 0").select("block", F.col("kind").cast("int").alias("kind"), "shard", "data")
    with bucketed(made.select("block", "data"), "block", tasks) as blocks:
        forget(made)
        own, to_blocks = blocks.groupBy("block"), lambda rows: rows.repartition(tasks, "block").groupBy("block")
        asked = own.cogroup(to_blocks(words)).applyInPandas(_gram_requests(shards, tokens), "shard long, block long, data binary")
        grams = written(asked.repartition(tasks, "shard").groupBy("shard").applyInPandas(_gram_answers(shards, tasks, tokens), _ANSWER), "grams")
        dealt = grams.filter("kind > 1").withColumnRenamed("block", "group").repartition(tasks, "group").groupBy("group").applyInPandas(_dealt_answers, _ANSWER)
        found = own.cogroup(to_blocks(words.unionByName(grams.filter("kind = 1")).unionByName(dealt))).applyInPandas(_scores(shards, tokens, types), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        found = written(found, "scores")
    for t in (words, grams):
        forget(t)
    return found.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
