"""A shard of an n-gram language model as a trie of Elias-Fano levels.

Contexts of two words are stored from the nearest word outwards.  Under each
nearest word stand the words met after it, and under each pair of words the words
met after the pair, but only by their rank among those of the nearer word
(context-relative), which keeps the numbers small.  Children of a node are a
range of the next level: each level is one monotone sequence of node * universe +
child, and the nodes' first children are another.

Smoothing interpolates.  After one word, met C times, with the weight m = k C^e,

    P(w | v) = c(v w) / (C + m) + m / (C + m) P(w),

and after two, met C times before T different words, by absolute discounting,

    P(w | u v) = max(c(u v w) - D, 0) / C + D T / C P(w | v).

What is stored of an n-gram is the first term, its discounted probability, and of
a context of two words the weight D T / C that it leaves to the shorter one, each
quantised to two bytes on a logarithmic scale.

The followers of pairs so frequent that they are dealt to several shards are met
in parts, so no shard knows their context's C and T.  Beside the share of all
tokens, their counts are stored as they are, with what the shard knows of C and T
(``dealt``); the terms are formed, and quantised alike, once the parts are added up.
So the number of shards decides nothing about the probabilities.
"""

from __future__ import annotations

import mmap
import os
from dataclasses import dataclass

import numpy as np

from affinity.llm.elias_fano import EliasFano

#: k and e after one word, D after two.
WEIGHT, POWER, DISCOUNT = 6.0, 0.85, 0.9
#: Powers of ten between neighbouring codes.  Code 0 is none, 1 the probability one; the least is below 1e-26.
STEP = 0.0004


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.rint(1 - np.log10(np.maximum(p, 1e-40)) / STEP)
    return np.where(p > 0, np.clip(code, 1, 65535), 0).astype(np.uint16)


def value(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((1 - code.astype(np.float64)) * STEP), 0.0)


def one_weight(context: np.ndarray) -> np.ndarray:
    """m of a word that was met so often."""
    return WEIGHT * np.maximum(context, 1.0) ** POWER


def after_one(count: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The first term after one word."""
    return count / (context + one_weight(context))


def after_two(count: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The first term after two words."""
    return np.maximum(count - DISCOUNT, 0) / np.maximum(context, 1)


def left_over(types: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The weight that two words leave to the nearer one."""
    return np.minimum(DISCOUNT * types / np.maximum(context, 1), 1.0)


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def first(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(32)


def second(key: np.ndarray) -> np.ndarray:
    return key & np.uint64(0xFFFFFFFF)


def distinct(ascending: np.ndarray) -> np.ndarray:
    return ascending[np.append(True, ascending[1:] != ascending[:-1])] if len(ascending) else ascending


@dataclass
class Trie:
    words: EliasFano  # nearest words of contexts
    successors: EliasFano  # word * universe + successor
    first_successor: EliasFano
    contexts: EliasFano  # word * universe + the word before it
    entries: EliasFano  # context * ranks + rank of the successor
    universe: int
    ranks: int
    of_context: np.ndarray  # code of the context's nearest word after the word before it
    over: np.ndarray  # code of the weight that the context leaves to its nearest word
    of_entry: np.ndarray  # code of the successor after the context
    dealt_contexts: EliasFano  # places of the contexts whose followers are dealt to several shards
    dealt_entries: EliasFano  # places of their entries
    count: np.ndarray  # by dealt context: its count, where it is stored
    types: np.ndarray  # by dealt context: its followers in this shard
    entry_count: np.ndarray  # by dealt entry

    @classmethod
    def build(cls, words: np.ndarray, before: np.ndarray, n: np.ndarray, of_first: np.ndarray, shared: np.ndarray, of: np.ndarray, successors: np.ndarray, n3: np.ndarray, total: float) -> Trie:
        """Pairs (word, the word before it, count, count of that word, whether followers are dealt out) and what followed them.

        of: the place of each follower's pair.  n3: its count there.  Repeats add up;
        pairs and followers of count 0 are not kept.
        """
        met, met3 = (n > 0) | shared, np.flatnonzero(n3 > 0)
        contexts, where = np.unique(pairs(words[met], before[met]), return_inverse=True)
        place = np.full(len(words), -1)
        place[met] = where
        count, first_count, is_shared = np.bincount(where, n[met], len(contexts)), np.zeros(len(contexts)), np.zeros(len(contexts), bool)
        first_count[where], is_shared[where] = of_first[met], shared[met]
        # a follower was met, so its pair was: in another block's rows, if not in these
        lacking = met3[place[of[met3]] < 0]
        place[of[lacking]] = np.searchsorted(contexts, pairs(words[of[lacking]], before[of[lacking]]))
        keys, inverse = np.unique(pairs(place[of[met3]], successors[met3]), return_inverse=True)
        c3, of3, s3 = np.bincount(inverse, n3[met3], len(keys)), first(keys).astype(np.int64), second(keys)
        types = np.bincount(of3, minlength=len(contexts))
        discounted = np.where(is_shared[of3], c3 / max(total, 1), after_two(c3, count[of3]))

        nearest = first(contexts)
        nodes = distinct(nearest)
        node = np.searchsorted(nodes, nearest)
        universe = int(max(second(contexts).max(initial=0), s3.max(initial=0))) + 1
        u = np.uint64(universe)
        after, rank = np.unique(node[of3].astype(np.uint64) * u + s3, return_inverse=True)
        start = np.searchsorted(after, np.arange(len(nodes), dtype=np.uint64) * u)
        rank = rank - start[node[of3]]
        ranks = int(rank.max(initial=0)) + 1
        return cls(
            EliasFano.encode(nodes),
            EliasFano.encode(after),
            EliasFano.encode(start),
            EliasFano.encode(node.astype(np.uint64) * u + second(contexts)),
            EliasFano.encode(of3.astype(np.uint64) * np.uint64(ranks) + rank.astype(np.uint64)),
            universe,
            ranks,
            quantised(after_one(count, first_count)),
            quantised(np.where(is_shared, 0, left_over(types, count))),
            quantised(discounted),
            EliasFano.encode(np.flatnonzero(is_shared)),
            EliasFano.encode(np.flatnonzero(is_shared[of3])),
            count[is_shared].astype(np.uint64),
            types[is_shared].astype(np.uint64),
            c3[is_shared[of3]].astype(np.uint64),
        )

    def dump(self) -> bytes:
        """The levels one after another, each at a multiple of eight bytes."""
        levels = [e.buffer for e in (self.words, self.successors, self.first_successor, self.contexts, self.entries, self.dealt_contexts, self.dealt_entries)]
        values = (self.of_context, self.over, self.of_entry, self.count, self.types, self.entry_count)
        parts = [bytes(p) for p in (*levels, *(v.tobytes() for v in values))]
        head = np.array([self.universe, self.ranks, *map(len, parts)], np.int64).tobytes()
        return head + b"".join(p + bytes(-len(p) % 8) for p in parts)

    @classmethod
    def open(cls, buffer) -> Trie:
        """The trie in a buffer, such as a mapped file; its levels are not copied."""
        universe, ranks, *sizes = np.frombuffer(buffer, np.int64, 15).tolist()
        view, at, parts = memoryview(buffer), 120, []
        for size in sizes:
            parts.append(view[at : at + size])
            at += size + -size % 8
        levels = [EliasFano(p) for p in parts[:7]]
        codes, counts = (np.frombuffer(p, np.uint16) for p in parts[7:10]), (np.frombuffer(p, np.uint64) for p in parts[10:])
        return cls(*levels[:5], universe, ranks, *codes, *levels[5:], *counts)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The trie on memory mapped from a file that has no place in any folder."""
        file = os.memfd_create("trie")
        try:
            os.ftruncate(file, len(data))
            memory = mmap.mmap(file, len(data))
        finally:
            os.close(file)
        memory[:] = data
        return cls.open(memory)

    def _child(self, level: EliasFano, node: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The place of a node's child in a level, -1 where it has no such child."""
        known = (node >= 0) & (child < self.universe)
        at = level.find(np.where(known, node, 0).astype(np.uint64) * np.uint64(self.universe) + np.where(known, child, 0).astype(np.uint64))
        return np.where(known, at, -1)

    def places(self, words: np.ndarray, before: np.ndarray, of: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of pairs (before, word) and entries of triples, the pair at place ``of`` and a successor; -1 for none."""
        # each is searched once, in the order of its level, however many blocks ask for it
        keys, asked = np.unique(pairs(words, before), return_inverse=True)
        keys3, asked3 = np.unique(pairs(asked[of], successors), return_inverse=True)
        words, before, of, successors = first(keys), second(keys), first(keys3).astype(np.int64), second(keys3)
        runs = np.append(True, words[1:] != words[:-1]) if len(words) else np.zeros(0, bool)
        node = self.words.find(words[runs])
        start = self.first_successor.at(np.maximum(node, 0)).astype(np.int64) if self.first_successor.n else np.zeros(len(node), np.int64)
        run = np.cumsum(runs) - 1
        node, start = node[run], start[run]
        context = self._child(self.contexts, node, before)
        at = self._child(self.successors, node[of], successors)
        rank = at - start[of]
        met = (context[of] >= 0) & (at >= 0) & (rank < self.ranks)
        entry = np.full(len(of), -1, np.int64)
        entry[met] = self.entries.find(context[of][met].astype(np.uint64) * np.uint64(self.ranks) + rank[met].astype(np.uint64))
        return context[asked], entry[asked3]

    def lookup(self, words: np.ndarray, before: np.ndarray, of: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of pairs (before, word), of the weights they leave, and of triples: the pair at place ``of`` and a successor."""
        return self.codes(*self.places(words, before, of, successors))

    def codes(self, context: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of contexts, of the weights they leave, and of entries, by their places."""
        return _take(self.of_context, context), _take(self.over, context), _take(self.of_entry, entry)

    def dealt(self, context: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and numbers of followers of contexts, and counts of entries, by their places; 0 where they are not dealt out."""
        context, entry = np.where(context >= 0, self.dealt_contexts.find(np.maximum(context, 0)), -1), np.where(entry >= 0, self.dealt_entries.find(np.maximum(entry, 0)), -1)
        return _take(self.count, context), _take(self.types, context), _take(self.entry_count, entry)


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(at), values.dtype)
    return np.where(at >= 0, values[np.maximum(at, 0)], 0).astype(values.dtype)
