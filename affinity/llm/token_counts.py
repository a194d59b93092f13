"""Token counts by prefix dynamic programming.

For a byte-pair vocabulary whose pieces merge by score, every run of tokens in
an encoding is itself the encoding of its own text, and a row of tokens is an
encoding if each neighbouring pair is one.  So the last token of each prefix
follows from shorter prefixes: it is the one piece ending there that stands
alone and forms a valid pair with the last token of what precedes it.  One pass
gives the exact token count of every prefix, and with it the answer to any
question of truncation or budget without encoding again.

The table of a text is one signed byte per code point: the change of the token
count as that code point is added.  ``count_at`` and ``longest_within`` read it.

No piece of such a vocabulary goes on past a white-space mark that follows other
characters, so texts are cut there, and the tables of common pieces are kept.

Cases: a null or empty text has no tokens and an empty table.  Texts of any
length are handled whole, in time proportional to their length.  Repeated rows
are counted row by row, with their ids of any size or none; an empty table
gives an empty result.  Characters
outside the vocabulary count one token for each UTF-8 byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Tables kept for pieces of text in each Python worker, and the longest such piece.
KEPT, KEPT_CHARS = 700_000, 40
#: The work on the first so many code points of pieces is kept as well.
HEAD, KEPT_HEADS = 7, 200_000


def vocabulary(model_file: str) -> dict[str, float]:
    """Pieces and their scores from a sentencepiece BPE model with byte fallback."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}


class PrefixCounter:
    """Exact token counts of all prefixes of texts, for one vocabulary."""

    def __init__(self, pieces: dict[str, float]):
        self.scores = pieces
        self.ids = {p: k for k, p in enumerate(pieces, 1)}
        self.text_of = ["", *pieces]
        # ends of pieces: a substring outside this set ends no piece, however far it is extended
        self.tails = {p[k:] for p in pieces for k in range(len(p))}
        self.after = _After(self)
        self.heads: dict[str, tuple[list, list]] = {}
        self.spaced = _Tables(self, MARK)
        self.plain = _Tables(self, "")

    def merged(self, text: str) -> list[str]:
        """The pieces that merging neighbours by score, leftmost first, leaves of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def counts(self, s: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... code points of a text without cuts."""
        id_of, tails, after = self.ids.get, self.tails, self.after
        count, follows = [0], [after[0]]  # follows: whether a token may come next, by token
        head = s[:HEAD]
        if known := self.heads.get(head):
            count, follows = known[0].copy(), known[1].copy()
        for j in range(len(count), len(s) + 1):
            if j == HEAD + 1 and not known:
                if len(self.heads) >= KEPT_HEADS:
                    self.heads.clear()
                self.heads[head] = count.copy(), follows.copy()
            found = []
            i = j - 1
            while i >= 0 and (piece := s[i:j]) in tails:
                if token := id_of(piece):
                    found.append((i, token))
                i -= 1
            while found:
                i, token = found.pop()
                if follows[i][token]:
                    count.append(count[i] + 1)
                    follows.append(after[token])
                    break
            else:
                count.append(count[-1] + len(s[j - 1].encode("utf-8", "surrogatepass")))
                follows.append(after[0])
        return count[1:]

    def table(self, text: str | None) -> np.ndarray:
        """The change of the token count at every code point, as int8."""
        if not text:
            return np.zeros(0, np.int8)
        text = text.replace(MARK, " ")
        parts: list[bytes] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                # a text that begins with a line end has a mark of its own before it
                parts.append(_first(self.counts(MARK + "\n")) if not parts else self.plain["\n"])
            if not line:
                continue
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                # runs of spaces stay with the word that follows them
                words = re.findall(r" +[^ ]*|[^ ]+", line)
                words = [self.plain[w.replace(" ", MARK)] for w in words] if n else [_first(self.counts(MARK + words[0].replace(" ", MARK))), *(self.plain[w.replace(" ", MARK)] for w in words[1:])]
                parts += words
            else:
                head, *rest = line.split(" ")
                parts.append(self.plain[head] if n else _first(self.counts(MARK + head)))
                parts += map(self.spaced.__getitem__, rest)
        return np.frombuffer(b"".join(parts), np.int8)


def _first(counts: list[int]) -> bytes:
    """Changes for a text that begins with a mark of its own, which is no code point of it."""
    return np.diff(np.array(counts[1:], np.int64), prepend=0).astype(np.int8).tobytes()


class _After(dict):
    """By token, what may follow it; 0 stands for the start and for bytes."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, left: int) -> _Follows:
        f = self[left] = _Follows(self.counter, left)
        return f


class _Follows(dict):
    """Whether a token stands alone and forms a valid pair with the one before it."""

    def __init__(self, counter: PrefixCounter, left: int):
        super().__init__()
        self.counter, self.left = counter, left

    def __missing__(self, right: int) -> bool:
        c, b = self.counter, self.counter.text_of[right]
        if not self.left:
            ok = len(c.merged(b)) == 1
        else:
            a = c.text_of[self.left]
            ok = c.after[0][right] and c.merged(a + b) == [a, b]
        self[right] = ok
        return ok


class _Tables(dict):
    """Changes of the count by piece of text, with a mark before it or not.

    When full it becomes the old generation, from which pieces in use come back.
    """

    def __init__(self, counter: PrefixCounter, before: str):
        super().__init__()
        self.counter, self.before, self.old = counter, before, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            counts = self.counter.counts(self.before + word)
            out = bytes([(c - b) & 255 for b, c in zip([0, *counts], counts)])
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


def count_at(table: np.ndarray, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(table[:n_chars].sum(dtype=np.int64))


def longest_within(table: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return longest_of(np.cumsum(table, dtype=np.int64), budget)


def longest_of(counts: np.ndarray, budget: int) -> int:
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


_COUNTERS: dict[int, PrefixCounter] = {}


def count_tokens(docs: DataFrame, pieces: dict[str, float], budget: int, id_col: str = "doc_id", text_col: str = "text", tables: bool = True) -> DataFrame:
    """id, n_bytes, n_tokens, fits_chars and, if wanted, the table of every row.

    fits_chars: code points of the longest prefix of at most ``budget`` tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = shared.id if hasattr(shared, "id") else id(shared)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = PrefixCounter(shared.value)
        for batch in it:
            n_tokens, fits, kept = [], [], []
            for text in batch.column("text"):  # one at a time: a batch's texts are long
                t = counter.table(text.as_py())
                total = int(t.sum(dtype=np.int64))
                n_tokens.append(total)
                fits.append(longest_within(t, budget) if total > budget else len(t))
                if tables:
                    kept.append(t.tobytes())
            found = [batch.column("id"), batch.column("n_bytes"), pa.array(n_tokens, pa.int64()), pa.array(fits, pa.int64())] + [pa.array(kept, pa.binary())] * tables
            yield pa.RecordBatch.from_arrays(found, names=["id", "n_bytes", "n_tokens", "fits_chars"] + ["prefix_table"] * tables)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(batches, f"id {kind}, n_bytes long, n_tokens long, fits_chars long" + ", prefix_table binary" * tables).withColumnRenamed("id", id_col)
