"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces of documents go, longest first, into the open bin they fill best.  Where
none has room, a bin of the size with the least cost for a token is opened.  At
the end each bin is cut down to the least permitted length that holds what is in
it.  Whether opening large bins pays depends on the lengths at hand, so each
group is packed once for every permitted length as the largest one opened, and
the packing of least total cost is taken.

Documents are dealt to groups by a hash, so that copies of one go to different sequences.  Groups hold about
``GROUP_TOKENS`` tokens, whatever the size of the corpus, and are packed apart.

Cases: every document has one token more than its text, its end, so null and
empty texts are packed too.  Texts longer than the largest permitted length are
cut into pieces of that length and a rest; nothing is dropped.  Rows that repeat
an id are packed each by itself; ids of any size and null ids pass through.  Ties go to the bin opened first.  An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import written

#: Permitted sequence lengths, in tokens.
LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_TOKENS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def sequence_cost(length: int) -> float:
    """What a sequence costs in training: its tokens, attention over them, and a fixed share."""
    return length + length * length / 65_536 + 32


def pack(sizes: Sequence[int], permitted: Sequence[int], cost: Callable[[int], float], largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of sizes that come longest first: the bin of each, its place there, the bins' contents.

    New bins have the size of least cost for a token among those that hold the
    piece and are not above ``largest``; a longer piece gets the least size that holds it.
    """
    bins, places, contents = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    capacity: list[int] = []
    rooms: list[int] = []  # distinct rooms left, ascending
    open_at: dict[int, list[int]] = {}  # bins by room, last opened on top
    for i, size in enumerate(sizes):
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            own = open_at[room]
            b = own.pop()
            if not own:
                del open_at[room]
                rooms.pop(at)
        else:
            fitting = [c for c in permitted if c >= size]
            fitting = [c for c in fitting if c <= largest] or fitting[:1]
            b, room = len(contents), min(fitting, key=lambda c: (cost(c) / c, c))
            capacity.append(room)
            contents.append(0)
        bins[i], places[i] = b, contents[b]
        contents[b] += size
        room -= size
        if room:
            if room not in open_at:
                bisect.insort(rooms, room)
                open_at[room] = []
            open_at[room].append(b)
    return bins, places, np.array(contents, np.int64)


def best_packing(sizes: Sequence[int], permitted: Sequence[int], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each size, its place there, and the bins' final lengths, at the least total cost found."""
    lengths, costs = np.array(permitted), np.array([cost(c) for c in permitted])
    best = None
    for largest in permitted:
        bins, places, contents = pack(sizes, permitted, cost, largest)
        fit = np.searchsorted(lengths, contents)
        total = float(costs[fit].sum())
        if best is None or total < best[0]:
            best = total, bins, places, lengths[fit]
    return best[1:]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permitted: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost, length: str | None = None) -> DataFrame:
    """id, piece, start, length, bin, place and capacity for every piece of a document.

    start: the piece's first token in the document; place: its first token in the
    bin.  length: a column with the tokens of each row; without it, words count.
    """
    permitted = sorted(set(permitted))
    longest = permitted[-1]
    n = F.col(length).cast("long") if length else F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long")
    sized = written(docs.select(F.col(id_col).alias("id"), (F.coalesce(n, F.lit(0)) + 1).alias("n"), F.monotonically_increasing_id().alias("row")), "sizes")
    total = sized.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // GROUP_TOKENS))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}"))))
    pieces = pieces.select("id", "row", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("length"))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("id", "row", "piece"), F.lit(groups)))
    kind = docs.schema[id_col].dataType.simpleString()

    def packed(group: pa.Table) -> pa.Table:
        # ids stay out of pandas, where a missing one would turn them into floats
        group = group.take(pc.sort_indices(group, [("length", "descending"), ("id", "ascending"), ("row", "ascending"), ("piece", "ascending")]))
        bins, places, lengths = best_packing(group["length"].to_pylist(), permitted, cost)
        base = group["group"][0].as_py() << 32
        return group.select(["id", "piece", "start", "length"]).append_column("bin", pa.array(base + bins, pa.int64())).append_column("place", pa.array(places, pa.int64())).append_column("capacity", pa.array(lengths[bins], pa.int32()))

    out = pieces.groupBy("group").applyInArrow(packed, f"id {kind}, piece int, start long, length long, bin long, place long, capacity int")
    return out.withColumnRenamed("id", id_col)
