"""MinHash near-duplicate detection.

1. Every text becomes its set of word shingles, a MinHash signature of many
   universal hash minima, and one key for each band of the signature.
2. Rows with equal sets form a class; one row stands for it from here on.
3. Classes that share a band key are compared with a few members chosen as
   pivots of that key, not with one another.  Pairs whose signatures agree often
   enough are confirmed on their full sets, and the links give components.
4. Where a key still holds several components, the members of different ones
   are compared by signature, block by block, and by full set only where
   signatures agree.  Pairs within a component cannot change it.  So the
   components are those of all pairs that share a key, without making all pairs
   of a group of copies.

With 32 bands of 4 a pair at similarity 0.75 shares no key with probability
under 1e-5, and its signatures agree too seldom with probability under 1e-6.

Sizes: a shuffle carries keys, ids and signatures of one byte for each minimum;
full sets are made again from the texts, for the compared classes alone.  A
member of a large key is sent to one task for each ``BLOCK`` others, without its
set.

Cases: ids are whole numbers of any size.  Texts that are null, empty or white
space have an empty set and are linked with nothing.  A text of fewer words than the width is one shingle.  Rows
without an id keep component null and are linked with nothing.  Rows that repeat
an id count as one document: what links to either links to both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import forget, written
from affinity.llm.components import connected_components
from affinity.llm.shingles import MinHasher, band_keys, shingle_set

#: Ids up to this many go to all executors; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Pivots of a key are its least ids after these bit masks.
MASKS = (0, 0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D)
#: Members of a key that make one block.
BLOCK = 1_024


def _signed(docs: DataFrame, width: int, hashes: int, rows: int) -> DataFrame:
    """id, n (size of the set), fp (its fingerprint), sig (a byte of each minimum), bands."""

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(hashes)
        for batch in it:
            out = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                if len(s):
                    m = hasher.minima(s)
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), m.astype(np.uint8).tobytes(), band_keys(m, rows)))
                else:
                    out.append((0, None, None, None))
            n, fp, sig, bands = zip(*out) if out else ((), (), (), ())
            # ids stay out of pandas, where a missing one would turn them into floats
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "fp", "sig", "bands"])

    return docs.select("id", "text").mapInArrow(sign, "id long, n long, fp binary, sig binary, bands array<long>")


def _agreeing(pairs: DataFrame, signed: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``least`` places or more."""

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("sa", "sb"))
                yield pdf.loc[(x == y).sum(axis=1) >= least, ["a", "b"]]

    both = pairs.join(signed.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(signed.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.mapInPandas(compare, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and set (its sorted hashes as bytes) of the rows with these ids."""
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.select("id", "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"id": pdf["id"], "set": [shingle_set(t, width).tobytes() for t in pdf["text"]]})

    return written(wanted.mapInPandas(sets, "id long, set binary"), "sets")


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def confirm(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            keep = [_similar(x, y, percent) for x, y in zip(pdf["sa"], pdf["sb"])]
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    found = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width)
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(found.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    links = written(both.mapInPandas(confirm, "a long, b long"), "links")
    forget(found)
    return links


def _by_group(it: Iterator[pd.DataFrame], keys: list[str], work) -> Iterator[pd.DataFrame]:
    """What ``work`` makes of each group of rows that come sorted by ``keys``."""
    held = None
    for pdf in it:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        at = pdf[keys].to_numpy()
        bounds = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist()]
        for x, y in zip(bounds, bounds[1:]):
            yield work(pdf.iloc[x:y])
        held = pdf.iloc[bounds[-1] :]
    if held is not None and len(held):
        yield work(held)


class _Meeting:
    """Two blocks of a key's members, or one with itself: which rows are to be compared.

    code: a row's signature and four bytes of each band key.
    """

    def __init__(self, g: pd.DataFrame, hashes: int):
        self.i, self.j = int(g["i"].iat[0]), int(g["j"].iat[0])
        code = np.frombuffer(b"".join(g["code"]), np.uint8).reshape(len(g), -1)
        self.sig, self.bands = code[:, :hashes], np.ascontiguousarray(code[:, hashes:]).view(np.uint32)
        self.band = int(np.flatnonzero(self.bands[0] == np.uint32(int(g["key"].iat[0]) & 0xFFFFFFFF))[0])
        self.own, self.minor, self.component = g["own"].to_numpy(), g["minor"].to_numpy(), g["component"].to_numpy().copy()

    def partners(self, k: int, least: int) -> np.ndarray:
        """Rows of other components that row k may be linked with, the likeliest first."""
        if self.j >= 0:
            may = ~self.minor
        else:
            may = np.arange(len(self.own)) > k if self.i == -1 - self.j else self.own > self.own[k]
        rest = np.flatnonzero(may & (self.component != self.component[k]))
        agree = (self.sig[rest] == self.sig[k]).sum(axis=1)
        rest, agree = rest[agree >= least], agree[agree >= least]
        # a pair that shares several keys is compared under the first of them
        here = (self.bands[rest] == self.bands[k]).argmax(axis=1) == self.band if len(rest) else np.zeros(0, bool)
        return rest[here][np.argsort(-agree[here], kind="stable")]


_MEETING = "key long, i int, j int, minor boolean, own int, id long, component long, code binary"


def _across(placed: DataFrame, chosen: DataFrame, docs: DataFrame, width: int, percent: int, least: int, hashes: int) -> DataFrame:
    """Links between members of a key that are not in one component.

    placed: key, id, component.  The rows of a key's largest component (major) are
    compared with all others (minor), and these among themselves, in pairs of
    blocks: first by signature, then, for rows that have a partner, by full set.
    Within such a pair, comparing sets stops for rows that a link found there has
    brought together, so what comes out are a few links for each component.
    """
    by_part = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    by_key = by_part.groupBy("key").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.count("*").alias("parts")).filter("parts > 1 AND size > 2")
    major = by_part.join(by_key, "key").filter("n = most").groupBy("key", "size", "most").agg(F.min("component").alias("major"))

    def code(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"id": pdf["id"], "code": [s + np.asarray(b, np.int64).astype(np.uint32).tobytes() for s, b in zip(pdf["sig"], pdf["bands"])]})

    members = placed.join(major, "key").join(chosen.mapInPandas(code, "id long, code binary"), "id")
    minor = F.col("component") != F.col("major")
    members = members.select("key", "id", "component", "code", minor.alias("minor"), F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("x"), F.ceil(F.col("most") / BLOCK).cast("int").alias("y"))
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("x")).otherwise(F.col("y"))).cast("int"))
    # minor block i meets major block j in (i, j), and minor block j in (i, -1 - j)
    whole = lambda n: F.sequence(F.lit(0), n - 1)
    own, x, y = F.col("own"), F.col("x"), F.col("y")
    to_minor = F.transform(whole(x), lambda k: F.struct(F.least(own, k).alias("i"), (F.lit(-1) - F.greatest(own, k)).alias("j")))
    to_major = F.transform(whole(y), lambda k: F.struct(own.alias("i"), k.alias("j")))
    from_major = F.transform(whole(x), lambda k: F.struct(k.alias("i"), own.alias("j")))
    spread = members.withColumn("at", F.explode(F.when(F.col("minor"), F.concat(to_minor, to_major)).otherwise(from_major)))
    spread = spread.select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "minor", "own", "id", "component", "code")
    keys = ["key", "i", "j"]

    def alike(g: pd.DataFrame) -> pd.DataFrame:
        """The rows that have a partner by their signatures."""
        m, keep = _Meeting(g, hashes), np.zeros(len(g), bool)
        for k in np.flatnonzero(m.minor):
            rest = m.partners(k, least)
            if len(rest):
                keep[k] = True
                keep[rest] = True
        return g[keep]

    open_ = written(spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda it: _by_group(it, keys, alike), _MEETING), "open")
    full = _sets(docs, open_.select("id").distinct(), width)

    def links(g: pd.DataFrame) -> pd.DataFrame:
        m, ids, sets, out = _Meeting(g, hashes), g["id"].to_numpy(), g["set"].tolist(), []
        for k in np.flatnonzero(m.minor):
            for other in m.partners(k, least):
                if m.component[other] != m.component[k] and _similar(sets[k], sets[other], percent):
                    out.append((int(ids[k]), int(ids[other])))
                    m.component[m.component == m.component[other]] = m.component[k]
        return pd.DataFrame(out, columns=["a", "b"])

    with_sets = open_.join(full, "id").repartition(*keys).sortWithinPartitions(*keys)
    found = written(with_sets.mapInPandas(lambda it: _by_group(it, keys, links), "a long, b long").distinct(), "links")
    forget(open_)
    forget(full)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 75, hashes: int = 128, rows: int = 4) -> DataFrame:
    """id, n_shingles, class_id and component_id of every row.

    Links: pairs with 100 * |A & B| >= percent * |A | B|.  class_id: the least id
    with the same set of shingles; component_id: the least id reachable by links.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the agreement that a pair at the threshold misses with probability under 1e-6
    p = percent / 100 + (1 - percent / 100) / 256
    least = int(hashes * p - 5.2 * (hashes * p * (1 - p)) ** 0.5)

    signed = written(_signed(docs, width, hashes, rows), "signed")
    known = signed.filter("id IS NOT NULL AND n > 0")
    classes = written(known.groupBy("fp").agg(F.min("id").alias("class")), "classes")
    # a class and the rows of the id that stands for it
    chosen = known.join(classes.select(F.col("class").alias("id"), "fp"), ["id", "fp"]).dropDuplicates(["id", "fp"]).select("id", "sig", "bands")
    chosen = written(chosen, "chosen")
    # an id with several texts ties their classes together
    repeated = known.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("id")
    tied = known.join(repeated, "id", "left_semi").join(classes, "fp").filter("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b"))

    keyed = chosen.select("id", F.explode("bands").alias("key"))
    pivots = [F.min(F.col("id").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)).alias(f"p{k}") for k, m in enumerate(MASKS)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), *pivots).filter("size > 1")
    members = written(keyed.join(shared, "key"), "members")
    pairs = members.select("id", F.explode(F.array(*[f"p{k}" for k in range(len(MASKS))])).alias("p")).filter("id <> p")
    pairs = pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()

    first = written(_agreeing(pairs, chosen, least), "pairs")
    links = _linked(first, docs, width, percent)
    so_far = connected_components(links)

    placed = members.select("key", "id").join(so_far, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = written(placed, "placed")
    more = _across(placed, chosen, docs, width, percent, least, hashes)

    components = connected_components(links.unionByName(more).unionByName(tied))

    of_class = classes.join(components.select(F.col("id").alias("class"), "component"), "class", "left").select("fp", "class", F.coalesce("component", "class").alias("component"))
    out = signed.join(of_class, "fp", "left")
    none = F.col("fp").isNull() | F.col("id").isNull()
    result = out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(none, F.col("id")).otherwise(F.col("class")).alias("class_id"),
        F.when(none, F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )
    result = written(result, "components")
    for t in (members, placed, first, signed, classes, chosen, links, more):
        forget(t)
    return result


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, with all their columns.

    Rows without an id stay, and rows that repeat an id stay or go together.
    """
    gone = near_duplicates(docs, id_col, text_col, **how).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast(docs.schema[id_col].dataType)).distinct()
    gone = written(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, id_col, "left_anti").select(docs.columns)
