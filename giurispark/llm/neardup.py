"""Near-duplicate records (problem 5).

A record is the set of distinct three-word sequences of its text. Its fingerprint is a
vector of minhash symbols, of which two records share each with a probability equal to
their Jaccard similarity, so the Hamming distance of fingerprints estimates it.

Multi-index hashing: the fingerprint of 184 one-byte symbols is cut into 46 segments of
four. Equal segments are the key of the segment's table (a segment has 32 bits; it takes the
place of enumerating a ball of radius one around longer ones, at less than half the keys for
the same recall). Records that meet once have the last bits of their symbols compared on the
spot, so chance meetings, which grow as the square of the records, are never written. Of the
rest the complete fingerprint distance is verified, and then the similarity on the sets
themselves. At similarity 0.68 a pair is missed with a probability of 2e-5, at the threshold
of 0.6 with 2e-3; no candidate is dropped for the size of its bucket.

What lies on disk at a time is bounded: the tables are built in a few passes, and the shuffle
files of a step go when it is done. Sets, which are larger than the texts, are not kept: they
are made again for the records of pairs that the fingerprints leave.

Records with equal sets form one class and only its least id is indexed. A bucket with
more than ``block`` members is cut into blocks, and each pair of blocks is joined on its
own, so no task joins a whole large bucket. Pairs of classes, with class membership, are the
result; all pairs of records only where they are asked for.

Cases: null parts count as empty; a text of fewer than three words has no sequence and
is like nothing; equal texts under several ids are one class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giurispark.llm.forms import words
from giurispark.session import cut, spread

SEGMENTS, SYMBOLS = 46, 4
#: Segments are indexed in so many passes.
PASSES = 4
#: Odd multipliers and offsets of the minhash functions, from a fixed generator.
_RNG = np.random.default_rng(20_240_601)
_A = _RNG.integers(1, 2**63, SEGMENTS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SEGMENTS * SYMBOLS, dtype=np.uint64)
#: 42 of 100 symbols equal: five standard deviations below what a similarity of 0.6 gives.
LEAST_EQUAL = int(0.42 * SEGMENTS * SYMBOLS)
#: Last bits that may differ, of one a symbol: 3.8 standard deviations above what a similarity of 0.6 gives, a fifth of them.
MOST_BITS = 57
SKETCH = ("s0", "s1", "s2")
#: Bits of the filter for records whose sets are made again; one bitmap of bitmap_construct_agg has 2^15.
_FILTER_BITS = 25


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def all_shingles(texts: list[list[str]], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash): the sorted distinct 64-bit hashes of the word sequences of every text, by text; all texts of a batch at once."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    codes, uniques = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    h = pd.util.hash_array(uniques.astype(object), categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64)
    m = max(0, len(h) - width + 1)
    out = np.zeros(m, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    owner = np.repeat(np.arange(len(texts)), n)
    inside = owner[:m] == owner[len(h) - m :]  # a sequence lies within one text
    owner, out = owner[:m][inside], out[inside]
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (out[1:] != out[:-1])
    return owner[new], out[new]


def shingles(tokens: list[str], width: int = 3) -> np.ndarray:
    """Those of one text."""
    return all_shingles([tokens], width)[1]


def fingerprint(s: np.ndarray) -> np.ndarray:
    """Symbols of one set."""
    return fingerprints(s, np.zeros(1, np.int64))[0]


def fingerprints(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minhash symbols of 8 bits, a row for each set; a set begins at each of starts."""
    best = np.empty((len(starts), len(_A)), np.uint64)
    ends = np.append(starts[1:], len(s))
    lo = 0
    while lo < len(starts):  # bounds the matrix; a very long text is a group of its own, taken function by function
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 50_000, "right")))
        part, at = s[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo]
        for f in range(len(_A)):
            best[lo:hi, f] = np.minimum.reduceat(part * _A[f] + _B[f], at)
        lo = hi
    return (_mix(best) >> np.uint64(56)).astype(np.uint8)  # the first bits of a minimum say little


def sketches(symbols: np.ndarray) -> np.ndarray:
    """The last bits of all symbols as three 64-bit numbers, a row for each fingerprint."""
    out = np.zeros((len(symbols), 8 * len(SKETCH)), np.uint8)
    bits = np.packbits(symbols & 1, axis=1)
    out[:, : bits.shape[1]] = bits
    return out.view(np.int64)


_LONGS = T.ArrayType(T.LongType())
SCHEMA = T.StructType([*[T.StructField(c, T.LongType()) for c in ("id", "cls", "cls2", *SKETCH)], T.StructField("segments", T.ArrayType(T.IntegerType()))])
SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("set", _LONGS)])


def _list(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def _made(width: int, prints: bool, sets: bool):
    """Batches of (id, text) into those of SCHEMA, or of SETS, or of both."""
    names = ["id", *["cls", "cls2", *SKETCH, "segments"] * prints, *["set"] * sets]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                owner, s = all_shingles([words(t or "") for t in batch["text"][at : at + 500].to_pylist()], width)
                if not len(s):
                    continue
                rows, starts, sizes = np.unique(owner, return_index=True, return_counts=True)
                out = [batch["id"][at : at + 500].take(pa.array(rows))]
                if prints:
                    symbols = fingerprints(s, starts)
                    # two independent digests name the set
                    one = np.bitwise_xor.reduceat(_mix(s + np.repeat(sizes, sizes).astype(np.uint64)), starts)
                    two = np.add.reduceat(_mix(s ^ np.uint64(0xD6E8FEB86659FD93)), starts)
                    out += [pa.array(x) for x in (one.view(np.int64), two.view(np.int64), *np.ascontiguousarray(sketches(symbols).T))]
                    out.append(_list(symbols.view(np.int32).ravel(), np.arange(len(rows) + 1) * SEGMENTS))
                if sets:
                    out.append(_list(s.view(np.int64), np.append(starts, len(s))))
                yield pa.RecordBatch.from_arrays(out, names)

    return batches


def _named(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("id").cast("long").alias("id"), "text")


def features(texts: DataFrame, width: int = 3, sets: bool = True) -> DataFrame:
    """(id, cls, cls2, sketch, segments) and, if asked for, the set, for rows (id, text), written once; a segment is the number that its symbols make."""
    return cut(spread(_named(texts)).mapInArrow(_made(width, True, sets), T.StructType([*SCHEMA, *[SETS["set"]] * sets])))


def classes(table: DataFrame) -> DataFrame:
    """(id, rep): every record with the least id of those that have its set."""
    reps = table.groupBy("cls", "cls2").agg(F.min("id").alias("rep"))
    return table.select("id", "cls", "cls2").join(reps, ["cls", "cls2"]).select("id", "rep")


def _meetings(posts: DataFrame, key: str, block: int, near: str = "true") -> DataFrame:
    """(a, b) for every two ids (a < b) of a group that are near, a condition on both rows; once for each group.

    The postings are shuffled once. A group of more than block members is cut into blocks, and each pair of blocks is a
    join key of its own, so no task joins such a group; a row for each of them, at most one in block postings, is broadcast.
    """
    posts = posts.repartition(key)
    large = F.broadcast(posts.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > block).select(key, F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    both = f"a.{key} = b.{key} AND a.id < b.id AND ({near})"
    pairs = lambda rows, same: rows.alias("a").join(rows.alias("b"), F.expr(f"{both} AND {same}")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    own = posts.join(large, key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return pairs(posts.join(large, key, "left_anti"), "true").unionByName(pairs(cells, "a.lo = b.lo AND a.hi = b.hi AND (a.lo = a.hi OR a.own <> b.own)"))


def _candidates(reps: DataFrame, block: int) -> DataFrame:
    """Pairs (a < b) that share a segment and whose sketches are near; a pass for a part of the segments after the other."""
    near = " + ".join(f"bit_count(a.{s} ^ b.{s})" for s in SKETCH) + f" <= {MOST_BITS}"
    found, step = [], -(-SEGMENTS // PASSES)
    for first in range(0, SEGMENTS, step):
        posts = reps.select("id", *SKETCH, F.posexplode(F.slice("segments", first + 1, step)).alias("own", "segment"))
        posts = posts.select("id", *SKETCH, F.expr("shiftleft(CAST(own AS BIGINT), 32) | (segment & 4294967295)").alias("key"))
        found.append(cut(_meetings(posts, "key", block, near).distinct(), release=True))
    return reduce(DataFrame.unionByName, found).distinct()


def _sets(texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(id, set) of at least the records of the pairs. A filter of bounded size passes by most others, without a shuffle of the texts."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select((slot % 32768).alias("at"), F.shiftright(slot, 15).alias("bucket"))
    filters = F.broadcast(ids.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))
    byte = F.expr("CAST(conv(hex(substring(bits, CAST(slot % 32768 DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    there = _named(texts).withColumn("slot", slot).withColumn("bucket", F.shiftright("slot", 15)).join(filters, "bucket")
    there = there.where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(slot % 8 AS INT))")) != 0)
    return there.select("id", "text").mapInArrow(_made(width, False, True), SETS).repartition("id")  # both sides of a pair take this one shuffle


def class_pairs(table: DataFrame, threshold: float = 0.6, block: int = 1000, texts: DataFrame | None = None, width: int = 3) -> DataFrame:
    """(a, b, similarity, distance) for the representatives of different classes at or above the threshold, written once; texts where the table was made without sets."""
    least = classes(table).where("id = rep").select("id")
    reps = cut(table.select("id", *SKETCH, "segments").join(least, "id"), release=True)
    body = lambda x: reps.select(F.col("id").alias(x), F.col("segments").alias(f"segments_{x}"))
    same = lambda x, y: sum((x.bitwiseXOR(y).bitwiseAND(F.lit(m)) == 0).cast("int") for m in (0xFF, 0xFF00, 0xFF0000, -0x1000000))
    equal = F.aggregate(F.zip_with("segments_a", "segments_b", same), F.lit(0), lambda s, x: s + x)
    near = _candidates(reps, block).join(body("a"), "a").join(body("b"), "b").withColumn("distance", SEGMENTS * SYMBOLS - equal)
    near = cut(near.where(F.col("distance") <= SEGMENTS * SYMBOLS - LEAST_EQUAL).select("a", "b", "distance"), release=True)
    sets = table.select("id", "set") if texts is None else _sets(texts, near, width)
    own = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    found = near.join(own("a"), "a").join(own("b"), "b").select("a", "b", (common / (F.size("set_a") + F.size("set_b") - common)).alias("similarity"), "distance")
    return cut(found.where(F.col("similarity") >= threshold), release=True)


def record_pairs(members: DataFrame, pairs: DataFrame, block: int = 1000) -> DataFrame:
    """All pairs of records (a < b): between the members of similar classes, and within classes. As large as what it lists."""
    left, right = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = _meetings(members, "rep", block)
    return across.unionByName(within)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the least id that links reach.

    Each round is a large-star and a small-star step: every node's greater neighbours are
    linked to its least one, then its smaller neighbours and itself. Roots are hooked to
    each other on the way, so a chain takes rounds by the logarithm of its length. The end
    is a star around every least id; links that have not come to that are an error.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        links = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        near = links.join(least, "u")
        links = cut(near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
    else:
        raise RuntimeError(f"links are not settled after {rounds} rounds")
    return nodes.select("id").join(links.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
