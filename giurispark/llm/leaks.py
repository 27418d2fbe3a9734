"""Held-out passages inside a corpus (problem 8).

The held-out items are the stated query set: every window of ``width`` words of every
item. Each document slides the same window, all windows of a batch at once.

Equal windows: windows with a word pair that no item has are passed over by running sums;
the others get a 64-bit SimHash of their weighted word pairs. Fingerprints are cut into radius + 1 blocks: two that differ in at most ``radius``
bits agree in one block at least, so equal block values give every fingerprint within the
radius, equal ones among them.

Near windows: a window has too few word pairs for the radius to hold those whose weighted
Jaccard similarity reaches ``similar`` (most differ in more bits), so they are found by
overlap. The pairs that a document's window does not share weigh at most 1 - similar of
it: windows with more weight outside the items' pairs are dropped, and of the others the
pairs that fewest windows of the items have, as many as weigh more than that, hold one at
least that is shared. No near window is missed, and equal ones are among them.

Candidates are verified on the words themselves: equal windows, or windows whose weighted
Jaccard similarity reaches ``similar``.

The query set goes to the tasks in parts of at most ``part`` windows, so what is sent is
bounded; more items mean more passes, one after the other, not a larger broadcast.
Documents are not shuffled, unless the scan has fewer parts than the cluster has cores.

Cases: null and empty texts and items contain nothing; an item of fewer than ``width``
words has no window and is never found; repeated documents are reported one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giurispark.llm.forms import words
from giurispark.session import cut, spread

OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("exact", T.IntegerType()),
    T.StructField("near", T.IntegerType()), T.StructField("best", T.DoubleType()), T.StructField("first_word", T.IntegerType()),
])
#: Words of one pass of the running sums.
CHUNK = 40_000


def word_hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and weight (length, at most 15) of each word."""
    codes, uniques = pd.factorize(np.array(tokens, dtype=object))
    return pd.util.hash_array(uniques.astype(object), categorize=False)[codes], np.minimum([len(u) for u in uniques], 15).astype(np.int16)[codes]


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with the next one."""
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019))
    pair ^= pair >> np.uint64(29)
    pair *= np.uint64(0xBF58476D1CE4E5B9)
    return pair ^ (pair >> np.uint64(32))


def fingerprints(h: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every window of width words: the signs of the weighted bit sums of its word pairs."""
    pair = pair_hashes(h)
    w = (weight[:-1] + weight[1:]).astype(np.int32)
    bits = np.unpackbits(pair.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.cumsum((bits * 2 - 1) * w[:, None], axis=0, dtype=np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), sums])
    n = width - 1
    return np.packbits(sums[n:] - sums[:-n] > 0, axis=1).view(np.uint64).ravel()


def fingerprints_at(pair: np.ndarray, weight: np.ndarray, window: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the windows of n word pairs that begin at the given places."""
    at = window[:, None] + np.arange(n)
    bits = np.unpackbits(pair[at].view(np.uint8).reshape(len(window), n, 8), axis=2).astype(np.int16)
    w = (weight[:-1] + weight[1:]).astype(np.int16)[at]
    return np.packbits(((bits * 2 - 1) * w[:, :, None]).sum(axis=1, dtype=np.int32) > 0, axis=1).view(np.uint64).ravel()


@dataclass
class Queries:
    """Windows of the held-out items, by fingerprint block; pairs are the hashes of all their word pairs."""

    item: np.ndarray
    print: np.ndarray
    words: list[tuple[str, ...]]
    width: int
    radius: int
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def __post_init__(self) -> None:
        self.edges = np.linspace(0, 64, self.radius + 2).astype(int)
        self.blocks = []
        for b in range(self.radius + 1):
            value = self.block(self.print, b)
            order = np.argsort(value, kind="stable")
            self.blocks.append((order, value[order]))

        self.known = np.unique(self.pairs)

    def candidates(self, h: np.ndarray, weight: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, query) pairs whose fingerprints lie within the radius, of windows marked inside that have no word pair foreign to all items (an equal window has none)."""
        pair = pair_hashes(h)
        at = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        n = self.width - 1
        run = np.cumsum(np.concatenate([[0], self.known[at] == pair]))
        window = np.flatnonzero(inside & (run[n:] - run[:-n] == n))
        if not len(window):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        prints = np.concatenate([fingerprints_at(pair, weight, some, n) for some in np.array_split(window, len(window) // 5_000 + 1)])
        w, query = self.within(prints)
        return window[w], query

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        lo, hi = int(self.edges[b]), int(self.edges[b + 1])
        return (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, query) pairs whose fingerprints differ in at most radius bits; each pair once."""
        found = []
        for b, (order, values) in enumerate(self.blocks):
            want = self.block(prints, b)
            lo, hi = np.searchsorted(values, want, "left"), np.searchsorted(values, want, "right")
            hit = np.flatnonzero(hi > lo)
            for at in range(0, len(hit), 200_000):  # bounds the pairs held at once
                some = hit[at : at + 200_000]
                n = hi[some] - lo[some]
                window = np.repeat(some, n)
                query = order[np.repeat(lo[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                near = np.bitwise_count(prints[window] ^ self.print[query]) <= self.radius
                found.append(window[near].astype(np.int64) * len(self.print) + query[near])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.print)), pairs % max(1, len(self.print))


def pair_sets(pair: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, weights) of every window of n pairs, a row each; a pair that the window has had before weighs nothing."""
    order = np.argsort(pair, kind="stable")
    again = np.flatnonzero(pair[order[1:]] == pair[order[:-1]])
    before = np.full(len(pair), -1)
    before[order[again + 1]] = order[again]
    rows = np.lib.stride_tricks.sliding_window_view
    first = rows(before, n) < np.arange(len(pair) - n + 1)[:, None]
    return rows(pair, n), rows((weight[:-1] + weight[1:]).astype(np.int32), n) * first


@dataclass
class Overlaps:
    """Windows of the held-out items, by word pair."""

    item: np.ndarray
    pairs: np.ndarray
    weights: np.ndarray
    words: list[tuple[str, ...]]
    width: int
    similar: float

    def __post_init__(self) -> None:
        self.known, ids = np.unique(self.pairs, return_inverse=True)
        self.total = self.weights.sum(axis=1)
        self.ids = np.where(self.weights > 0, ids.reshape(self.pairs.shape), -2).astype(np.int32)
        window, at = np.nonzero(self.weights)
        own = self.ids[window, at]
        self.posts = window[np.argsort(own, kind="stable")].astype(np.int32)
        self.ends = np.cumsum(np.bincount(own, minlength=len(self.known)))

    def candidates(self, h: np.ndarray, weight: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, query) pairs whose similarity, with pairs told by hash, reaches similar; each once, only windows marked inside."""
        pair, slack = pair_hashes(h), 1e-6
        at = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        at = np.where(self.known[at] == pair, at, -1).astype(np.int32)
        _, w = pair_sets(pair, weight, self.width - 1)
        ids = np.lib.stride_tricks.sliding_window_view(at, self.width - 1)
        total = w.sum(axis=1)
        window = np.flatnonzero(inside & ((w * (ids >= 0)).sum(axis=1) >= self.similar * total - slack))
        ids, w, total = np.where(w[window] > 0, ids[window], -1), w[window], total[window]
        size = np.where(ids >= 0, np.diff(self.ends, prepend=0)[ids], 0)
        order = np.argsort(size, axis=1, kind="stable")
        sorted_w = np.take_along_axis(w, order, axis=1)
        spent = np.cumsum(sorted_w, axis=1) - sorted_w
        n = np.where(spent <= (1 - self.similar) * total[:, None] + slack, np.take_along_axis(size, order, axis=1), 0)
        got = np.cumsum(n.sum(axis=1))
        found, lo = [], 0
        while lo < len(window):  # bounds the pairs held at once
            hi = max(lo + 1, int(np.searchsorted(got, (got[lo - 1] if lo else 0) + 200_000, "right")))
            row, k = np.nonzero(n[lo:hi])
            row += lo
            many, first = n[row, k], self.ends[ids[row, order[row, k]]] - n[row, k]
            query = self.posts[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
            both = np.unique(np.repeat(row, many) * len(self.total) + query)
            row, query = both // len(self.total), both % len(self.total)
            close = np.minimum(total[row], self.total[query]) >= self.similar * np.maximum(total[row], self.total[query]) - slack
            row, query = row[close], query[close]
            for some in range(0, len(row), 50_000):
                r, q = row[some : some + 50_000], query[some : some + 50_000]
                common = (w[r] * (ids[r][:, :, None] == self.ids[q][:, None, :]).any(axis=2)).sum(axis=1)
                good = common >= self.similar * (total[r] + self.total[q] - common) - slack
                found.append((window[r[good]], q[good]))
            lo = hi
        return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (np.zeros(0, np.int64),) * 2


def similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Weighted Jaccard of the word pairs of two windows."""
    if a == b:
        return 1.0
    x, y = set(zip(a, a[1:])), set(zip(b, b[1:]))
    weight = lambda pairs: sum(min(len(p), 15) + min(len(q), 15) for p, q in pairs)
    return weight(x & y) / max(1, weight(x | y))


def queries_of(items: list[tuple[int, str | None]], width: int, radius: int, similar: float, near: bool) -> Queries | Overlaps | None:
    item, prints, sets, texts = [], [], [], []
    for key, text in items:
        tokens = words(text or "")
        if len(tokens) < width:
            continue
        h, w = word_hashes(tokens)
        if near:
            sets.append(pair_sets(pair_hashes(h), w, width - 1))
        else:
            prints.append(fingerprints(h, w, width))
            sets.append(pair_hashes(h))
        item += [key] * (len(tokens) - width + 1)
        texts += [tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)]
    if not item:
        return None
    if near:
        return Overlaps(np.array(item, dtype=np.int64), *(np.concatenate(x) for x in zip(*sets)), texts, width, similar)
    return Queries(np.array(item, dtype=np.int64), np.concatenate(prints), texts, width, radius, np.concatenate(sets))


def scan(docs: list[tuple[int, list[str]]], q: Queries | Overlaps, similar: float) -> list[tuple]:
    """Rows of OUT for documents given as words; all windows of all documents at once."""
    docs = [(k, t) for k, t in docs if len(t) >= q.width]
    if not docs:
        return []
    tokens = [w for _, t in docs for w in t]
    h, weight = word_hashes(tokens)
    ends = np.cumsum([len(t) for _, t in docs])
    owner = np.repeat(np.arange(len(docs)), [len(t) for _, t in docs])
    starts = ends - np.array([len(t) for _, t in docs])
    found: dict[tuple[int, int], list] = {}
    for at in range(0, len(tokens) - q.width + 1, CHUNK):
        stop = min(len(tokens), at + CHUNK + q.width - 1)
        inside = owner[at : stop - q.width + 1] == owner[at + q.width - 1 : stop]
        window, query = q.candidates(h[at:stop], weight[at:stop], inside)
        for i, j in zip((window + at).tolist(), query.tolist()):
            own = tuple(tokens[i : i + q.width])
            equal = own == q.words[j]
            s = similarity(own, q.words[j])
            if equal or isinstance(q, Overlaps) and s >= similar:
                d = owner[i]
                row = found.setdefault((docs[d][0], int(q.item[j])), [0, 0, 0.0, i - int(starts[d])])
                row[0 if equal else 1] += 1
                row[2] = max(row[2], s)
                row[3] = min(row[3], i - int(starts[d]))
    return [(*k, *v) for k, v in found.items()]


def leaked(documents: DataFrame, items: DataFrame, width: int = 12, radius: int = 3, similar: float = 0.8, part: int = 200_000, near: bool = True) -> DataFrame:
    """(doc_id, item_id, exact, near, best, first_word): windows of the item found in the document; without near, equal windows only.

    documents: doc_id, text; items: item_id, text.
    """
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("exact", pa.int32()), ("near", pa.int32()), ("best", pa.float64()), ("first_word", pa.int32())])

    def run(q: Queries | Overlaps):
        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                keys, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
                for at in range(0, len(keys), 256):
                    rows = scan([(k, words(t)) for k, t in zip(keys[at : at + 256], texts[at : at + 256])], q, similar)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return docs.mapInArrow(batches, OUT)

    def add(found: DataFrame | None, q: Queries | Overlaps | None, more: bool) -> DataFrame | None:
        if q is None:
            return found
        rows = run(q)
        if found is not None or more:  # one part after the other: its tables leave the driver before the next ones come
            rows = cut(rows)
        return rows if found is None else found.unionByName(rows)

    out, some, size = None, [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        some.append((row[0], row[1]))
        size += len(row[1]) // 4
        if size >= part:
            out = add(out, queries_of(some, width, radius, similar, near), True)
            some, size = [], 0
    out = add(out, queries_of(some, width, radius, similar, near), False)
    return out if out is not None else docs.sparkSession.createDataFrame([], OUT)
