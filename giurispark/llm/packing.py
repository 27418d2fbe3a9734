"""Items of varying length in containers of fixed capacity (problem 7).

Documents are counted in tokens of a public tokenizer and hashed to a vector (signed word
hashes summed over a few random directions). The vector's place on a Hilbert curve is the
sort key: neighbours on the curve are alike. The curve is cut into ranges of about ``RANGE``
documents at cells of its first ``CELL_BITS`` bits, from the exact counts of the cells; a
cell that holds more (a crowd of equal documents) is dealt to several ranges by id. Ranges
do not depend on the cluster, so the same documents give the same containers, whose number
is that of the range and a count within it. Each range is packed by one pass along the
curve: a window of neighbours at a time, largest first, into the open container it fits
best; containers that stay open wait for the next window.

A document is split only if it alone exceeds the capacity: full pieces have containers of
their own, its rest is packed like any other item.

Cases: null and empty texts have no tokens and go where the next item goes; repeated ids
are items of their own; an empty table gives no rows; containers never exceed capacity.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giurispark.llm.forms import words
from giurispark.session import cut, spread

CAPACITY = 2048
#: Vocabulary of ranks for byte-level BPE, and the pattern that goes with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
DIMENSIONS, BITS = 4, 12
#: Documents looked at together, and containers left open between windows.
WINDOW, OPEN = 1024, 256
#: Documents of a range, and bits of the key that name a cell of the curve (their counts, at most two to that power, are gathered).
RANGE, CELL_BITS = 10_000, 14


@cache
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n, d): the transposed form by exchange and inversion, then a Gray decode."""
    x = points.astype(np.uint64).T.copy()
    d, one = len(x), np.uint64(1)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = np.uint64(q - 1)
        for i in range(d):
            up = (x[i] & np.uint64(q)) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t = np.where((x[d - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def places(texts: list[list[str]]) -> np.ndarray:
    """Points of documents given as words: word counts hashed onto a few directions, squashed to a grid. All words of a batch at once, each different word hashed once."""
    n = np.array([len(t) for t in texts])
    points = np.zeros((len(texts), DIMENSIONS), np.int64)
    if n.sum():
        codes, uniques = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
        h = pd.util.hash_array(uniques.astype(object), categorize=False)
        signs = np.stack([((h >> np.uint64(7 * k + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1 for k in range(DIMENSIONS)], axis=1)[codes]
        some = np.flatnonzero(n)
        sums = np.add.reduceat(signs, (np.cumsum(n) - n)[some], axis=0)
        points[some] = np.minimum((1 << BITS) - 1, (np.tanh(sums / (1.5 * np.sqrt(n[some]))[:, None]) + 1) / 2 * (1 << BITS)).astype(np.int64)
    return points


def _sizes(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), ("key", pa.int64())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in source:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for at in range(0, len(texts), 500):
                some = texts[at : at + 500]
                counts = [len(encode.encode_ordinary(t)) for t in some]  # a batch call is slower on one thread
                yield pa.RecordBatch.from_arrays([batch["doc_id"][at : at + 500], pa.array(counts, pa.int64()), pa.array(hilbert(places([words(t) for t in some]), BITS), pa.int64())], schema=schema)

    return batches


class Packer:
    """Best fit over open containers; rooms is sorted by (free space, container)."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.rooms = capacity, first, []

    def put(self, size: int) -> int:
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, box = self.rooms.pop(at)
        else:
            room, box, self.next = self.capacity, self.next, self.next + 1
        if room - size > 0:
            insort(self.rooms, (room - size, box))
        return box

    def trim(self, keep: int) -> None:
        """Close the fullest containers beyond keep."""
        if len(self.rooms) > keep:
            del self.rooms[: len(self.rooms) - keep]


def pack(rows: Iterator[tuple[int, int]], capacity: int, first: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc_id, piece, pieces, container, tokens) for (doc_id, tokens) in the order of the curve."""
    box, window = Packer(capacity, first), []

    def flush() -> Iterator[tuple[int, int, int, int, int]]:
        for size, key, piece, pieces in sorted(window, reverse=True):
            yield key, piece, pieces, box.put(size), size
        window.clear()
        box.trim(OPEN)

    for key, size in rows:
        pieces = max(1, -(-size // capacity))
        for piece in range(pieces):
            window.append((min(capacity, size - piece * capacity), key, piece, pieces))
        if len(window) >= WINDOW:
            yield from flush()
    yield from flush()


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("container", T.LongType()), T.StructField("tokens", T.LongType())])


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Assignment of every document (doc_id, text), or of its pieces, to containers."""
    spark = documents.sparkSession
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sizes = cut(docs.mapInArrow(_sizes(vocabulary), "doc_id long, tokens long, key long"))  # counted and packed: read twice, tokenised once
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("container", pa.int64()), ("tokens", pa.int64())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in source for row in zip(*(batch[c].to_pylist() for c in ("range", "doc_id", "tokens"))))
        out = []
        for place, group in groupby(rows, key=lambda r: r[0]):
            for row in pack(((k, n) for _, k, n in group), capacity, place << 32):
                out.append(row)
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    cell = F.shiftright("key", DIMENSIONS * BITS - CELL_BITS)
    cells, start, filled = [], 0, 0
    for row in sorted(sizes.groupBy(cell.alias("cell")).count().collect()):  # at most 2 ** CELL_BITS rows
        parts = max(1, -(-row["count"] // RANGE))
        if filled and (parts > 1 or filled + row["count"] > RANGE):
            start, filled = start + 1, 0
        cells.append((row["cell"], start, parts))
        start, filled = (start + parts, 0) if parts > 1 else (start, filled + row["count"])
    ranges = spark.createDataFrame(cells, "cell long, first long, parts long")
    placed = sizes.withColumn("cell", cell).join(F.broadcast(ranges), "cell").select((F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("range"), "key", "doc_id", "tokens")
    return placed.repartition("range").sortWithinPartitions("range", "key", "doc_id", "tokens").select("range", "doc_id", "tokens").mapInArrow(batches, OUT)
