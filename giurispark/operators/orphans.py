"""References to records that do not exist at the time of the reference.

Keys are ordered by their 64-bit hash and cut into equal ranges of hash space, so
range borders need neither sampling nor a driver-side list and every range holds an even
share of the parents. Of each range the parents are kept as sorted arrays; batches of
references are probed against them by vectorised binary search, first for the key, then
for the key's interval of validity.

A key that many references share makes its range hot: references are dealt to as many
slots of the range as their count needs, and only such a range's parents are copied to
its slots. There are as many ranges as keep the parents of one near ``PARENTS``, so no group
is larger than ``batch`` references plus that. Ranges of key hashes stand for ranges of keys:
they hold even shares without a sample, and equality is all that is asked of keys.

Cases: a null reference key is no reference; a key that has no canonical form matches
nothing and is ``missing``; a null time matches no interval (``late`` if the key exists);
a parent row without ``loaded_at`` never counts as loaded; repeated parents and repeated
references count once; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT = T.StructType([
    T.StructField("src_table", T.StringType()),
    T.StructField("record_key", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("ref_time", T.TimestampNTZType()),
])


#: Parents a range holds on average, at most; an end that never comes.
PARENTS, ALWAYS = 100_000, 2**63 - 1


def parents_by_key(registry: DataFrame, key: Column, start: str, end: str) -> DataFrame:
    """One row per key: when it was first loaded, and the starts and ends of its periods of validity, sorted and disjoint."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp"))
    rows = registry.select(key.alias("key"), micros(start).alias("s"), micros(end).alias("e")).where("key is not null")
    spans = rows.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", F.coalesce("e", F.lit(ALWAYS)).alias("e"))))).alias("spans"))
    # neighbours that touch become one; of a key's loads there are few
    joined = F.aggregate(
        F.filter("spans", lambda x: x["e"] > x["s"]), F.expr("CAST(array() AS array<struct<s: bigint, e: bigint>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= x["s"]),
                               F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(done, F.lit(-1))["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(done, F.array(x))),
    )
    return spans.select("key", F.get("spans", F.lit(0))["s"].alias("first"), joined.alias("spans")).select("key", "first", F.transform("spans", lambda x: x["s"]).alias("starts"), F.transform("spans", lambda x: x["e"]).alias("ends"))


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    n, m = refs.num_rows, parents.num_rows
    kinds = np.full(n, "missing", dtype=object)
    keep = np.ones(n, dtype=bool)
    if n and m:
        parents = parents.take(pc.sort_indices(parents["h"])).combine_chunks()
        hashes, keys = parents["h"].to_numpy(), parents["key"].combine_chunks()
        first = pc.fill_null(parents["first"], ALWAYS).to_numpy()
        lists = parents["starts"].combine_chunks()
        starts, ends = lists.flatten().to_numpy(), parents["ends"].combine_chunks().flatten().to_numpy()
        owner = np.repeat(np.arange(m), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        want, wanted = refs["h"].to_numpy(), refs["key"].combine_chunks()
        at = np.searchsorted(hashes, want)
        found = np.full(n, -1, dtype=np.int64)
        live = np.flatnonzero(at < m)
        live = live[hashes[at[live]] == want[live]]
        while len(live):  # one round, and one more for each further key of the same hash
            hit = pc.equal(keys.take(pa.array(at[live])), wanted.take(pa.array(live))).to_numpy(zero_copy_only=False).astype(bool)
            found[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < m]
            live = live[hashes[at[live]] == want[live]]
        there = found >= 0
        known = ~pc.is_null(refs["t"]).to_numpy()
        t = pc.fill_null(refs["t"], 0).to_numpy()
        axis = np.unique(starts)
        width = len(axis) + 1
        ladder = owner * width + np.searchsorted(axis, starts, side="right")
        spot = np.searchsorted(ladder, found * width + np.searchsorted(axis, t, side="right"), side="right") - 1
        valid = there & known & (spot >= 0)
        valid[valid] &= (owner[spot[valid]] == found[valid]) & (t[valid] < ends[spot[valid]])
        loaded = there & known
        loaded[loaded] &= first[found[loaded]] <= t[loaded]
        kinds[there] = "late"
        kinds[loaded] = "deleted"
        keep = ~valid
    got = refs.filter(pa.array(keep))
    return pa.table({"src_table": got["src_table"], "record_key": got["record_key"], "kind": pa.array(kinds[keep], pa.string()), "ref_time": got["ref_time"]})


def orphans(refs: DataFrame, registry: DataFrame, canonical: Callable[[Column], Column], start: str, end: str, batch: int = 200_000) -> DataFrame:
    """Rows (src_table, record_key, kind, ref_time) of the references that find no valid parent, each once.

    refs has src_table, record_key, ref (the key as written) and ref_time; registry has
    ``key`` (as written) and the columns named by start and end; canonical brings both to one form.
    """
    spark = refs.sparkSession
    refs = refs.where("ref is not null").select(
        "src_table", F.col("record_key").cast("string").alias("record_key"),
        F.coalesce(canonical(F.col("ref")), F.concat(F.lit("?"), F.col("ref"))).alias("key"),
        F.col("ref_time").cast("timestamp_ntz").alias("ref_time"),
    )
    parents = parents_by_key(registry, canonical(F.col("key")), start, end)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4 * slots - 1, registry.count() // PARENTS).bit_length()  # rows bound the keys of a range
    ranged = lambda df: df.withColumn("h", F.xxhash64("key")).withColumn("r", F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0))
    refs, parents = ranged(refs), ranged(parents)
    load = refs.groupBy("r").count().select("r", F.ceil(F.col("count") / batch).cast("int").alias("n_slots")).where("n_slots > 1")
    refs = refs.join(F.broadcast(load), "r", "left").select(  # at most one small row for each range
        "src_table", "record_key", "key", "ref_time", "h", "r",
        F.unix_micros(F.col("ref_time").cast("timestamp")).alias("t"),
        F.when(F.col("n_slots").isNull(), 0).otherwise(F.pmod(F.xxhash64("src_table", "record_key"), F.col("n_slots"))).cast("int").alias("slot"),
    )
    parents = parents.join(F.broadcast(load), "r", "left").select("key", "h", "first", "starts", "ends", "r", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_slots"), F.lit(1)) - 1)).alias("slot"))
    found = refs.groupBy("r", "slot").cogroup(parents.groupBy("r", "slot")).applyInArrow(_probe, OUT)
    # a record repeated as it was gives one row; the same key at several times, the first kind in order of time
    return found.groupBy("src_table", "record_key").agg(F.min(F.struct("ref_time", "kind")).alias("x")).select("src_table", "record_key", "x.kind", "x.ref_time")
