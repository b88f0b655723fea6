"""Sharding through fixed virtual slots.

Every record is hashed to one of ``SLOTS`` virtual slots, and bytes and rows are summed per slot. A versioned table
maps slots to shards: version 1 deals the slots in turn, and each rebalancing writes a next version in which only
some slots have another shard: those whose move evens out the bytes. With a ``store`` the map stays beside the data,
and the next run edits its latest version instead of dealing anew; a version counts once it is written whole. Records never change their slot, so a
rebalancing moves whole slots and needs no record to be hashed again. A record's place in its shard is the number of
rows in the shard's lower slots plus its place in its own slot, so no shard is sorted as a whole.

Cases: a null text counts one byte and has checksum 0; a null id is hashed by the rest of the record; repeated rows
get a place each; an empty table gives no rows and still a map; other input columns are not read; a text larger than
a shard's fair share stays in one slot, alone if need be.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm import common

SLOTS = 4096
SHARDS = 16
#: Rebalancing stops when the fullest and emptiest shards differ by this part of the mean.
TOLERANCE = 1e-4
MAP_SCHEMA = "version int, slot int, shard int, slot_bytes bigint, slot_rows bigint"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> dict[int, int]:
    return {slot: slot % shards for slot in range(slots)}


def rebalance(mapping: dict[int, int], weight: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """The slots to move and their new shards. Works on the map alone, so its cost is that of ``SLOTS`` slots."""
    load = [0] * shards
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, shard in mapping.items():
        if w := weight.get(slot, 0):
            load[shard] += w
            held[shard][slot] = w
    mean = sum(load) / shards
    moved: dict[int, int] = {}
    for _ in range(8 * len(mapping)):
        low = min(range(shards), key=load.__getitem__)
        best = None
        for high in heapq.nlargest(4, range(shards), key=load.__getitem__):
            gap = load[high] - load[low]
            if gap <= max(1, tolerance * mean):
                continue
            # one slot over, or two exchanged, that brings the difference nearest to half the gap
            for slot, w in held[high].items():
                if 0 < w < gap and (best is None or abs(gap / 2 - w) < best[0]):
                    best = (abs(gap / 2 - w), high, slot, None)
            if best is None or best[0] > tolerance * mean / 2:
                least = sorted((w, slot) for slot, w in held[low].items())
                for slot, w in held[high].items():
                    other = _nearest(least, w - gap / 2)
                    if other and 0 < w - other[0] < gap and (best is None or abs(gap / 2 - (w - other[0])) < best[0]):
                        best = (abs(gap / 2 - (w - other[0])), high, slot, other[1])
        if best is None:
            break
        _, high, slot, other = best
        for s, a, b in ((slot, high, low), *([(other, low, high)] if other is not None else [])):
            w = held[a].pop(s)
            held[b][s] = w
            load[a] -= w
            load[b] += w
            moved[s] = b
    return {s: shard for s, shard in moved.items() if mapping[s] != shard}


def _nearest(ordered: list[tuple[int, int]], want: float) -> tuple[int, int] | None:
    import bisect

    at = bisect.bisect_left(ordered, (want, -1))
    return min(ordered[max(0, at - 1) : at + 1], key=lambda x: abs(x[0] - want), default=None)


def slot_map(rows: DataFrame, slots: int = SLOTS, shards: int = SHARDS, store: str | None = None) -> DataFrame:
    """All versions of the map, after a next one with the edits of a rebalancing by the bytes of ``rows``.

    ``store`` is a folder that keeps the versions; the first run deals version 1 there. Without one the map is dealt
    anew and kept for the session. A stored map has to have been made for as many slots and shards.
    """
    spark = rows.sparkSession
    found = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # at most SLOTS rows
    weight, count = {r["vslot"]: r["b"] for r in found}, {r["vslot"]: r["n"] for r in found}

    def version(number: int, mapping: dict[int, int]) -> DataFrame:
        held = [(number, s, shard, weight.get(s, 0), count.get(s, 0)) for s, shard in mapping.items()]
        return spark.createDataFrame(held, MAP_SCHEMA).coalesce(1)

    kept = stored_versions(spark, store) if store else []
    if kept:
        last = spark.read.schema(MAP_SCHEMA).parquet(f"{store}/v{kept[-1]}").collect()  # SLOTS rows
        latest = {r["slot"]: r["shard"] for r in last}
        if len(latest) != slots or not set(latest.values()) <= set(range(shards)):
            raise ValueError(f"the map in {store} is not one of {slots} slots and {shards} shards")
    else:
        latest, kept = first_map(slots, shards), [1]
        dealt = version(1, latest)
        if store:
            dealt.write.mode("overwrite").parquet(f"{store}/v1")
    edited = version(kept[-1] + 1, latest | rebalance(latest, weight, shards))
    if not store:
        return common.settle(dealt.union(edited).coalesce(1), "slot-map")
    edited.write.mode("overwrite").parquet(f"{store}/v{kept[-1] + 1}")
    return spark.read.schema(MAP_SCHEMA).parquet(*(f"{store}/v{v}" for v in [*kept, kept[-1] + 1]))


def stored_versions(spark: SparkSession, store: str) -> list[int]:
    """The versions in ``store`` that were written whole, in order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/v*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in done or [])


def assign(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Shard and place of every row under the latest version of the map."""
    # the map has a fixed number of rows, so its windows and its broadcast do not grow with the data
    latest = mapping.withColumn("latest", F.max("version").over(Window.partitionBy("slot"))).where("version = latest")
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    places = latest.select(F.col("slot").alias("vslot"), "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("place", within - 1).join(F.broadcast(places), "vslot").withColumn("slot", F.col("base") + F.col("place"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.settle(records(common.read_table(spark, sf_dir, "documents")), "slot-rows")
    return assign(rows, slot_map(rows)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
