"""Filling fixed-capacity containers: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, spread

#: A task ranks about so many items of one length; a length with more of them is dealt over more tasks.
PART_ITEMS = 50_000
#: Up to so many parts, their offsets are broadcast.
MOST_BROADCAST = 200_000
#: Fixed value: the pre-split of a public tokenizer.
PRE_SPLIT = r"""'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
_PRE = re.compile(PRE_SPLIT)


def count_tokens(text: str) -> int:
    return sum(1 for _ in _PRE.finditer(text))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [count_tokens(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n"])


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, n: n_tokens, counted from the text where it is null or negative; a null text has no tokens."""
    ok = F.col("n_tokens") >= 0
    told = documents.filter(ok).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n"))
    untold = documents.filter(F.coalesce(~ok, F.lit(True))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return told.unionByName(spread(untold).mapInArrow(_counter, "doc_id long, n long"))


def plan_packs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(placements, number of packs). A placement (length, first rank, first pack, count) puts the items of a length from
    that rank on into consecutive packs, one each.

    Lengths are placed longest first. A run of packs with equal patterns is kept as one entry with its free space; each
    length goes to the packs with the most free space first, and into new packs where none has room.
    """
    free: list[tuple[int, int, int]] = []  # (-free space, first pack, count)
    placements: list[tuple[int, int, int, int]] = []
    packs = 0
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            if free and -free[0][0] >= length:
                space, first, count = heapq.heappop(free)
                n = min(left, count)
                if n < count:
                    heapq.heappush(free, (space, first + n, count - n))
                moved_space = -space - length
            else:
                # As many new packs as these items need by themselves; what is left then goes to their free space.
                first, n = packs, -(-left // (capacity // length))
                packs += n
                moved_space = capacity - length
            placements.append((length, rank, first, n))
            rank += n
            left -= n
            heapq.heappush(free, (-moved_space, first, n))
    return placements, packs


def _placer(keys: np.ndarray, packs: np.ndarray, plan_index: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plan = b.column("plan_id").to_numpy(zero_copy_only=False)
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            which = np.vectorize(plan_index.get, otypes=[np.int64])(plan) if len(plan) else np.zeros(0, np.int64)
            probe = np.empty(len(plan), dtype=keys.dtype)
            probe["plan"], probe["length"], probe["rank"] = which, length, rank
            at = np.searchsorted(keys, probe, side="right") - 1
            box = np.where(length > 0, packs[at] + rank - keys["rank"][at], 0) if len(keys) else np.zeros(len(plan), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("plan_id", "doc_id", "piece", "start", "length")), pa.array(box, pa.int64())], names=["plan_id", "doc_id", "piece", "start", "length", "container"])

    return run


def pack(sizes: DataFrame, plans: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """plan_id, container, doc_id, piece, start, length: each document (doc_id, n) in a container of each plan (plan_id, capacity).

    A document of more tokens than the capacity is cut into pieces of the capacity and a rest, start being the first
    token of a piece; all others are whole. One without tokens takes no room and is put into container 0. Plans with a
    null or no positive capacity pack nothing. Rows with equal doc_id are packed each for itself.

    Only the histogram of lengths, at most a row per length up to the capacity, comes to the driver; documents are
    joined to their packs by their rank among those of equal length.
    """
    sizes = cut(sizes.select("doc_id", "n"))  # the texts are read and counted once
    caps = {r["plan_id"]: int(r["capacity"]) for r in plans.filter("capacity > 0").select("plan_id", "capacity").distinct().collect()}
    each = F.array(*[F.struct(F.lit(p).cast("int").alias("plan_id"), F.lit(c).cast("long").alias("capacity")) for p, c in sorted(caps.items())]).cast("array<struct<plan_id:int,capacity:bigint>>")
    items = sizes.select("doc_id", "n", F.explode(each).alias("plan")).select("doc_id", "n", "plan.plan_id", "plan.capacity")
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / F.col("capacity")).cast("int"))
    items = items.select("plan_id", "doc_id", "n", "capacity", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    items = items.withColumn("start", F.col("piece") * F.col("capacity")).withColumn("length", F.least(F.col("capacity"), F.col("n") - F.col("start"))).select("plan_id", "doc_id", "piece", "start", "length")
    hists: dict[int, dict[int, int]] = {p: {} for p in caps}
    for r in items.groupBy("plan_id", "length").agg(F.count("*").alias("c")).collect():
        hists[r["plan_id"]][r["length"]] = r["c"]
    placed = [(p, *x) for p, cap in sorted(caps.items()) for x in plan_packs(hists[p], cap)[0]]
    # Lengths with more items than a task ranks; each is dealt by a hash over as many parts as that takes.
    hot = [(p, length, -(-c // part_items)) for p, h in hists.items() for length, c in h.items() if c > part_items]
    items = items.withColumn("part", F.lit(0))
    offsets = None
    if hot:
        # At most a row per length and plan.
        dealt = items.drop("part").join(F.broadcast(sizes.sparkSession.createDataFrame(hot, "plan_id int, length long, parts int")), ["plan_id", "length"], "left")
        items = dealt.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts"))).otherwise(0).cast("int")).drop("parts")
        sums = items.groupBy("plan_id", "length", "part").agg(F.count("*").alias("c"))
        offsets = sums.withColumn("offset", F.sum("c").over(Window.partitionBy("plan_id", "length").orderBy("part")) - F.col("c")).filter("offset > 0").drop("c")
        if sum(n for *_, n in hot) <= MOST_BROADCAST:
            offsets = F.broadcast(offsets)
    index = {p: i for i, p in enumerate(sorted(caps))}
    keys = np.array([(index[p], length, rank) for p, length, rank, _, _ in placed], dtype=[("plan", "i8"), ("length", "i8"), ("rank", "i8")])
    packs = np.array([first for *_, first, _ in placed], dtype=np.int64)
    order = np.argsort(keys, order=("plan", "length", "rank"))
    own = F.row_number().over(Window.partitionBy("plan_id", "length", "part").orderBy("doc_id", "piece", "start")) - 1
    ranked = items.withColumn("own", own)
    if offsets is not None:
        ranked = ranked.join(offsets, ["plan_id", "length", "part"], "left")
    ranked = ranked.withColumn("rank", (F.col("own") + (F.coalesce("offset", F.lit(0)) if offsets is not None else 0)).cast("long"))
    return ranked.select("plan_id", "doc_id", "piece", "start", "length", "rank").mapInArrow(_placer(keys[order], packs[order], index), "plan_id int, doc_id long, piece int, start long, length long, container long")


def usage(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """Containers, items, tokens and the share of unused space per plan."""
    per = packed.groupBy("plan_id").agg((F.max("container") + 1).alias("containers"), F.count("*").alias("items"), F.sum("length").alias("tokens"))
    caps = plans.select("plan_id", "capacity").distinct()
    return per.join(F.broadcast(caps), "plan_id").select("plan_id", "capacity", "containers", "items", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused"))
