"""Filling fixed-capacity containers with items of varying length.

Documents lie in pools, as many as their number asks for, and best-fit decreasing runs within each. Dual-feasible functions
give a lower bound of a pool's bin count: a pool that reaches its bound is certified. Pools with a gap release their emptier
bins; these documents are exchanged by joining pools, and best-fit decreasing runs again, until all bins together are within
a stated share of the bound for all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Documents of the byte tokenizer: one token a UTF-8 byte and one end token.
END_TOKENS = 1


def byte_tokens(text: Column) -> Column:
    """Size of a text in tokens of the public byte tokenizer; null for a null or empty text."""
    return F.when(F.octet_length(text) > 0, F.octet_length(text).cast("long") + F.lit(END_TOKENS))


#: Pieces of a pool, pools that one of the next round takes, and the share over the bound at which the exchange ends.
POOL_ITEMS, JOINED, TOLERANCE = 50_000, 16, 0.001


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The largest bound that the dual-feasible functions of the family f_e and u_k give for the number of bins.

    f_e: items above capacity - e count as full, those below e as nothing, the rest as themselves. u_k: x (k + 1) / capacity
    rounded down, by k, unless it is whole. `counts` says how often each size occurs (once if left out).
    """
    if not len(sizes):
        return 0
    order = np.argsort(sizes, kind="stable")
    x = sizes[order].astype("i8")
    n = np.ones(len(x), "i8") if counts is None else counts[order].astype("i8")
    total, number = np.concatenate([[0], np.cumsum(x * n)]), np.concatenate([[0], np.cumsum(n)])
    e = np.concatenate([[0], np.unique(x[x <= capacity // 2])])
    low, high = np.searchsorted(x, e, "left"), np.searchsorted(x, capacity - e, "right")
    best = int(np.max((number[-1] - number[high]) * capacity + total[high] - total[np.minimum(low, high)]))
    bound = -(-best // capacity)
    for k in range(1, 16):
        scaled = x * (k + 1)
        whole = scaled % capacity == 0
        u = np.where(whole, x * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        bound = max(bound, -(-int((u * n).sum()) // (k * capacity)))
    return bound


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and where in the bin it starts. Free levels are bits of one integer, so the tightest bin is its lowest set bit."""
    order = np.argsort(-sizes, kind="stable")
    bins, starts = np.empty(len(sizes), "i8"), np.empty(len(sizes), "i8")
    by_free: dict[int, list[int]] = {}
    levels, n = 0, 0
    for i in order.tolist():
        size = int(sizes[i])
        above = levels >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                levels &= ~(1 << free)
        else:
            b, free, n = n, capacity, n + 1
        bins[i], starts[i] = b, capacity - free
        left = free - size
        if left:
            by_free.setdefault(left, []).append(b)
            levels |= 1 << left
    return bins, starts


_PACKED = "doc_id bigint, part int, tokens bigint, oversized boolean, bin_id bigint, bin_start bigint, released boolean"


def _packer(capacity: int, round_no: int, last: bool):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        items = pd.concat(frames, ignore_index=True)
        for pool, part in items.sort_values(["pool", "doc_id", "part"]).groupby("pool", sort=False):
            sizes = part.tokens.to_numpy("i8")
            bins, starts = best_fit_decreasing(sizes, capacity)
            n, bound = int(bins.max()) + 1, lower_bound(sizes, capacity)
            released = np.zeros(len(part), bool)
            if n > bound and not last:
                fill = np.bincount(bins, sizes, n)
                # The emptiest bins go, as many as hold four times the unused space that the gap stands for, and at least two.
                emptiest = np.argsort(fill, kind="stable")
                space = np.cumsum(capacity - fill[emptiest])
                released = np.isin(bins, emptiest[: max(2, int(np.searchsorted(space, 4 * (n - bound + 1) * capacity)) + 1)])
            yield pd.DataFrame(
                {"doc_id": part.doc_id.to_numpy(), "part": part["part"].to_numpy("i4"), "tokens": sizes, "oversized": part.oversized.to_numpy(bool), "bin_id": (np.int64(round_no) << 58) + (np.int64(pool) << 24) + bins, "bin_start": starts, "released": released}
            )

    return pack


def _pieces(docs: DataFrame, doc_id: str, size: Column, capacity: int) -> DataFrame:
    """(doc_id, part, tokens, oversized): the documents, those above the capacity in parts of which only the last has room left."""
    sized = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), size.cast("long").alias("size")).where((F.col("size") > 0) & F.col("doc_id").isNotNull())
    sized = sized.groupBy("doc_id").agg(F.max("size").alias("size"))
    parts = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int"))).alias("part"))
    return parts.select("doc_id", "part", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("part") * F.lit(capacity)).alias("tokens"), (F.col("size") > capacity).alias("oversized"))


def global_bound(pieces: DataFrame, capacity: int) -> tuple[int, int]:
    """How many pieces there are, and the bound for all of them. The driver sees how often each size occurs, at most `capacity` rows."""
    sizes = pieces.groupBy("tokens").agg(F.count("*").alias("n")).toPandas()
    return int(sizes.n.sum()), lower_bound(sizes.tokens.to_numpy("i8"), capacity, sizes.n.to_numpy("i8"))


def pack_documents(docs: DataFrame, doc_id: str, size: Column, capacity: int = 4096, pool_items: int = POOL_ITEMS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, part, tokens, oversized, bin_id, bin_start): each document in one bin, or split if it exceeds the capacity.

    A document above the capacity fills bins of its own and its rest is an item like others. Documents without a size (null,
    0 or less) or id are in no bin; rows that repeat an id count once (the largest size). Ties in size go by document id.
    The number of pools follows from the number of pieces, so neither a task's input nor the result depends on the session's
    settings. Bins are exchanged over ever fewer pools until the bins are at most the share `tolerance` above the bound for
    all pieces, or one pool is left; a pool holds only what its pools released.
    """
    pieces = cut_lineage(_pieces(docs, doc_id, size, capacity))
    n, bound = global_bound(pieces, capacity)
    pools, kept, fixed, waiting, r = max(1, -(-n // pool_items)), [], 0, pieces, 0
    while True:
        placed = waiting.withColumn("pool", F.pmod(F.xxhash64("doc_id", F.lit(r)), F.lit(pools)).cast("long"))
        packed = placed.repartition(pools, "pool").mapInPandas(_packer(capacity, r, pools == 1), _PACKED)
        if pools == 1:
            kept.append(packed)
            break
        packed = cut_lineage(packed)
        open_bins = packed.groupBy("released").agg(F.countDistinct("bin_id").alias("n")).toPandas().set_index("released").n
        if fixed + open_bins.sum() <= bound * (1 + tolerance):
            kept.append(packed)
            break
        fixed += open_bins.get(False, 0)
        kept.append(packed.where(~F.col("released")))
        waiting = packed.where("released").select("doc_id", "part", "tokens", "oversized")
        pools, r = -(-pools // JOINED), r + 1
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return out.drop("released")


def packing_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: documents, pieces, tokens, bins, the bound that no packing can beat, the share of room used, the least and the most filled bin."""
    per_bin = packed.groupBy("bin_id").agg(F.sum("tokens").alias("fill"), F.count("*").alias("pieces"), F.count_if(F.col("part") == 0).alias("documents"))
    _, bound = global_bound(packed, capacity)
    return per_bin.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"), F.count("*").alias("bins"), F.lit(bound).cast("long").alias("bound"),
        (F.sum("fill") / (F.count("*") * capacity)).alias("used"), F.min("fill").alias("least_fill"), F.max("fill").alias("most_fill"),
    )


def found_oversized(documents: DataFrame, capacity: int = 4096) -> DataFrame:
    """p6_found: the documents of which the packing holds more than one part."""
    return pack_documents(documents, "doc_id", byte_tokens(F.col("text")), capacity).where("part > 0").select("doc_id").distinct()
