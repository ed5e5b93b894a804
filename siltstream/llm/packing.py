"""Filling containers of fixed capacity with items, by harmonic packing.

An item of class k is longer than a (k+1)-th and at most a k-th of the capacity, so k of its
class fill a bin: bins of a class need no search, only counting, and workers fill them
independently. Items are dealt to workers by hash in blocks of bounded size. Inside a block the
longest items (class 1) open a bin each; the space they leave is filled with the shorter items
that fit (largest first, into the fullest bin that has room), and what remains is packed
harmonically class by class, the space left in those bins again filled by shorter items.

``harmonic`` is the plain form: classes are filled independently of each other and nothing else
goes into their bins. It needs no Python, but leaves a good part of the room empty (the report
of both is a query), so ``pack_documents`` refills.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item; sizes are 1 .. capacity."""
    order = np.argsort(-sizes, kind="stable")
    of = np.full(len(sizes), -1, np.int64)
    waiting: dict[int, list[int]] = defaultdict(list)  # by size: items not yet in a bin
    for i in order:
        waiting[int(sizes[i])].append(int(i))
    lengths = np.array(sorted(waiting), np.int64)
    left = np.array([len(waiting[int(s)]) for s in lengths], np.int64)
    # next shorter length that still has items: a union-find over positions
    below = np.arange(len(lengths) + 1)

    def find(p: int) -> int:
        while below[p] != p:
            below[p] = below[below[p]]
            p = below[p]
        return p

    def longest(room: int) -> int:
        """Position of the longest length that has items and is at most room; -1 if none. Positions are shifted by one in ``below``."""
        return find(int(np.searchsorted(lengths, room, side="right"))) - 1

    def take(p: int) -> int:
        s = int(lengths[p])
        left[p] -= 1
        if not left[p]:
            below[p + 1] = p
        return waiting[s].pop()

    bins = 0
    while (p := longest(capacity)) >= 0:
        # a new bin of the class of the longest item left: a fixed number of its class, then what still fits
        k = capacity // int(lengths[p])
        least = capacity // (k + 1)
        room = capacity
        for _ in range(k):
            q = longest(min(room, int(lengths[p])))
            if q < 0 or lengths[q] <= least:
                break
            room -= int(lengths[q])
            of[take(q)] = bins
        while room > 0 and (q := longest(room)) >= 0:
            room -= int(lengths[q])
            of[take(q)] = bins
        bins += 1
    return of


def _packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    capacity, block = (int(x) for x in key)
    pdf = pdf.sort_values(["doc_id", "part"], kind="stable")
    of = pack(pdf["size"].to_numpy(np.int64), capacity)
    return pdf.assign(bin=of)[["capacity", "block", "bin", "doc_id", "part", "start", "size"]]


def _items(sized: DataFrame, capacities: DataFrame, block_items: int) -> tuple[DataFrame, DataFrame]:
    """What needs no packing (full packs of split documents, documents without room) as result rows, and the items to be packed: capacity, block, doc_id, part, start, size."""
    caps = capacities.select(F.col("capacity_tokens").cast("long").alias("capacity")).filter("capacity >= 1").distinct()
    docs = sized.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    n_blocks = max(1, -(-docs.count() // block_items))
    items = docs.crossJoin(F.broadcast(caps))  # a few sizes
    rest = items.withColumn("full", F.floor(F.col("n") / F.col("capacity"))).withColumn("rest", F.col("n") % F.col("capacity"))
    big = rest.filter("full > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    name = F.concat_ws("-", F.lit("full"), F.col("row"), F.col("part"))
    out_big = big.select(F.col("capacity").alias("capacity_tokens"), name.alias("pack_key"), "doc_id", F.col("part").cast("int"), (F.col("part") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    none = rest.filter("n = 0").select(F.col("capacity").alias("capacity_tokens"), F.lit(None).cast("string").alias("pack_key"), "doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"))
    small = rest.filter("rest > 0").select(
        "capacity", F.pmod(F.xxhash64("doc_id", "row"), F.lit(n_blocks)).alias("block"), "doc_id", F.col("full").cast("int").alias("part"), (F.col("full") * F.col("capacity")).alias("start"), F.col("rest").alias("size"))
    return out_big.union(none), small


_NAMES = ("capacity_tokens", "pack_key", "doc_id", "part", "start_token", "n_tokens")


def harmonic(sized: DataFrame, capacities: DataFrame, block_items: int = 100_000) -> DataFrame:
    """Plain harmonic packing, with the columns and cases of ``pack_documents``.

    Items of class k (longer than a (k+1)-th, at most a k-th of the capacity) fill bins by k,
    each class and block on its own; only the last bin of each holds fewer.
    """
    done, small = _items(sized, capacities, block_items)
    k = F.floor(F.col("capacity") / F.col("size"))
    w = Window.partitionBy("capacity", "k", "block").orderBy("doc_id", "part", "start", "size")
    bin_ = F.floor((F.row_number().over(w) - 1) / F.col("k"))
    out = small.withColumn("k", k).withColumn("bin", bin_)
    return done.union(out.select("capacity", F.concat_ws("-", "k", "block", "bin"), "doc_id", "part", "start", "size").toDF(*_NAMES))


def pack_documents(sized: DataFrame, capacities: DataFrame, block_items: int = 100_000) -> DataFrame:
    """Assign every document to packs of each capacity: capacity_tokens, pack_key, doc_id, part, start_token, n_tokens.

    ``sized``: doc_id, n_tokens; ``capacities``: capacity_tokens (a fixed list of a few sizes;
    nulls and sizes below 1 are ignored). A pack is named ``<block>-<bin>``. A document larger
    than a pack is split into full packs (part 0, 1, ..) and a rest that is packed like any
    other; no other document is split. Documents of 0 or null tokens take no room: they get a row
    with no pack (null pack_key). Repeated doc_ids are different items. Empty tables give an empty result.

    The items of a block are at most about ``block_items``; the number of blocks follows from a
    count. Each block leaves at most its last few bins partly filled.
    """
    done, small = _items(sized, capacities, block_items)
    schema = f"capacity long, block long, bin long, doc_id {dict(sized.dtypes)['doc_id']}, part int, start long, size long"
    packed = small.groupBy("capacity", "block").applyInPandas(_packed, schema)
    packed = packed.select(F.col("capacity").alias("capacity_tokens"), F.concat_ws("-", "block", "bin").alias("pack_key"), "doc_id", "part", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))
    return done.union(packed)


def pack_report(packed: DataFrame) -> DataFrame:
    """One row for each capacity: packs, items, split documents, tokens, and the share of room that is filled."""
    bins = packed.filter("pack_key is not null").groupBy("capacity_tokens", "pack_key").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return bins.groupBy("capacity_tokens").agg(
        F.count("*").alias("packs"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * F.col("capacity_tokens"))).alias("filled_share"))
