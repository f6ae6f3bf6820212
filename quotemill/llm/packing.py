"""Filling containers of fixed capacity with texts of varying length.

Harmonic packing: a size in (capacity/(k+1), capacity/k] is of class k, and a container opened for class k takes
exactly k items of it (`fixed count`). What a container then has left is given to the largest waiting item of the
smaller classes that still fits. Each worker packs its own shard without looking at any other.

Sizes are tokens of the ByT5 tokenizer without its end mark: UTF-8 bytes, counted in the JVM; no text leaves it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.session import cut

CAPACITY = 4096
SHARD_ITEMS = 100_000


def harmonic_fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each size (1 <= size <= capacity), in order of the given items."""
    order = np.argsort(-sizes, kind="stable").tolist()
    counts = np.bincount(sizes, minlength=capacity + 1)
    begin = np.concatenate([np.cumsum(counts[::-1])[::-1][1:], [0]]).tolist()  # of each size: where its items stand in `order`
    waiting = counts.tolist()
    below = [s if waiting[s] else s - 1 for s in range(capacity + 1)]  # links towards the largest size at most s that has items
    below[0] = 0

    def largest(s: int) -> int:
        root = s
        while below[root] != root:
            root = below[root]
        while below[s] != root:
            below[s], s = root, below[s]
        return root

    out = np.empty(len(sizes), dtype=np.int64)
    container = -1

    def put(s: int) -> None:
        out[order[begin[s]]] = container
        begin[s] += 1
        waiting[s] -= 1
        if not waiting[s]:
            below[s] = s - 1

    while top := largest(capacity):
        k = capacity // top
        low = capacity // (k + 1)  # sizes over this are of class k
        while (s := largest(capacity)) > low:
            container += 1
            free = capacity
            for _ in range(k):  # the fixed count of the class
                put(s)
                free -= s
                s = largest(capacity)
                if s <= low:
                    break
            while free and (s := largest(min(free, low))):  # smaller classes fill what is left
                put(s)
                free -= s
    return out


def _packed(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
    sizes = pdf["size"].to_numpy(dtype=np.int64)
    pdf["container"] = harmonic_fill(sizes, capacity)
    return pdf[["shard", "container", "id", "piece", "pieces", "size"]]


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(`shard`, `container`, id, `piece`, `pieces`, `size`): the container, named by shard and number, of every piece.

    An item is split only if its size exceeds the capacity, into full pieces and one rest. Items of null or zero size
    need no room and have no row. Rows that repeat an id, or have none, are packed each. Only ids and sizes are read,
    once; a shard has about `shard_items` pieces.
    """
    pieces = F.ceil(F.col("size") / F.lit(float(capacity))).cast("long")
    kind = items.schema[id_col].dataType
    # as text, since numbers with nulls among them would become floats on the way
    sized = cut(items.select(F.col(id_col).cast("string").alias("id"), F.col(size_col).cast("long").alias("size")).where("size > 0").withColumn("pieces", pieces))
    n = sized.agg(F.sum("pieces")).first()[0] or 0
    shards = max(1, -(-n // shard_items))
    each = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    each = each.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity)).withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    packed = each.groupBy("shard").applyInPandas(lambda pdf: _packed(pdf, capacity), "shard long, container long, id string, piece long, pieces long, size long")
    return packed.select("shard", "container", F.col("id").cast(kind).alias(id_col), "piece", "pieces", "size")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs the texts of `documents` by their bytes. A null or empty text needs no room."""
    return pack(documents.select("doc_id", F.octet_length("text").alias("size")), "doc_id", "size", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, their lower bound of containers, and the share of the containers that is used."""
    by = packed.groupBy("shard", "container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    return by.agg(
        F.count("*").alias("containers"), F.sum("items").alias("pieces"), F.sum("used").alias("tokens"),
        F.ceil(F.sum("used") / capacity).cast("long").alias("least_containers"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"), F.max("used").alias("fullest"),
    )


def room(packed: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens and pieces packed, whether every container holds at most its capacity (`fits`), and whether every item has all its pieces, full but for the last (`whole`)."""
    full = packed.groupBy("shard", "container").agg(F.sum("size").alias("used")).select((F.col("used") <= capacity).alias("fits"))
    own = packed.groupBy(id_col).agg(F.count("*").alias("here"), F.max("pieces").alias("pieces"), F.sum("size").alias("tokens"), F.countDistinct("piece").alias("kinds"))
    whole = (F.col("here") == F.col("pieces")) & (F.col("kinds") == F.col("pieces")) & (F.ceil(F.col("tokens") / capacity) == F.col("pieces"))
    both = full.unionByName(own.select("tokens", "pieces", whole.alias("whole")), allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "pieces")]
    return both.agg(F.count("tokens").alias("items"), *sums, *[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in ("fits", "whole")])
