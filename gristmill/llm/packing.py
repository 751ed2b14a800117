"""Texts put into containers of fixed capacity by sum-of-squares packing.

Each item goes, as it comes, to the fill level that makes the sum of squared counts of partly filled containers least: a level array
counts the open containers of every fill, and placing an item of size s into one of fill h turns that container's level h into h + s. Levels
that many containers share are thus avoided, and fills of all sizes are kept at hand. Only whole items are placed; an item longer than a
container fills containers of its own, and its rest is an item like any other.

Items are spread over shards of bounded size by the hash of their id, and a shard is packed in one task. Containers that a shard leaves
partly filled are joined two by two at its end, where two of them fit together.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .tokens import VOCABULARY, sized

#: Items of one shard, about: what one task holds.
SHARD_ITEMS = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(container, start within it) of each item of 1..capacity, and how many containers there are. Items keep their order of arrival."""
    levels = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, start = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    n = 0
    for k, s in enumerate(sizes.tolist()):
        # Change of the sum of squares for each fill h: level h loses one, level h + s gains one; a full container counts no more.
        room = capacity - s
        gain = 2 * levels[s : capacity + 1] + 1
        gain[room] = 0
        change = gain - 2 * levels[: room + 1] + 1
        change[0] = gain[0]
        change[1:][levels[1 : room + 1] == 0] = np.iinfo(np.int64).max
        # Ties go to the fuller container.
        h = room - int(np.argmin(change[::-1]))
        if h == 0:
            bin_, n = n, n + 1
        else:
            levels[h] -= 1
            bin_ = open_[h].pop()
        place[k], start[k] = bin_, h
        if h + s < capacity:
            levels[h + s] += 1
            open_[h + s].append(bin_)
    return place, start, n


def join_leftovers(place: np.ndarray, start: np.ndarray, sizes: np.ndarray, n: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Partly filled containers put together while two fit into one, the fullest first with the fullest that fits."""
    fills = np.bincount(place, sizes, minlength=n).astype(np.int64)
    order = [(int(f), b) for b, f in enumerate(fills) if f < capacity]
    order.sort()
    into, shift = np.arange(n), np.zeros(n, np.int64)
    base = fills.copy()
    while len(order) > 1:
        f, b = order.pop()
        k = bisect.bisect_right(order, (capacity - f, n)) - 1
        if k < 0:
            continue
        g, c = order.pop(k)
        into[c], shift[c] = b, base[b]
        base[b] = f + g
        if base[b] < capacity:
            bisect.insort(order, (int(base[b]), b))
    # A container that was joined may itself have taken others: follow the chain.
    root, move = into.copy(), shift.copy()
    while (root != into[root]).any():
        on = root != into[root]
        move[on] += shift[root[on]]
        root[on] = into[root[on]]
    return root[place], start + move[place]


def pack(sized_items: DataFrame, pack_sizes: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """`container, capacity_tokens, container_no, doc_id, piece, first_token, start_token, n_tokens`, one row per piece.

    `sized_items(doc_id, n_tokens)`; every text is packed once into containers of each capacity. container_no is unique within a
    container kind; start_token is the place within the container, first_token the piece's place within its text (0 unless the text
    is longer than the capacity). Texts without tokens take no room and give no row. A repeated doc_id is one text; NULL capacities
    and those below one are ignored. The result depends on the ids and sizes only, not on partitions or order of rows.
    """
    items = cut(sized_items.where("n_tokens > 0").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")))
    shards = max(1, -(-items.count() // shard_items))
    # One row per kind of container, whatever the number of texts.
    kinds = sorted({(r["container"], int(r["capacity_tokens"])) for r in pack_sizes.where("container is not null and capacity_tokens >= 1").collect()})
    each = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("long").alias("capacity_tokens")) for c, n in kinds]).cast("array<struct<container:string,capacity_tokens:bigint>>")
    spread = items.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.explode(each).alias("k")).select("doc_id", "n_tokens", "shard", "k.*")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        container, capacity, shard = key
        capacity = int(capacity)
        rows = rows.assign(h=pd.util.hash_array(rows["doc_id"].to_numpy())).sort_values(["h", "doc_id"])
        n, ids = rows["n_tokens"].to_numpy(np.int64), rows["doc_id"].to_numpy()
        whole = n // capacity
        rest = n - whole * capacity
        has = rest > 0
        place, start, used = sum_of_squares(rest[has], capacity)
        if used:
            place, start = join_leftovers(place, start, rest[has], used, capacity)
            place = np.unique(place, return_inverse=True)[1]
            used = int(place.max()) + 1
        full_of = np.repeat(np.arange(len(n)), whole)
        piece = np.arange(len(full_of)) - np.repeat(np.cumsum(whole) - whole, whole)
        return pd.DataFrame(
            {
                "container": container,
                "capacity_tokens": capacity,
                "container_no": (np.concatenate([used + np.arange(len(full_of)), place]) * shards + shard).astype(np.int64),
                "doc_id": np.concatenate([ids[full_of], ids[has]]),
                "piece": np.concatenate([piece, whole[has]]).astype(np.int64),
                "first_token": np.concatenate([piece * capacity, whole[has] * capacity]).astype(np.int64),
                "start_token": np.concatenate([np.zeros(len(full_of), np.int64), start]),
                "n_tokens": np.concatenate([np.full(len(full_of), capacity), rest[has]]).astype(np.int64),
            }
        )

    kind = dict(items.dtypes)["doc_id"]
    schema = f"container string, capacity_tokens bigint, container_no bigint, doc_id {kind}, piece bigint, first_token bigint, start_token bigint, n_tokens bigint"
    return spread.groupBy("container", "capacity_tokens", "shard").applyInPandas(one, schema)


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The packing of whole texts, measured in tokens of the vocabulary."""
    return pack(sized(documents, vocabulary=vocabulary), pack_sizes, shard_items)


def fill_report(packed: DataFrame) -> DataFrame:
    """`container, capacity_tokens, containers, texts, tokens, unused_share` of a packing."""
    return (
        packed.groupBy("container", "capacity_tokens", "container_no")
        .agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("pieces"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("texts"))
        .groupBy("container", "capacity_tokens")
        .agg(F.count("*").alias("containers"), F.sum("texts").alias("texts"), F.sum("fill").alias("tokens"))
        .withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )
