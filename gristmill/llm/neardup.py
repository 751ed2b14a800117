"""Near-duplicate listings by b-bit MinHash.

One pass signs each text: b-bit cells are the low bits of its minima under fixed hash functions, packed into words, and estimate
similarity; band keys for candidates are made of whole minima over all runs of words, so that no run is too common to bring two texts
together. Every two classes that share a bucket are compared, in a bucket of any size: large ones are cut into blocks, and each two
blocks meet in a group of bounded size. Bands are gone through in rounds, so that the disk holds a part of their keys at a time. Pairs are compared where they meet, by counting equal cells, corrected for the 2^-b that agree
by chance; pairs too close to the limit for the estimate are verified on their shingles.

Texts with the same shingles are one class, which enters the bands once: a group of copies of any size adds one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import BROADCAST_ROWS, broadcast_if_small, cut
from .shingles import MinHasher, distinct, mix, runs, word_hashes

def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def _class_of(h: np.ndarray) -> int:
    """One 64-bit name for the runs of a text, whatever their order."""
    return int((np.add.reduce(mix(h ^ np.uint64(len(h))), dtype=np.uint64)).astype(np.int64))


def signatures(texts: DataFrame, width: int, bands: int, rows: int, cells: int, bits: int) -> DataFrame:
    """`key, class, cells, bands`. Texts without a run of `width` words share none with any text and are dropped.

    Only the first text of a class that a task meets carries a signature, so that a class has as many as there are tasks at most.
    """
    per_word = 64 // bits
    assert 64 % bits == 0 and cells % per_word == 0

    def keys(m: np.ndarray) -> np.ndarray:
        k = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in m.reshape(bands, -1).T:
            k = (k ^ column) * np.uint64(0x100000001B3)
        return mix(k)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Other functions for the bands than for the cells: that two texts meet tells nothing of the cells they are compared by.
        whole, banded = MinHasher(cells), MinHasher(bands * rows, seed=11)
        shifts = (np.arange(per_word, dtype=np.uint64) * np.uint64(bits))[None, :]
        low = np.uint64((1 << bits) - 1)
        seen: set[int] = set()
        for b in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            out: dict[str, list] = {"key": [], "class": [], "cells": [], "bands": []}
            for key, ids in zip(b["key"], word_hashes(b["text"])):
                h = runs(ids, width)
                if not len(h):
                    continue
                name = _class_of(h)
                out["key"].append(key)
                out["class"].append(name)
                if name in seen:
                    # A copy adds nothing to the class, which this task has signed already.
                    for k in ("cells", "bands"):
                        out[k].append(None)
                    continue
                seen.add(name)
                out["cells"].append(_signed(np.bitwise_or.reduce((whole(h).astype(np.uint64) & low).reshape(-1, per_word) << shifts, axis=1)))
                out["bands"].append(_signed(keys(banded(h).astype(np.uint64))))
            yield pd.DataFrame({k: pd.Series(v, dtype=object if k != "class" else "int64") for k, v in out.items()})

    kind = dict(texts.dtypes)["key"]
    return texts.select("key", "text").mapInPandas(sign, f"key {kind}, class bigint, cells array<bigint>, bands array<bigint>")


def equal_cells(a: Column, b: Column, bits: int) -> Column:
    """In how many of the b-bit cells two packed signatures agree."""

    def differing(w: Column) -> Column:
        step = 1
        while step < bits:
            w = w.bitwiseOR(F.shiftrightunsigned(w, step))
            step *= 2
        lowest = sum(1 << k for k in range(0, 64, bits))
        return F.bit_count(w.bitwiseAND(F.lit(lowest - (1 << 64) if lowest >= 1 << 63 else lowest)))

    x = F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    return F.lit(64 // bits) * F.size(a) - F.aggregate(x, F.lit(0), lambda acc, w: acc + differing(w))


#: A bucket is hot if so many of every RATE-th class, by hash, stand in it: some 500 classes and more.
RATE, HOT = 64, 8


def dealt_buckets(keyed: DataFrame, block: int) -> DataFrame:
    """`class, bucket, blocks, own`: the rows of `keyed(class, bucket)` that share their bucket with another, dealt into blocks of about `block` classes.

    Which buckets are hot is estimated from a sample of the classes; it decides only how the rows travel. A hot bucket's rows are dealt where they are, so
    that they never meet in one task; the rows of the others are counted bucket by bucket, which is small work as none of them is large.
    """
    sample = keyed.where(F.pmod(F.xxhash64("class"), F.lit(RATE)) == 0)
    hot = cut(sample.groupBy("bucket").agg(F.count_distinct("class").alias("n")).where(F.col("n") >= HOT).select("bucket", F.ceil(F.col("n") * RATE / F.lit(block)).cast("int").alias("blocks")))
    many, cold, warm = hot.count(), keyed, None
    if many:
        side = broadcast_if_small(hot, many)
        cold = keyed.join(side, "bucket", "left_anti")
        warm = keyed.join(side, "bucket").dropDuplicates(["bucket", "class"])
    # Partitioned by bucket already, the repetitions of a class go and the rest is counted without another shuffle.
    own = cold.repartition("bucket").dropDuplicates(["bucket", "class"])
    shared = own.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1").select("class", "bucket", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    every = shared if warm is None else shared.unionByName(warm.select("class", "bucket", "blocks"))
    return every.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))


def likely_pairs(classes: DataFrame, cells: int, bits: int, least: float, block: int, rounds: int = 6) -> DataFrame:
    """`a, b, s` (a < b): every two classes that share a band key and whose estimated similarity `s` is `least` or more.

    `classes(class, cells, bands)`; a class may be signed more than once and counts once. The classes of a bucket are dealt into blocks of
    about `block`, and each two blocks, and each block with itself, make a group that is compared by itself, so that a bucket of any size is compared
    in full and no group is large. Pairs that are not alike go no further than the task they meet in.

    The bands are taken in `rounds`, one after another: each goes over its own buckets and leaves only its pairs, so that the disk holds the keys and
    groups of one round at a time.
    """
    turn = lambda k: F.filter("bands", lambda _, i: i % rounds == k)
    found = [cut(_pairs_of_bands(classes.withColumn("bands", turn(k)), cells, bits, least, block)) for k in range(rounds)]
    return reduce(DataFrame.unionByName, found).dropDuplicates(["a", "b"])


def _pairs_of_bands(classes: DataFrame, cells: int, bits: int, least: float, block: int) -> DataFrame:
    """`likely_pairs` of the bands that `classes` holds."""
    dealt = dealt_buckets(classes.select("class", F.explode("bands").alias("bucket")), block)
    met = dealt.select("class", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    signed = classes.select("class", "cells").dropDuplicates(["class"])
    # One name for a bucket and two of its blocks; a block that meets itself is number -1.
    both = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    grouped = met.select("class", both.alias("met"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("own")).join(signed, "class")
    placed = grouped.repartition("met").sortWithinPartitions("met")
    per_word, chance = 64 // bits, 2.0**-bits
    kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64

    def unpacked(words: np.ndarray) -> np.ndarray:
        shifts = np.arange(per_word, dtype=np.uint64) * np.uint64(bits)
        return ((words.view(np.uint64)[:, :, None] >> shifts) & np.uint64((1 << bits) - 1)).astype(kind).reshape(len(words), -1)

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        """The pairs of whole groups, which stand one after another: each row is compared with the next, the next but one and so on."""
        name, own = g["class"].to_numpy(), g["own"].to_numpy()
        place = g["met"].to_numpy()
        group = np.cumsum(np.concatenate([[0], place[1:] != place[:-1]]))
        inner = own < 0
        c = unpacked(np.stack(g["cells"].to_list()))
        at, step, out = np.arange(len(g)), 0, []
        while len(at):
            step += 1
            at = at[at + step < len(g)]
            at = at[group[at] == group[at + step]]
            i = at[inner[at] | (own[at] != own[at + step])]
            for part in np.array_split(i, len(i) // 20_000 + 1):
                s = ((c[part] == c[part + step]).sum(axis=1) / cells - chance) / (1 - chance)
                near = s >= least
                x, y = name[part[near]], name[part[near] + step]
                out.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "s": s[near]}))
        return pd.concat(out).drop_duplicates(["a", "b"]) if out else pd.DataFrame({"a": [], "b": [], "s": []}).astype({"a": "int64", "b": "int64"})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            # The last group may go on in the next batch.
            last = (b["met"] == b["met"].iloc[-1]).to_numpy()
            rest = b[last]
            if not last.all():
                yield meet(b[~last])
        if rest is not None and len(rest):
            yield meet(rest)

    return placed.mapInPandas(compare, "a bigint, b bigint, s double").dropDuplicates(["a", "b"])


def similar_texts(texts: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 44, rows: int = 4, cells: int = 64, bits: int = 8, zone: float = 0.19, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(`members(key, class)`, `pairs(a, b)`): the class of each text, and the classes whose similarity reaches `threshold`.

    `texts(key, text)`. Similarity is that of the distinct runs of `width` words. Estimates within `zone` of the threshold, more than
    three standard errors, are settled on the shingles themselves.
    """
    signed = cut(signatures(texts, width, bands, rows, cells, bits))
    members = signed.select("key", "class").distinct()
    likely = cut(likely_pairs(signed.where("cells is not null"), cells, bits, threshold - zone, block))
    sure = likely.where(F.col("s") > threshold + zone).select("a", "b")
    unsure = likely.where(F.col("s") <= threshold + zone).select("a", "b")
    return members, sure.unionByName(verified(unsure, signed, texts, threshold, width))


def verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs of classes whose exact similarity reaches the threshold. Only texts of such classes are read into shingles."""
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    keys = cut(signed.select("key", "class").join(wanted, "class").groupBy("class").agg(F.min("key").alias("key")))

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [runs(ids, width) for ids in word_hashes(b["text"])]
            yield pd.DataFrame({"class": pd.Series([_class_of(x) if len(x) else 0 for x in h], dtype="int64"), "s": [_signed(distinct(x)) for x in h]})

    side = F.broadcast(keys.select("key")) if keys.count() <= BROADCAST_ROWS else keys.select("key")
    sets = cut(texts.select("key", "text").join(side, "key", "left_semi").mapInPandas(shingle, "class bigint, s array<bigint>").dropDuplicates(["class"]))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(sets.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b")
        .where(common / (F.size("sa") + F.size("sb") - common) >= threshold)
        .select("a", "b")
    )


def listing_texts(jobs: DataFrame) -> DataFrame:
    """`key, text` of the listings."""
    return jobs.select(F.col("id").alias("key"), F.col("description_text").alias("text")).where("key is not null and text is not null")


def pairs_of_listings(jobs: DataFrame, threshold: float = 0.5, width: int = 3, most_copies: int = 1000, **how) -> DataFrame:
    """`id_a, id_b` of different listings whose texts share enough runs of words; the smaller id first.

    A similar pair of classes stands for all pairs of their members, and copies within a class are pairs too; they are expanded
    by equi-joins on the class. A class of more than `most_copies` copies is given as a star instead: each member is paired with
    the class's least id, which alone is paired with other classes; no link between different texts is lost. NULL, empty and very
    short texts (fewer than `width` words) are similar to nothing. Repeated rows of an id are one listing; other columns play no
    part; an empty table gives no row.
    """
    members, pairs = similar_texts(listing_texts(jobs), threshold, width, **how)
    sizes = members.groupBy("class").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    of = cut(members.join(sizes, "class"))
    shown = of.where((F.col("n") <= most_copies) | (F.col("key") == F.col("first"))).select("class", "key")
    stars = of.where(F.col("n") > most_copies).select(F.col("first").alias("ka"), F.col("key").alias("kb"))
    one, two = shown.select(F.col("class").alias("a"), F.col("key").alias("ka")), shown.select(F.col("class").alias("b"), F.col("key").alias("kb"))
    across = pairs.join(one, "a").join(two, "b").select("ka", "kb")
    copies = of.where((F.col("n") > 1) & (F.col("n") <= most_copies)).select("class", "key")
    within = copies.select("class", F.col("key").alias("ka")).join(copies.select("class", F.col("key").alias("kb")), "class").where("ka < kb").select("ka", "kb")
    every = across.unionByName(within).unionByName(stars).where("ka != kb")
    return every.select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b")).distinct()


def group_listings(jobs: DataFrame, threshold: float = 0.5, width: int = 3, **how) -> DataFrame:
    """`id, group_id, class_id, links`: one row per listing with text, its class of equal texts and its group over any chain of links.

    `links` counts the similar classes of other texts. A listing whose text is too short for a run forms a class and group of its own;
    its ids are NULL, since it has no shingles to name them by.
    """
    from .graph import components

    texts = listing_texts(jobs)
    members, pairs = similar_texts(texts, threshold, width, **how)
    pairs = cut(pairs)
    roots = components(pairs)
    links = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    of = texts.select("key").distinct().join(members, "key", "left")
    return (
        of.join(roots.withColumnRenamed("node", "class"), "class", "left")
        .join(links, "class", "left")
        .select(F.col("key").alias("id"), F.coalesce("component", "class").alias("group_id"), F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
