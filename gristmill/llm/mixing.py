"""Records of several sources mixed to target shares of all tokens.

The size of the mix is the largest that no source's cap of repetitions forbids. A source's records, in the order of a seeded hash, are
cut into blocks; a source contributes whole passes over its blocks and one partial pass that ends within a block, on the record that
comes closest to its quota. How many blocks of each source an output shard gets is drawn by a splitting tree: the root's quotas are split
between the two halves of the shards by a multivariate hypergeometric draw, and so on down to the single shard, so that the quotas add up
exactly at every node. Each source's blocks, permuted, are then dealt out in runs of these lengths, and every shard is shuffled by itself.

The driver sees block totals only: a fixed number per source of the target table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .tokens import VOCABULARY, sized

#: Blocks a source is cut into, parts a block is cut into where a pass ends within it, and records of an output shard, about.
BLOCKS, PARTS, SHARD_RECORDS = 1024, 1024, 20_000


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: the root's block quotas split by a tree of multivariate hypergeometric draws.

    A node with n blocks over k shards gives its left child its exact part of n, and draws which sources' blocks these are; so all
    shards get the same number of blocks, but for one, and each source's blocks add up to its quota.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def go(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left_size = int(q.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, left_size, method="marginals") if q.sum() else q
        go(lo, mid, left)
        go(mid, hi, q - left)

    go(0, shards, np.asarray(quotas, np.int64))
    return out


def mix_size(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """Tokens of the largest mix: each source gives its share and repeats its records `max_repeats` times at most.

    A source without tokens can give nothing; it is left out, and the others keep their proportions.
    """
    usable = {s: t for s, t in targets.items() if tokens.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    whole = sum(t[0] for t in usable.values())
    return min((tokens[s] * t[1] / (t[0] / whole) for s, t in usable.items()), default=0.0)


def mix(sized_docs: DataFrame, mix_targets: DataFrame, seed: int = 17, blocks: int = BLOCKS, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """`shard, position, source, doc_id, copy, n_tokens`: the mix, one row per use of a record.

    `sized_docs(doc_id, source, n_tokens)`. copy counts a record's uses from 1 and never exceeds the source's max_repeats. Records
    without tokens, without a source or of a source without a target are left out; a repeated doc_id is one record. An empty table, or
    targets without a usable source, give no row. The same input and seed give the same mix whatever the partitions.
    """
    spark = sized_docs.sparkSession
    # One row per source in this table, whose size does not grow with the records.
    targets = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in mix_targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()}
    # A uniform number in [0, 1) decides a record's block and its place within it.
    place = F.xxhash64("doc_id", F.lit(seed))
    unit = (F.shiftrightunsigned(place, 11).cast("double")) / F.lit(float(1 << 53))
    docs = cut(
        sized_docs.where((F.col("n_tokens") > 0) & F.col("source").isin(*targets))
        .groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))
        .withColumn("u", unit)
        .withColumn("block", F.floor(F.col("u") * blocks).cast("int"))
    )
    # At most `blocks` rows per target source: a fixed bound.
    totals = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).orderBy("source", "block").collect()
    empty = "shard int, position bigint, source string, doc_id bigint, copy int, n_tokens bigint"
    if not totals:
        return spark.createDataFrame([], empty)
    by: dict[str, list] = {}
    for r in totals:
        by.setdefault(r["source"], []).append(r)
    tokens = {s: sum(r["tokens"] for r in rows) for s, rows in by.items()}
    size = mix_size(tokens, targets)
    whole = sum(targets[s][0] for s in by)
    uses: list[tuple[str, int, int]] = []  # source, block, copy
    partial: list[tuple[str, int, int, int]] = []  # source, block, copy, tokens still wanted of it
    records = 0
    for s in sorted(by):
        quota = size * targets[s][0] / whole
        passes = min(int(quota // tokens[s]), targets[s][1])
        left = quota - passes * tokens[s]
        for copy in range(1, passes + 1):
            uses += [(s, r["block"], copy) for r in by[s]]
            records += sum(r["n"] for r in by[s])
        if passes < targets[s][1]:
            for r in by[s]:
                if left >= r["tokens"]:
                    uses.append((s, r["block"], passes + 1))
                elif left > 0.5:
                    partial.append((s, r["block"], passes + 1, int(round(left))))
                    uses.append((s, r["block"], passes + 1))
                left -= r["tokens"]
                records += r["n"]
                if left <= 0:
                    break
    sources = sorted(by)
    shards = max(1, min(len(uses), -(-records // shard_records)))
    quotas = np.array([sum(1 for u in uses if u[0] == s) for s in sources])
    table = split_quotas(quotas, shards, seed)
    dealt: list[tuple[str, int, int, int]] = []
    for k, s in enumerate(sources):
        mine = [u for u in uses if u[0] == s]
        order = np.random.default_rng([seed, k]).permutation(len(mine))
        shard_of = np.repeat(np.arange(shards), table[:, k])
        dealt += [(s, mine[i][1], mine[i][2], int(shard_of[j])) for j, i in enumerate(order)]
    # Rows: blocks x repetitions x sources, a fixed bound, so broadcast.
    # A shard of blocks that holds too many records is split by hash, into numbers of its own.
    sizes = {(s, r["block"]): r["n"] for s in by for r in by[s]}
    held = np.zeros(shards, np.int64)
    for s, block, _, k in dealt:
        held[k] += sizes[s, block]
    split = np.maximum(1, -(-held // shard_records))
    first = np.cumsum(split) - split
    plan = F.broadcast(spark.createDataFrame([(*d, int(first[d[3]]), int(split[d[3]])) for d in dealt], "source string, block int, copy int, shard int, first int, split int"))
    used = docs.join(plan, ["source", "block"])
    if partial:
        ends = F.broadcast(spark.createDataFrame([x[:3] for x in partial], "source string, block int, copy int"))
        part = F.least(F.floor((F.col("u") * blocks - F.col("block")) * PARTS), F.lit(PARTS - 1)).cast("int")
        cut_blocks = used.join(ends, ["source", "block", "copy"]).withColumn("part", part)
        # At most PARTS rows for each source with a cut block; the pass ends within one of them.
        sums = cut_blocks.groupBy("source", "block", "copy", "part").agg(F.sum("n_tokens").alias("tokens")).orderBy("part").collect()
        edges = []
        for s, block, copy, want in partial:
            edge, rest = PARTS, want
            for r in [r for r in sums if (r["source"], r["block"], r["copy"]) == (s, block, copy)]:
                if r["tokens"] > rest:
                    edge = r["part"]
                    break
                rest -= r["tokens"]
            edges.append((s, block, copy, edge, rest))
        at = cut_blocks.join(F.broadcast(spark.createDataFrame(edges, "source string, block int, copy int, edge int, rest bigint")), ["source", "block", "copy"])
        # Of that part the records in order, as long as they do not overshoot by more than half of the last.
        w = Window.partitionBy("source", "block", "copy").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        last = at.where("part = edge").withColumn("upto", F.sum("n_tokens").over(w)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"))
        kept = at.where("part < edge").select(*used.columns).unionByName(last.select(*used.columns))
        used = used.join(ends, ["source", "block", "copy"], "left_anti").select(*used.columns).unionByName(kept)
    used = used.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed + 2)), F.col("split")).cast("int"))
    # A shard holds a bounded number of records: its order is its own affair.
    local = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(seed + 1)), "doc_id", "copy")
    return used.select("shard", (F.row_number().over(local) - 1).cast("long").alias("position"), "source", "doc_id", "copy", "n_tokens")


def mix_documents(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 17) -> DataFrame:
    """The mix of whole texts, measured in tokens of the vocabulary."""
    return mix(sized(documents, keep=("source",), vocabulary=vocabulary), mix_targets, seed)


def share_report(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """`source, target_share, actual_share, tokens, records, most_copies` of each target source; zeros for one that gives nothing."""
    by = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), F.max("copy").alias("most_copies"))
    joined = mix_targets.select("source", "target_share").join(by, "source", "left").select("source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "records", "most_copies")])
    # One row per target source stands in this window.
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0))
    return joined.select("source", "target_share", F.coalesce(F.round(share, 6), F.lit(0.0)).alias("actual_share"), "tokens", "records", "most_copies")
