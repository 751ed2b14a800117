"""Records of two sources matched without a shared key.

Records that agree in all they are compared by are one class, and classes are matched. Blocking: the attributes become three sets, the rare words of a
description (words few different descriptions have, counted over both sources; the words of its own firm left out), its runs of words, and the words of title,
firm and place. MinHash keys over each set bring candidates together; where many records share title, firm and place, first together with the runs, and
once the model is fitted every two of them are compared by rare words and runs, and those scored which the model could let stand.
Scoring: similarities of title, firm, place, date and description are weighed by a logistic model fitted on weak labels, pairs on which
the attributes agree or disagree beyond doubt. A Platt step on pairs held out of the fit calibrates it. Matching: a pair
stands if each side is the other's best, until no pair is left, so that every record is in one pair at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import BROADCAST_ROWS, broadcast_if_small, cut
from .names import core_words, lcs_ratio, words_of
from .shingles import MinHasher, distinct, mix, runs, word_hashes
from .terms import fold

FEATURES = ("rare_share", "rare_count", "text", "title", "firm", "place", "date", "joint")

_SYNONYMS = {
    "sr": "senior", "jr": "junior", "ing": "ingenieur", "eng": "engineer", "dev": "developer", "mgr": "manager", "confirme": "confirmed", "graduate": "entry", "entry": "entry", "staff": "principal",
    "munchen": "munich", "muenchen": "munich", "koln": "cologne", "koeln": "cologne", "tlse": "toulouse", "geneve": "geneva", "warszawa": "warsaw", "milano": "milan", "torino": "turin", "bcn": "barcelona", "hh": "hamburg", "raum": "", "gtr": "", "greater": "", "adam": "amsterdam", "london": "london", "nyc": "york", "zurich": "zurich", "lille": "lille",
}
_NOISE = frozenset("f h m x w d v fm hf remote hybrid onsite relisted cdi level mid and the of de des du en in i".split())
_COUNTRY = frozenset("france germany deutschland england kingdom united uk usa us states canada netherlands italy italia spain espana poland switzerland on ny tx nl de ge zh ca".split())


def _tokens(text: str | None, drop: frozenset) -> list[str]:
    if not text:
        return []
    words = re.findall(r"[a-z0-9+#]+", text.replace("a'dam", "amsterdam"))
    return [y for w in words if w not in drop and (y := _SYNONYMS.get(w, w))]


def words_similarity(a: list[str], b: list[str]) -> float:
    """Mean over the words of the shorter list of their best likeness in the other, discounted for what is left over."""
    if not a or not b:
        return 0.5
    if len(a) != len(b) and min(len(a), len(b)) == 1 and lcs_ratio("".join(a), "".join(b)) >= 0.92:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = [max(1.0 if w == x else (lcs_ratio(w, x) if abs(len(w) - len(x)) <= 2 and len(w) > 3 else (0.9 if len(w) > 2 and x.startswith(w) else 0.0)) for x in long) for w in short]
    score = sum(s if s >= 0.75 else 0.0 for s in best) / len(best)
    return score * (1 - 0.1 * min(3, len(long) - len(short)) / 3)


def posting_day(text: Column) -> Column:
    """Day of a date in ISO form, with or without time, or days first with slashes; NULL otherwise."""
    iso, slashed = F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.regexp_replace(F.regexp_extract(text, r"^\s*(\d{1,2}/\d{1,2}/\d{4})", 1), r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1")
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.nullif(slashed, F.lit("")), "yyyy-M-d"))


def attributes(df: DataFrame, key: str, title: str, firm: str, place: str, posted: str, text: str) -> DataFrame:
    """The attributes of one source under common names; repeated rows of a key are one record."""
    return df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), fold(F.coalesce(title, F.lit(""))).alias("title"), words_of(F.coalesce(firm, F.lit(""))).alias("firm"),
        fold(F.coalesce(place, F.lit(""))).alias("place"), F.datediff(posting_day(F.col(posted)), F.lit("1970-01-01")).alias("day"), F.col(text).alias("text"),
    )


def common_words(texts: DataFrame, share: float, least: int) -> np.ndarray:
    """Hashes, sorted, of the words that more than `share` of all different texts, and more than `least`, have.

    Every word of every text is counted; equal texts count as one, whatever rows they stand in: each of n counts as 1 / n. What comes to the driver are the
    common words, of which there are at most (different words a text) / `share` in a corpus of any size.
    """
    kind = "word bigint, n double"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [distinct(runs(ids, 1)) for ids in word_hashes(b["text"])]
            if not found:
                continue
            words, at = np.unique(np.concatenate(found), return_inverse=True)
            yield pd.DataFrame({"word": words.view(np.int64), "n": np.bincount(at, np.repeat(b["weight"].to_numpy(), [len(f) for f in found]), minlength=len(words))})

    hashed = texts.where("text is not null").select("text", F.xxhash64("text").alias("hash"))
    # Only texts that stand in more than one row are looked up.
    copies = cut(hashed.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1"))
    each = hashed.join(broadcast_if_small(copies, copies.count()), "hash", "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    total = hashed.agg(F.approx_count_distinct("hash")).first()[0]
    counted = each.mapInPandas(count, kind).groupBy("word").agg(F.sum("n").alias("n")).where(F.round("n") > max(least, share * total))
    return np.sort(counted.select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64))


def signed_records(records: DataFrame, common: np.ndarray, hashes: int, attr_bands: int, attr_rows: int, sketch: int, text_bands: int, text_rows: int) -> DataFrame:
    """`key, class, title, firm, place, day, rare, runs, words, alike, like`: rare are the hashes of a description's rare words, runs a sketch of its runs of
    five words (the smallest of their hashes), words the MinHash choices of the rare words, alike the block keys of the other attributes, like those of the
    runs. Equal records have equal classes."""
    held = records.sparkSession.sparkContext.broadcast(common)

    def band(m: np.ndarray) -> np.ndarray:
        k = np.arange(1, len(m) + 1, dtype=np.uint64) << np.uint64(40)
        for c in m.T:
            k = (k ^ c) * np.uint64(0x100000001B3)
        return mix(k).view(np.int64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        choose, attr_hash, text_hash = MinHasher(hashes, seed=3), MinHasher(attr_bands * attr_rows, seed=5), MinHasher(text_bands * text_rows, seed=9)
        usual = held.value
        hashed = lru_cache(100_000)(lambda k, w: xxhash.xxh3_64_intdigest(k + w))
        split, core = lru_cache(100_000)(lambda text, drop: _tokens(text, drop)), lru_cache(100_000)(lambda firm: core_words(list(firm)))
        for b in batches:
            out: dict[str, list] = {"rare": [], "runs": [], "words": [], "alike": [], "like": []}
            firms = [tuple(f) for f in b["firm"]]
            names = word_hashes([" ".join(f) for f in firms])
            for title, firm, place, ids, name in zip(b["title"], firms, b["place"], word_hashes(b["text"]), names):
                h = distinct(runs(ids, 1))
                if len(h) and len(usual):
                    at = np.searchsorted(usual, h)
                    at[at == len(usual)] = 0
                    h = h[usual[at] != h]
                if len(h) and len(name):
                    h = h[~np.isin(h, runs(name, 1))]
                # One word a hash function; where there are no more words than functions, every word.
                words = h if len(h) <= hashes else np.unique(h[(choose.a * h.astype(np.uint32)[None, :] + choose.b).argmin(axis=1)])
                attrs = [hashed(k, w) for k, ws in (("t", split(title, _NOISE)), ("f", core(firm)), ("p", split(place, _COUNTRY))) for w in ws]
                r = distinct(runs(ids, 5))
                out["rare"].append(h.view(np.int64))
                out["words"].append(words.view(np.int64))
                out["runs"].append((r[:sketch] >> np.uint64(33)).astype(np.int32))
                out["alike"].append(band(attr_hash(np.array(attrs, np.uint64)).astype(np.uint64).reshape(attr_bands, attr_rows)) if len(attrs) >= 3 else None)
                out["like"].append(band(text_hash(r).astype(np.uint64).reshape(text_bands, text_rows)) if len(r) else None)
            yield b.drop(columns="text").assign(**{k: pd.Series(v, index=b.index, dtype=object) for k, v in out.items()})

    kind = dict(records.dtypes)["key"]
    told = "title string, firm array<string>, place string, day int, rare array<bigint>, runs array<int>, words array<bigint>, alike array<bigint>, like array<bigint>"
    signed = records.mapInPandas(sign, f"key {kind}, {told}")
    return signed.withColumn("class", F.xxhash64("title", "firm", "place", "day", "rare", "runs", "like"))


def _keyed(side: DataFrame, column: str, name: str) -> DataFrame:
    return side.select("class", column).dropDuplicates(["class"]).select(F.col("class").alias(name), F.explode(column).alias("bucket"))


def shared_keys(left: DataFrame, right: DataFrame, most_alike: int) -> DataFrame:
    """`bucket, na, nb, large`: the keys of title, firm and place that both sides have, with their classes; large where a side has more than `most_alike`."""
    counts = [_keyed(side, "alike", n).groupBy("bucket").agg(F.count("*").alias(n)) for side, n in ((left, "na"), (right, "nb"))]
    return cut(counts[0].join(counts[1], "bucket").withColumn("large", F.greatest("na", "nb") > most_alike))


def candidates(left: DataFrame, right: DataFrame, shared: DataFrame) -> DataFrame:
    """`a, b`: classes of the two sides that share a key of rare words, or one of the other attributes.

    No key is left out. A word is rare because few different texts have it, so that no key of rare words has many texts. A large key of the other attributes
    is a firm's usual title and place: it is refined by the keys of the runs, that is by what the descriptions share besides. These are enough to fit
    the model by; what else of a large key may stand is found by `plausible_pairs`.
    """
    rare = _keyed(left, "words", "a").join(_keyed(right, "words", "b"), "bucket").select("a", "b")
    few = _keyed(left, "alike", "a").join(shared.where("not large").select("bucket"), "bucket").join(_keyed(right, "alike", "b"), "bucket").select("a", "b")
    large = shared.where("large").select("bucket")
    large = broadcast_if_small(large, large.count())
    refined = []
    for side, name in ((left, "a"), (right, "b")):
        usual = side.select("class", "like", "alike").dropDuplicates(["class"]).select("class", "like", F.explode("alike").alias("bucket")).join(large, "bucket")
        refined.append(usual.select(F.col("class").alias(name), "bucket", F.explode("like").alias("run")).select(name, F.xxhash64("bucket", "run").alias("bucket")))
    many = refined[0].join(refined[1], "bucket").select("a", "b")
    return rare.unionByName(few).unionByName(many).distinct()


def _agreeing(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets `x` has in common with each of `y`."""
    out = np.zeros((len(x), len(y)), np.float32)
    values = np.intersect1d(np.concatenate(x), np.concatenate(y))
    owner = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    flat = [np.concatenate(s) for s in (x, y)]
    # Some thousand values at a time, so that the tables stay small whatever the texts.
    for at in range(0, len(values), 4096):
        part, tables = values[at : at + 4096], []
        for own, v, n in zip(owner, flat, out.shape):
            k = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[k] == v
            table = np.zeros((n, len(part)), np.float32)
            table[own[hit], k[hit]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def plausible_pairs(left: DataFrame, right: DataFrame, shared: DataFrame, model: tuple[np.ndarray, float, float], least: float, sketch: int, block: int = 512) -> DataFrame:
    """`a, b`: of every two classes that share a large key, those that can reach the confidence `least`.

    Every two are compared, block by block, by their rare words and runs; title, firm, place and date count as the model would have them best, so that no
    pair is left out which the model would let stand.
    """
    weights, slope, offset = model
    c = dict(zip((*FEATURES, "one"), np.asarray(weights, float) * slope))
    rest = sum(max(0.0, c[f]) for f in ("title", "firm", "place", "date"))
    floor = float(np.log(least / (1 - least))) - offset - c["one"] - rest - 1e-6
    large = shared.where("large").select("bucket", *[F.ceil(F.col(n) / F.lit(block)).cast("int").alias(f"k{n}") for n in ("na", "nb")])
    large = broadcast_if_small(large, large.count())

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        rows = side.select("class", "rare", "runs", "alike").dropDuplicates(["class"]).withColumn("bucket", F.explode("alike")).join(large, "bucket")
        rows = rows.withColumn(own, F.pmod(F.xxhash64("class"), F.col(f"k{own}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"k{other}") - 1)))
        return rows.select(F.xxhash64("bucket", "na", "nb").alias("met"), F.lit(own == "na").alias("first"), "class", "rare", "runs")

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        first = g["first"].to_numpy()
        x, y = g[first], g[~first]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sizes = [s["rare"].str.len().to_numpy() for s in (x, y)]
        n = _agreeing(list(x["rare"]), list(y["rare"]))
        share = n / np.maximum(1, np.minimum(sizes[0][:, None], sizes[1][None, :]))
        runs_of = [list(s["runs"]) for s in (x, y)]
        limits = [np.array([r[-1] if len(r) >= sketch else (1 << 31) - 1 for r in s], np.int64) for s in runs_of]
        # Both limits hold: of the own runs all lie below the own.
        below = np.minimum(np.stack([np.searchsorted(r, limits[1], "right") for r in runs_of[0]]), np.stack([np.searchsorted(r, limits[0], "right") for r in runs_of[1]]).T)
        text = _agreeing(*runs_of) / np.maximum(1, below)
        z = c["rare_share"] * share + c["rare_count"] * np.minimum(n, 6) / 6 + c["text"] * text + max(0.0, c["joint"]) * share * np.minimum(n, 3) / 3
        i, j = np.nonzero(z >= floor)
        return pd.DataFrame({"a": x["class"].to_numpy()[i], "b": y["class"].to_numpy()[j]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            # The last group may go on in the next batch.
            last = (b["met"] == b["met"].iloc[-1]).to_numpy()
            rest = b[last]
            for _, g in b[~last].groupby("met", sort=False):
                yield meet(g)
        if rest is not None and len(rest):
            yield meet(rest)

    every = dealt(left, "na", "nb").unionByName(dealt(right, "nb", "na"))
    return every.repartition("met").sortWithinPartitions("met").mapInPandas(compare, "a bigint, b bigint").distinct()


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, sketch: int) -> DataFrame:
    """`a, b` and the FEATURES of each candidate pair of classes. Sets are compared in columns, words in Python, each pair of values once a task."""
    cols = ("title", "firm", "place", "day", "rare", "runs")
    sided = lambda df, k: df.dropDuplicates(["class"]).select(F.col("class").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols])
    both = pairs.join(sided(left, "a"), "a").join(sided(right, "b"), "b")
    # Of two sketches of smallest hashes only the part below the lower of the two limits can be compared.
    limit = F.least(*[F.when(F.size(c) >= sketch, F.element_at(c, -1)).otherwise(F.lit((1 << 31) - 1)) for c in ("a_runs", "b_runs")])
    below = F.least(*[F.size(F.filter(c, lambda v: v <= limit)) for c in ("a_runs", "b_runs")])
    told = both.select(
        "a", "b", *[f"{k}_{c}" for k in "ab" for c in ("title", "place")], *[F.array_join(f"{k}_firm", " ").alias(f"{k}_firm") for k in "ab"],
        F.size(F.array_intersect("a_rare", "b_rare")).alias("n"), F.greatest(F.lit(1), F.least(F.size("a_rare"), F.size("b_rare"))).alias("m"),
        (F.size(F.array_intersect("a_runs", "b_runs")) / F.greatest(below, F.lit(1))).alias("text"), (F.col("b_day") - F.col("a_day")).alias("lag"),
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        title = lru_cache(200_000)(lambda a, b: words_similarity(_tokens(a, _NOISE), _tokens(b, _NOISE)))
        place = lru_cache(200_000)(lambda a, b: words_similarity(_tokens(a, _COUNTRY), _tokens(b, _COUNTRY)))
        firm = lru_cache(200_000)(lambda a, b: words_similarity(core_words(a.split(" ")), core_words(b.split(" "))) if a and b else 0.5)
        for p in batches:
            share, n = p["n"] / p["m"], p["n"]
            d = pd.DataFrame({"a": p["a"], "b": p["b"], "rare_share": share, "rare_count": n.clip(upper=6) / 6, "text": p["text"]})
            for name, like, keys in (("title", title, "title"), ("firm", firm, "firm"), ("place", place, "place")):
                d[name] = [like(x, y) for x, y in zip(p[f"a_{keys}"], p[f"b_{keys}"])]
            d["date"] = p["lag"].between(-3, 45).astype(float).where(p["lag"].notna(), 0.5)
            # A translated listing shares no run of words, only names: then firm, place and rare words must agree together.
            d["joint"] = share * d["firm"] * d["place"] * n.clip(upper=3) / 3
            yield d[["a", "b", *FEATURES]]

    return told.mapInPandas(compare, "a bigint, b bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def numbered(members: DataFrame, parts: int = 64) -> DataFrame:
    """`class, key, i, n`: the members of each class numbered from 0, and their number. A class of any size is numbered in `parts` pieces."""
    piece = members.withColumn("piece", F.pmod(F.xxhash64("key"), F.lit(parts)))
    sizes = piece.groupBy("class", "piece").agg(F.count("*").alias("own"))
    # At most `parts` rows a class.
    before = sizes.select("class", "piece", (F.sum("own").over(Window.partitionBy("class").orderBy("piece")) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy("class")).alias("n"))
    own = piece.withColumn("k", F.row_number().over(Window.partitionBy("class", "piece").orderBy("key")))
    return own.join(before, ["class", "piece"]).select("class", "key", (F.col("k") - 1 + F.col("before")).cast("long").alias("i"), F.col("n").cast("long").alias("n"))


def of_members(scored: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of classes as pairs of records: each record of the larger class gets one partner of the smaller, going round. Among equal records any choice is
    as good, so that no record need meet all of another class."""
    a = left.select(F.col("class").alias("a"), F.col("key").alias("ka"), F.col("i").alias("ia"), F.col("n").alias("na"))
    b = right.select(F.col("class").alias("b"), F.col("key").alias("kb"), F.col("i").alias("ib"), F.col("n").alias("nb"))
    sizes = scored.join(a.select("a", "na").distinct(), "a").join(b.select("b", "nb").distinct(), "b")
    # Numbers run over the larger side; the smaller side's member is the remainder.
    wide = sizes.where("na >= nb").join(a.drop("na"), "a").withColumn("ib", F.pmod("ia", "nb")).join(b.drop("nb"), ["b", "ib"])
    tall = sizes.where("na < nb").join(b.drop("nb"), "b").withColumn("ia", F.pmod("ib", "na")).join(a.drop("na"), ["a", "ia"])
    cols = [F.col("ka").alias("a"), F.col("kb").alias("b"), *[c for c in scored.columns if c not in ("a", "b")]]
    return wide.select(*cols).unionByName(tall.select(*cols))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last, by Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Weights where there are too few pairs to fit any: the text decides.
PRIOR = np.array([2.0, 1.5, 5.0, 0.5, 1.0, 0.7, 0.5, 3.0, -6.0])


def fit_on_weak_labels(features: DataFrame, most_pairs: int = 20_000) -> tuple[np.ndarray, float, float]:
    """(weights, slope, offset) from a bounded sample of `most_pairs` pairs a label, chosen by hash.

    Positive: firm and place alike, and either the texts share most runs, or most rare words are shared and the titles are alike or the
    texts are in different languages. Negative: few rare words and few runs shared, as by other openings of a firm. Pairs between have no
    label. Half of the labelled pairs is held out of the fit to calibrate the probabilities.
    """
    alike = (F.col("firm") >= 0.75) & (F.col("place") >= 0.75)
    told = (F.col("text") >= 0.6) | ((F.col("rare_share") >= 0.6) & (F.col("rare_count") >= 0.5))
    positive = alike & told & ((F.col("title") >= 0.75) | (F.col("text") < 0.05))
    near = (F.col("title") >= 0.75) & (F.col("place") >= 0.75) & (F.col("rare_share") > 0.2) & (F.col("rare_count") >= 0.33)
    negative = (F.col("rare_share") < 0.4) & (F.col("text") < 0.45) & ~near
    labelled = features.withColumn("label", F.when(positive, 1).when(negative, 0)).where("label is not null")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 30:
        return PRIOR, 1.0, 0.0
    parts = []
    for k, n in sizes.items():
        share = min(1.0, most_pairs / n)
        parts.append(labelled.where((F.col("label") == k) & (F.pmod(F.xxhash64("a", "b"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select("label", *FEATURES).toPandas())
    d = pd.concat(parts, ignore_index=True)
    d = d.sort_values(list(d.columns)).reset_index(drop=True)
    x, y = d[list(FEATURES)].to_numpy(float), d["label"].to_numpy(float)
    half = np.random.default_rng(5).random(len(x)) < 0.5
    w = fit_logistic(x[half], y[half])
    z = np.column_stack([x[~half], np.ones((~half).sum())]) @ w
    slope, offset = fit_logistic(z[:, None], y[~half], ridge=1e-4)
    return w, float(slope), float(offset)


def confidence(weights: np.ndarray, slope: float, offset: float) -> Column:
    z = sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights)), F.lit(float(weights[-1])))
    return 1 / (1 + F.exp(-(z * slope + offset)))


def one_to_one(scored: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs in which each side is the other's best among those left, until no pair is left; `scored(a, b, confidence, ...)` with columns to rank by.

    Ties go to the greater text similarity, then the greater keys. While more than `few` pairs are left, rounds are taken on the cluster: of sides that are
    tied the first of one goes to the first of the other, the second to the second and so on, so that a group of equal openings takes one round and not one a
    pair. What is left is settled in one task, best pair first, which is where rounds without end would come to.
    """
    rank = F.struct(F.round("confidence", 6).alias("c"), F.round("text", 6).alias("t"), F.round("rare_share", 6).alias("s"), F.round(F.col("title") + F.col("firm") + F.col("place") + F.col("date"), 6).alias("o"))
    every = left = cut(scored.withColumn("rank", rank))
    won = None
    while left.count() > few:
        tops = [left.groupBy(k).agg(F.max("rank").alias(f"top_{k}")) for k in ("a", "b")]
        tied = left.join(tops[0], "a").join(tops[1], "b").where((F.col("rank") == F.col("top_a")) & (F.col("rank") == F.col("top_b"))).select("a", "b")
        place = lambda of, by: F.row_number().over(Window.partitionBy(of).orderBy(F.desc(by)))
        even = tied.withColumn("i", place("b", "a")).withColumn("j", place("a", "b")).where("i = j")
        # The greatest key of all and its greatest partner are the first of each other, so that no round is empty.
        first = [even.groupBy(k).agg(F.min(F.struct("i", o))[o].alias(o)) for k, o in (("a", "b"), ("b", "a"))]
        new = cut(first[0].join(first[1], ["a", "b"]).select("a", "b"))
        won = new if won is None else won.unionByName(new)
        left = cut(left.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = pd.concat([pd.DataFrame({"a": [], "b": []}), *batches], ignore_index=True)
        if len(d):
            d = d.sort_values(["c", "t", "s", "o", "a", "b"], ascending=False)
            gone_a, gone_b, kept = set(), set(), []
            for a, b in zip(d["a"], d["b"]):
                kept.append(a not in gone_a and b not in gone_b)
                if kept[-1]:
                    gone_a.add(a)
                    gone_b.add(b)
            yield d.loc[kept, ["a", "b"]]

    kinds = dict(left.dtypes)
    rest = left.select("a", "b", "rank.*").coalesce(1).mapInPandas(settle, f"a {kinds['a']}, b {kinds['b']}")
    return every.join(rest if won is None else won.unionByName(rest), ["a", "b"], "left_semi")


def matched_openings(
    jobs: DataFrame, records: DataFrame, least: float = 0.5, hashes: int = 20, attr_bands: int = 4, attr_rows: int = 4, text_bands: int = 6, text_rows: int = 2, sketch: int = 32, rare_in: int = 24, rare_share: float = 1e-5, most_alike: int = 8
) -> DataFrame:
    """`id, jobid, confidence`: listings and records of the same opening, each in one pair at most.

    NULL titles, firms, places and dates count as neither alike nor unlike; a NULL or empty description matches by nothing, so such a record
    stays unmatched. Repeated rows of a key are one record; extra columns play no part; an empty side gives no row.
    """
    a = attributes(jobs, "id", "title", "company", "location_raw", "date_posted", "description_text")
    b = attributes(records, "jobid", "title", "companyname", "location", "publishedat", "description")
    common = common_words(a.select("text").unionByName(b.select("text")), rare_share, rare_in)
    left, right = [cut(signed_records(side, common, hashes, attr_bands, attr_rows, sketch, text_bands, text_rows)) for side in (a, b)]
    shared = shared_keys(left, right, most_alike)
    features = cut(compared(candidates(left, right, shared), left, right, sketch))
    model = fit_on_weak_labels(features)
    others = plausible_pairs(left, right, shared, model, least, sketch).join(features.select("a", "b"), ["a", "b"], "left_anti")
    every = features.unionByName(cut(compared(others, left, right, sketch)))
    scored = every.withColumn("confidence", confidence(*model)).where(F.col("confidence") >= least)
    # Rows of a key that differ count by the least class.
    members = [cut(numbered(side.groupBy("key").agg(F.min("class").alias("class")))) for side in (left, right)]
    return one_to_one(of_members(scored, *members)).select(F.col("a").alias("id"), F.col("b").alias("jobid"), F.round("confidence", 6).alias("confidence"))
