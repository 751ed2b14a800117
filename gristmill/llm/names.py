"""Variant spellings of organisations linked by keys that every two names which may agree share.

Names that are spelled alike are one. Words that match are found once in the vocabulary; two names meet if they have what the ways to agree ask for: two
words that match, one that matches beside an initial or a beginning, one that is all of a name, pieces of the joined words, or a homepage. Names that meet
are compared word by word by longest-common-subsequence ratio; a key that many names have is cut into blocks, and none is left out. Rows of
names that agree are linked unless they contradict each other in a column. Links close to components; a component whose members contradict
each other falls back to its direct links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import combinations
from math import ceil, comb, floor, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_if_small, cut
from .graph import components
from .shingles import mix
from .terms import fold

#: Words that say what kind of firm it is, not which.
LEGAL = ("sas", "sa", "sarl", "sasu", "gmbh", "ag", "kg", "ltd", "limited", "llc", "llp", "inc", "plc", "spa", "srl", "bv", "nv", "sl", "ab", "oy", "corp", "co", "company", "se", "sp", "z", "oo", "zoo")
TRADE = ("group", "groupe", "holding", "cabinet", "associes", "partners", "partner", "ptnrs", "consulting", "consult", "conseil", "conseils", "services", "service", "svcs", "solutions", "solution", "systems", "systemes", "system", "technologies", "technology", "engineering", "informatique", "international", "et", "and", "und", "cons", "tech", "the")
PLACES = ("france", "germany", "deutschland", "usa", "us", "uk", "united", "kingdom", "spain", "espana", "italy", "italia", "switzerland", "suisse", "canada", "poland", "netherlands", "belgium", "europe")
GENERIC = frozenset((*LEGAL, *TRADE, *PLACES))
#: Short forms of first names.
NICKNAMES = {"nate": "nathaniel", "josie": "josephine", "jo": "josephine", "chris": "christopher", "sam": "samuel", "ben": "benjamin", "alex": "alexandra", "kathi": "katharina", "lisa": "elisabeth", "matt": "matthias", "fred": "frederic", "tom": "tomas", "toni": "antonio", "max": "maxime", "gabi": "gabrielle", "willa": "wilhelmina", "pip": "philippa", "pippa": "philippa", "will": "wilhelmina", "theo": "theodore", "theo.": "theodore", "des": "desmond", "fritz": "friedrich", "hattie": "harriet", "bea": "beatrice"}

#: Least suffix length, how many names of a key make a block, and the ratio from which names are alike enough if the homepage is the same.
LEAST_SUFFIX, BLOCK, LIKE = 4, 256, 0.5
#: Ratios from which two words match and two joined names agree, and the most letters of words that meet by what is left after deletions.
STRONG, JOINED, SHORT = 0.8, 0.92, 11
#: Strings of more letters meet all of about their length: pieces of them would be too many.
LONG = 48


def homepage_host(url: Column) -> Column:
    """Host of a homepage in whatever form; NULL if there is none."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://", ""), r"^www\.|[/?#:].*$", "")
    return F.when(F.length(host) > 0, host)


def words_of(name: Column) -> Column:
    """Words of a name, without accents, marks and what stands in brackets."""
    plain = F.regexp_replace(fold(name), r"\([^)]*\)", " ")
    plain = F.regexp_replace(plain, r"\b([a-z])\.(?=[a-z]\b\.?)", "$1")
    return F.filter(F.split(F.regexp_replace(plain, r"[^a-z0-9.]+", " "), " "), lambda w: F.length(F.regexp_replace(w, r"\.", "")) > 0)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one step a character of `b`."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 0.0


_SOUNDS = (("ph", "f"), ("ou", "u"), ("c", "k"), ("w", "v"), ("y", "i"))


def _sound(word: str) -> str:
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    return word


def core_words(words: list[str]) -> list[str]:
    """Words that tell which firm it is, shortened first names spelled out; all words if none would remain."""
    plain = [w if len(w) == 2 and w.endswith(".") else w for w in words]
    core = [w for w in plain if w.replace(".", "") not in GENERIC and not (len(w) <= 3 and w.endswith(".") and len(w) != 2)]
    core = [NICKNAMES.get(w, w) for w in core]
    return [_sound(w) for w in (core or plain)]


def _word_match(a: str, b: str) -> float:
    """1 for equal words, the subsequence ratio for close ones, 0.9 for an abbreviation, 0.6 for an initial."""
    if a == b:
        return 1.0
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    bare = x.rstrip(".")
    if len(bare) == 1:
        return 0.6 if y.startswith(bare) else 0.0
    if len(bare) >= 3 and y.startswith(bare) and x.endswith("."):
        return 0.9
    r = lcs_ratio(a.replace(".", ""), b.replace(".", ""))
    return r if r >= STRONG and abs(len(a) - len(b)) <= 2 else 0.0


def name_match(a: list[str], b: list[str], core: Callable = core_words, match: Callable = _word_match) -> str:
    """How two names agree: `full`, `part` (all words of one are in the other), `like` (the whole names are, by their common subsequence) or `none`."""
    how = _word_for_word(a, b, core, match)
    if how == "none" and lcs_ratio("".join(sorted(a)), "".join(sorted(b))) >= LIKE:
        return "like"
    return how


def _word_for_word(a: list[str], b: list[str], core: Callable, match: Callable) -> str:
    if sorted(a) == sorted(b):
        return "full"
    ca, cb = core(a), core(b)
    joined = "".join(w.rstrip(".") for w in ca), "".join(w.rstrip(".") for w in cb)
    if min(map(len, joined)) >= 8 and abs(len(joined[0]) - len(joined[1])) <= 2 and lcs_ratio(*joined) >= JOINED:
        return "full"
    # A name written as one word.
    if len(ca) != len(cb) and (len(ca) == 1 or len(cb) == 1):
        one, rest = (ca[0], cb) if len(ca) == 1 else (cb[0], ca)
        if len(one) >= 8 and lcs_ratio(one, "".join(rest)) >= JOINED:
            return "full"
    short, long = (ca, cb) if len(ca) <= len(cb) else (cb, ca)
    left, scores = list(long), []
    for w in sorted(short, key=len, reverse=True):
        k = max(range(len(left)), key=lambda i: match(w, left[i]), default=None)
        s = match(w, left[k]) if k is not None else 0.0
        scores.append(s)
        if s:
            left.pop(k)
    strong = sum(1 for s in scores if s >= 0.8)
    if not strong or not all(scores):
        # A firm named after a person: the surname agrees, and the first names begin alike, as short forms do.
        ordered = sorted(short, key=len, reverse=True)
        firsts = [w for w, x in zip(ordered, scores) if x < 0.8]
        person = any(w in ("cabinet", "associes") for w in a + b) or len(short) == 2
        alike = all(any(w[:2] == x[:2] for x in left) for w in firsts)
        return "part" if strong and person and alike and max(len(w) for w, x in zip(ordered, scores) if x >= 0.8) >= 5 else "none"
    return "full" if not left and len(short) > 1 else "part"


def prepared(dim_company: DataFrame) -> DataFrame:
    """`cid, name, words, host, year, stock, country, org, size, inds` of each company row with an id and a name."""
    return (
        dim_company.where("company_id is not null and trim(name) <> ''")
        .select(
            F.col("company_id").alias("cid"), "name", words_of(F.col("name")).alias("words"), homepage_host(F.col("homepage_url")).alias("host"),
            F.col("year_founded").alias("year"), F.upper(F.trim("stock_symbol")).alias("stock"), F.upper(F.trim("hq_country")).alias("country"),
            F.when(~F.lower(F.trim("org_type")).isin("unknown", ""), F.lower(F.trim("org_type"))).alias("org"), F.col("size_employees").alias("size"),
        )
        .dropDuplicates(["cid"])
    )


def suffixes(words: str) -> Column:
    """Suffixes of at least LEAST_SUFFIX letters of the words that tell which firm it is."""
    letters = F.transform(words, lambda w: F.regexp_replace(w, r"\.", ""))
    spelled = F.aggregate(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _SOUNDS]), letters, lambda acc, s: F.transform(acc, lambda w: F.replace(w, s["a"], s["b"])))
    generic = F.array(*[F.lit(_sound(g)) for g in sorted(GENERIC)])
    core = F.filter(spelled, lambda w: ~F.array_contains(generic, w) & (F.length(w) >= LEAST_SUFFIX))
    return F.array_distinct(F.flatten(F.transform(core, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (LEAST_SUFFIX - 1)), lambda k: F.substring(w, k, F.length(w))))))


def _key(*parts) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest("\t".join(map(str, parts)))).astype(np.int64))


@cache
def _least_common(m: int, n: int, ratio: float) -> int | None:
    """How many letters strings of m and n letters must have in common for the ratio; None if they cannot."""
    k = max(0, floor(ratio * (m + n) / 2) - 1)
    while 2 * k / (m + n) < ratio:
        k += 1
    return k if k <= min(m, n) else None


@cache
def _partners(n: int, ratio: float) -> list[tuple[int, int]]:
    """(length, letters in common) of the strings that may reach the ratio with one of n letters."""
    return [(m, k) for m in range(max(1, floor(n * ratio / (2 - ratio)) - 1), ceil(n * (2 - ratio) / ratio) + 2) if (k := _least_common(m, n, ratio)) is not None]


def long_keys(n: int) -> set[int]:
    """Two strings of n and m letters share a key if neither is more than half as long again as the other."""
    steps = log(max(n, 1), 1.5) / 2
    return {_key("long", 0, floor(steps)), _key("long", 1, floor(steps + 0.5))} if n > LONG // 2 else set()


def piece_keys(s: str, ratio: float, least: int = 0) -> set[tuple[int, bool]]:
    """(key, whether the string is the longer one there). Any two strings of LONG letters at most that reach the ratio, the longer one of `least` letters or more, share a key.

    With d letters that the two do not share, the shorter one is cut into d + 1 pieces. One of them, the i-th, is whole in the other and has just i of those letters
    before it, which settle where it may stand.
    """
    n, out = len(s), set()
    for m, common in _partners(n, ratio) if n <= LONG else ():
        if not least <= max(m, n) <= LONG:
            continue
        low, high = min(m, n), max(m, n)
        gone, new = low - common, high - common
        for i in range(gone + new + 1):
            x, y = low * i // (gone + new + 1), low * (i + 1) // (gone + new + 1)
            starts = {x} if n <= m else set()
            if n >= m:
                starts |= {x + i - 2 * g for g in range(max(0, i - new), min(i, gone) + 1)}
            out |= {(_key(low, high, i, s[p : p + y - x]), n == high) for p in starts if 0 <= p <= n - (y - x)}
    return out


@cache
def _kept(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k)


def word_keys(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | bool]]:
    """(places in `words`, keys, whether the word leads there): any two words that match by their ratio share a key.

    Short words share what is left of both after deletions, longer ones pieces. Lengths differ by two at most; a word with a full stop is
    compared without it, so that it may be shorter or longer by one more, for which it is tried with a letter more or less, too.
    """
    tried: dict[int, list[tuple[int, str]]] = {}
    pieces: list[tuple[int, int, bool]] = []
    for at, w in enumerate(words):
        bare = w.replace(".", "")
        tried.setdefault(len(bare), []).append((at, bare))
        # (6, 7 or 8 letters and three more, or as many less) are left to these.
        if bare != w and len(bare) in (6, 7, 8):
            tried.setdefault(len(bare) + 1, []).extend((at, bare[:p] + c + bare[p:]) for p in range(len(bare) + 1) for c in "abcdefghijklmnopqrstuvwxyz0123456789")
        elif bare != w and len(bare) in (9, 10, 11):
            tried.setdefault(len(bare) - 1, []).extend((at, bare[:p] + bare[p + 1 :]) for p in range(len(bare)))
        pieces += [(at, *k) for k in piece_keys(bare, STRONG, SHORT + 1)] + [(at, k, len(bare) > LONG) for k in long_keys(len(bare))]
    if pieces:
        at, key, lead = zip(*pieces)
        yield np.array(at), np.array(key, np.int64), np.array(lead)
    for n, some in tried.items():
        if n > SHORT:
            continue
        at, letters = np.array([x for x, _ in some]), np.frombuffer("".join(w for _, w in some).encode("latin-1"), np.uint8).reshape(-1, n).astype(np.uint64)
        for m, k in _partners(n, STRONG):
            if abs(m - n) > 2 or max(m, n) > SHORT:
                continue
            # The key has both lengths, so that no two words meet that have too little in common for theirs.
            kept, h = _kept(n, k), np.full((len(at), comb(n, k)), 64 * min(m, n) + max(m, n), np.uint64)
            for j in range(k):
                h = (h ^ letters[:, kept[:, j]]) * np.uint64(0x100000001B3)
            yield np.repeat(at, len(kept)), mix(h).view(np.int64).ravel(), True


def meeting(keyed: DataFrame, block: int) -> DataFrame:
    """`na, nb` (na < nb): every two of `keyed(nid, key, lead)` that share a key, if one of them leads there, however many share it."""
    whole = Window.partitionBy("key")
    both = keyed.repartition("key").dropDuplicates(["key", "nid", "lead"]).withColumns({"n": F.count("*").over(whole), "led": F.max("lead").over(whole)}).where("n > 1 and led")
    both = both.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    x = both.select(F.col("nid").alias("na"), F.col("lead").alias("la"), "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    y = both.select(F.col("nid").alias("nb"), F.col("lead").alias("lb"), "key", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int").alias("block"))
    # Those that do not lead never meet each other.
    met = x.where("la").join(y, ["key", "block"]).where("case when lb then na < nb else na != nb end")
    return met.select(F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb")).distinct()


def names_that_meet(names: DataFrame, block: int = BLOCK) -> DataFrame:
    """`na, nb` (na < nb): every two of `names(nid, words)` that share a suffix, however many names share it."""
    return meeting(names.select("nid", F.explode(suffixes("words")).alias("key")).withColumn("lead", F.lit(True)), block)


def matching_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """`a, b`: every two different words of `words(word)` that match, by their ratio or as an abbreviation; each pair once."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = b["nid"].to_numpy()
            for at, key, lead in word_keys(b["word"].to_list()):
                yield pd.DataFrame({"nid": names[at], "key": key, "lead": lead})

    named = cut(words.select("word", F.xxhash64("word").alias("nid")))
    met = meeting(named.mapInPandas(keys, "nid bigint, key bigint, lead boolean"), block)
    spelled = lambda n, w: named.select(F.col("nid").alias(n), F.col("word").alias(w))
    by_ratio = met.join(spelled("na", "a"), "na").join(spelled("nb", "b"), "nb").select("a", "b")
    stopped = words.where("word like '%.' and length(rtrim('.', word)) >= 3").select(F.col("word").alias("a"), F.expr("rtrim('.', word)").alias("bare"))
    lengths = sorted(r[0] for r in stopped.select(F.length("bare")).distinct().collect())
    begun = words.select(F.col("word").alias("b"), F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")).where("length(b) > n").select("b", F.substring("b", F.lit(1), F.col("n")).alias("bare"))
    every = by_ratio.unionByName(begun.join(broadcast_if_small(stopped, stopped.count()), "bare").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[[_word_match(x, y) >= STRONG for x, y in zip(p["a"], p["b"])]]

    return every.mapInPandas(verify, "a string, b string")


def names_that_may_agree(names: DataFrame, hosts: DataFrame, block: int = BLOCK) -> DataFrame:
    """`na, nb` (na < nb): every two of `names(nid, words)` that `name_match` may find to agree in full or in part, and every two with one of `hosts(nid, host)`.

    A match of words stands for the two words alike, so that names that hold one each share it. The ways to agree, each with its keys: two words match; one does
    and another is an initial or begins alike; one does and is the whole of a name; the words joined reach the ratio; the same words in all.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core = lru_cache(200_000)(core_words)
        for b in batches:
            yield pd.DataFrame({"nid": b["nid"], "all": [" ".join(sorted(w)) for w in b["words"]], "core": [list(core(tuple(w))) for w in b["words"]]})

    told = cut(names.select("nid", "words").mapInPandas(split, "nid bigint, all string, core array<string>"))
    pairs = cut(matching_words(told.select(F.explode("core").alias("word")).distinct(), block))
    shared = F.xxhash64("a", "b").alias("match")
    senses = pairs.select(F.col("a").alias("word"), shared).unionByName(pairs.select(F.col("b").alias("word"), shared)).groupBy("word").agg(F.collect_list("match").alias("matches"))
    senses = cut(senses)
    placed = told.select("nid", "all", F.posexplode("core").alias("pos", "word")).join(broadcast_if_small(senses, senses.count()), "word", "left")
    full = placed.groupBy("nid").agg(F.first("all").alias("all"), F.sort_array(F.collect_list(F.struct("pos", "word", "matches"))).alias("core"))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple[int, int, bool]] = []
            for nid, name, core in zip(b["nid"], b["all"], b["core"]):
                words = [w["word"] for w in core]
                ways = [[w["word"], *(w["matches"] if w["matches"] is not None else ())] for w in core]
                single = len(words) == 1
                got = {("=", name)} if single else set()
                led, rest = {("0", x) for x in ways[0]} if single else set(), set()
                if not single:
                    rest |= {("0", x) for xs in ways for x in xs}
                for i, j in combinations(range(len(words)), 2):
                    got |= {("2", *sorted((str(x), str(y)))) for x in ways[i] for y in ways[j]}
                    for one, other in ((i, j), (j, i)):
                        w = words[other]
                        got |= {("3", x, w[:2]) for x in ways[one]}
                        (led if len(w.rstrip(".")) == 1 else rest).update(("1", x, w[:1]) for x in ways[one])
                joined = {t for t in ("".join(w.rstrip(".") for w in words), "".join(words)) if len(t) >= 8}
                out += [(nid, _key(*g), True) for g in got | led]
                out += [(nid, *k) for k in set().union(*(piece_keys(t, JOINED) for t in joined))]
                out += [(nid, k, len(t) > LONG) for t in joined for k in long_keys(len(t))]
                out += [(nid, _key(*g), False) for g in rest - led]
            yield pd.DataFrame(out, columns=["nid", "key", "lead"])

    by_host = hosts.where("host is not null").select("nid", F.xxhash64(F.lit("host"), "host").alias("key"), F.lit(True).alias("lead")).distinct()
    return meeting(full.mapInPandas(keys, "nid bigint, key bigint, lead boolean").unionByName(by_host), block)


def _clash(a: str, b: str) -> Column:
    """Whether two rows contradict each other in a column that one organisation has one value of."""
    differ = [F.col(f"{a}.{c}").isNotNull() & F.col(f"{b}.{c}").isNotNull() & (F.col(f"{a}.{c}") != F.col(f"{b}.{c}")) for c in ("host", "year", "stock", "country", "org")]
    sizes = F.col(f"{a}.size").isNotNull() & F.col(f"{b}.size").isNotNull() & (F.greatest(f"{a}.size", f"{b}.size") > 1.5 * F.least(f"{a}.size", f"{b}.size") + 2)
    out = sizes
    for x in differ:
        out = out | x
    return F.coalesce(out, F.lit(False))


def _support(a: str, b: str) -> Column:
    """How many independent columns agree; the homepage alone is proof."""
    same = lambda c: F.coalesce(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), F.lit(False))
    near = F.coalesce(F.greatest(f"{a}.size", f"{b}.size") <= 1.45 * F.least(f"{a}.size", f"{b}.size"), F.lit(False))
    return F.when(same("host"), 10).otherwise(0) + F.when(same("stock"), 3).otherwise(0) + F.when(same("year"), 2).otherwise(0) + F.when(near, 2).otherwise(0) + F.when(same("country"), 0.5).otherwise(0) + F.when(same("org"), 0.5).otherwise(0)


def with_class(rows: DataFrame) -> DataFrame:
    """The rows with `rep`, the least cid of the rows of equal words and columns."""
    return rows.withColumn("rep", F.min("cid").over(Window.partitionBy("words", "host", "year", "stock", "country", "org", "size")))


def linked_companies(dim_company: DataFrame, least_support: float = 2.0) -> DataFrame:
    """`a, b, support` (a < b): ids of rows taken for the same organisation directly; names may be equal.

    Names that agree in full are linked unless their columns clash; a name that is part of the other needs the support of other columns; the same
    homepage is proof enough for names that are alike as a whole. No link goes without the ratio. Rows of equal words and columns are one class, linked to its least id, which alone is
    linked to other classes; see `of_classes`.
    """
    every = cut(with_class(prepared(dim_company)).where(F.size("words") > 0).withColumn("nid", F.xxhash64("words")))
    rows = every.where("cid = rep").drop("rep")
    names = cut(rows.select("nid", "words").dropDuplicates(["nid"]))
    met = names_that_may_agree(names, rows.select("nid", "host")).join(names.select(F.col("nid").alias("na"), F.array_join("words", " ").alias("wa")), "na").join(names.select(F.col("nid").alias("nb"), F.array_join("words", " ").alias("wb")), "nb")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Each name's words, and each pair of words, once a task.
        core, alike = lru_cache(200_000)(core_words), lru_cache(500_000)(_word_match)
        for b in batches:
            yield b[["na", "nb"]].assign(how=[name_match(tuple(x.split(" ")), tuple(y.split(" ")), core, alike) for x, y in zip(b["wa"], b["wb"])])

    agree = met.repartition(F.xxhash64("na", "nb")).mapInPandas(match, "na bigint, nb bigint, how string").where("how != 'none'")
    same = names.select(F.col("nid").alias("na"), F.col("nid").alias("nb"), F.lit("full").alias("how"))
    by_name = (
        agree.unionByName(same).join(rows.alias("x"), F.col("na") == F.col("x.nid")).join(rows.alias("y"), F.col("nb") == F.col("y.nid"))
        .where(((F.col("na") != F.col("nb")) | (F.col("x.cid") < F.col("y.cid"))) & ~_clash("x", "y"))
        .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), _support("x", "y").alias("support"), "how")
        .where(F.col("how").isin("full") | ((F.col("how") == "part") & (F.col("support") >= least_support)) | (F.col("support") >= 10))
    )
    within = every.where("cid != rep").alias("x").join(rows.alias("y"), F.col("x.rep") == F.col("y.cid")).select(F.col("y.cid").alias("a"), F.col("x.cid").alias("b"), _support("x", "y").alias("support"))
    links = by_name.select("a", "b", "support").unionByName(within)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("support").cast("double").alias("support")).distinct()


def of_classes(links: DataFrame, rows: DataFrame) -> DataFrame:
    """`a, b` (a < b): every pair of rows that the links of their classes stand for."""
    of = cut(with_class(rows).select("cid", "rep"))
    reps = links.join(of.select(F.col("cid").alias("a"), F.col("rep").alias("ra")), "a").join(of.select(F.col("cid").alias("b"), F.col("rep").alias("rb")), "b").select("ra", "rb").distinct()
    pairs = reps.join(of.select(F.col("rep").alias("ra"), F.col("cid").alias("a")), "ra").join(of.select(F.col("rep").alias("rb"), F.col("cid").alias("b")), "rb").where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def settled_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """`a, b`: the links without those that a proof contradicts.

    Rows that share homepage or stock symbol are one for certain; what one of them says holds for all. A link between two such groups, or a row and a
    group, goes if their columns taken together clash.
    """
    proof = links.where(F.col("support") >= 3)
    sure = components(proof)
    of = cut(rows.join(sure.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    said = of.groupBy("component").agg(*[F.max(c).alias(c) for c in ("host", "year", "stock", "country", "org", "size")])
    full = cut(of.select("cid", "component").join(said, "component"))
    kept = links.join(full.alias("x"), F.col("a") == F.col("x.cid")).join(full.alias("y"), F.col("b") == F.col("y.cid")).where((F.col("x.component") == F.col("y.component")) | ~_clash("x", "y")).select("a", "b")
    return cut(kept)


def organisations(dim_company: DataFrame) -> DataFrame:
    """`company_id, organisation_id, settled`: the least company_id of the organisation; settled is false where its rows clash.

    Rows without an id or a name are left out; repeated rows count once; a row that is linked to none is an organisation of its own.
    """
    rows = cut(prepared(dim_company))
    comp = components(settled_links(rows, cut(linked_companies(dim_company))))
    of = rows.join(comp, rows.cid == comp.node, "left").withColumn("org_id", F.coalesce("component", "cid"))
    many = F.greatest(*[F.size(F.collect_set(c)) for c in ("host", "year", "stock", "country", "org")])
    clash = of.groupBy("org_id").agg(many.alias("values"))
    return of.join(clash, "org_id").select(F.col("cid").alias("company_id"), F.col("org_id").alias("organisation_id"), (F.col("values") <= 1).alias("settled"))


def variant_pairs(dim_company: DataFrame) -> DataFrame:
    """`company_id_a, company_id_b` of rows of one organisation whose names differ, the smaller id first.

    In a component without contradictions every pair counts, in another only the direct links. Pairs that clash in a column never count.
    """
    rows = cut(prepared(dim_company))
    links = settled_links(rows, cut(linked_companies(dim_company)))
    comp = components(links)
    of = rows.join(comp, rows.cid == comp.node)
    many = F.greatest(*[F.size(F.collect_set(c)) for c in ("host", "year", "stock", "country", "org")])
    clash = of.groupBy("component").agg(many.alias("values"))
    # Rows bring their columns to their component: pairs are made and judged where they meet, and none of them is shuffled.
    of = cut(of.join(clash, "component").drop("node", "words"))
    judged = lambda pairs: pairs.where((F.col("x.name") != F.col("y.name")) & ~_clash("x", "y")).select(F.col("x.cid").alias("company_id_a"), F.col("y.cid").alias("company_id_b"))
    calm = of.where("values <= 1")
    closed = judged(calm.alias("x").join(calm.alias("y"), "component").where("x.cid < y.cid"))
    direct = of_classes(links.join(of.where("values > 1").select(F.col("cid").alias("a")), "a", "left_semi"), rows)
    return closed.unionByName(judged(direct.join(rows.alias("x"), F.col("a") == F.col("x.cid")).join(rows.alias("y"), F.col("b") == F.col("y.cid"))))
