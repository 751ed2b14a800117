"""Language of texts and of their lines by character language models.

One interpolated Kneser-Ney model of character n-grams per language. All models share sorted arrays of n-gram codes: for a code the
array beside it holds the log-probability under each language, already interpolated over the lower orders, so a seen n-gram costs
one binary search for all languages. An unseen one falls back to the next lower order, plus the weight its context gives to
falling back. A line gets the language of the lowest cross-entropy per character; the confidence is a softmax over the
cross-entropies whose slope is calibrated on held-out lines, and a line that no model explains as well as its own held-out lines is
rejected as `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LANGUAGES = ("en", "fr", "de", "es", "it", "nl")
UNDECIDED = "und"
#: Lines under this many characters are numbered, but too short to be judged.
LEAST_CHARS = 40
#: A line is rejected if its best model does worse than SLACK times that language's held-out limit, unless it leads by a confidence of SURE.
SLACK, SURE = 1.2, 0.9

_NAMES = {
    "en": "en eng english anglais englisch inglés ingles inglese engels",
    "fr": "fr fra fre french français francais französisch franzosisch francés frances francese frans",
    "de": "de deu ger german allemand deutsch alemán aleman tedesco duits",
    "es": "es spa spanish espagnol spanisch español espanol castellano castilian spagnolo spaans",
    "it": "it ita italian italien italienisch italiano italiaans",
    "nl": "nl nld dut dutch néerlandais neerlandais niederländisch neerlandés holandés olandese nederlands flemish",
    "pt": "pt por portuguese portugais portugiesisch portugués português portoghese portugees",
    "pl": "pl pol polish polonais polnisch polaco polacco polski", "sv": "sv swe swedish", "da": "da dan danish", "ro": "ro ron rum romanian", "cs": "cs ces cze czech",
}
LABELS = {name: code for code, names in _NAMES.items() for name in names.split()}

# Symbols: 0 is the border, then a letter class each; what is left is one class, digits are another.
_ALPHABET = " abcdefghijklmnopqrstuvwxyzàâäáãåçèéêëìíîïñòóôöõùúûüœæßÿ'"
_BITS = 6
_OTHER, _DIGIT = len(_ALPHABET) + 1, len(_ALPHABET) + 2
assert _DIGIT < 1 << _BITS


def _symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x2100; those above are `other`."""
    t = np.full(0x2100, _OTHER, np.int64)
    for k, c in enumerate(_ALPHABET):
        t[ord(c)] = k + 1
        if len(c.upper()) == 1 and ord(c.upper()) < len(t):
            t[ord(c.upper())] = k + 1
    for c in "0123456789":
        t[ord(c)] = _DIGIT
    for c in "\t\r\u00a0\u2007\u2009\u202f":
        if ord(c) < len(t):
            t[ord(c)] = 1
    t[ord("’")] = t[ord("'")]
    return t


_SYMBOLS = _symbol_table()


def symbols(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all lines, each led by a border, and where each line starts."""
    joined = "\n" + "\n".join(lines)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(points < len(_SYMBOLS), _SYMBOLS[np.minimum(points, len(_SYMBOLS) - 1)], _OTHER)
    s[points == 10] = 0
    starts = np.flatnonzero(points == 10)
    return s, starts


def gram_codes(s: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Code of the n-gram that ends at each symbol; what lies before a line's start counts as border."""
    out = np.zeros(len(s), np.int64)
    at = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    for k in range(order):
        x = np.zeros(len(s), np.int64)
        x[k:] = s[: len(s) - k]
        x[at < k] = 0
        out |= x << (_BITS * k)
    return out


@dataclass
class CharModels:
    """grams[n]: sorted codes of order n + 1; logs[n]: log-probabilities by language; contexts[n], backs[n]: log-weights of falling back from order n + 2."""

    languages: tuple[str, ...]
    order: int
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backs: list[np.ndarray] = field(default_factory=list)
    slope: float = 4.0
    limit: np.ndarray | None = None
    #: Log-probability of a character that no sample has, by language.
    floor: np.ndarray | None = None

    def cross_entropies(self, lines: list[str]) -> np.ndarray:
        """Lines x languages: mean negative log-probability of a line's characters."""
        s, starts = symbols(lines)
        codes = gram_codes(s, starts, self.order)
        total = np.zeros((len(lines), len(self.languages)), np.float64)
        keep = s > 0
        line_of = np.repeat(np.arange(len(lines)), np.diff(np.append(starts, len(s))))[keep]
        codes = codes[keep]
        n = np.bincount(line_of, minlength=len(lines))
        logp = np.empty((len(codes), len(self.languages)), np.float32)
        open_ = np.arange(len(codes))
        extra: np.ndarray | None = None
        for level in range(self.order - 1, -1, -1):
            grams = self.grams[level]
            k = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
            hit = grams[k] == codes
            got = self.logs[level][k[hit]]
            logp[open_[hit]] = got if extra is None else got + extra[hit]
            miss = ~hit
            if not miss.any():
                break
            open_, codes = open_[miss], codes[miss]
            extra = np.zeros((len(codes), len(self.languages)), np.float32) if extra is None else extra[miss]
            if level == 0:
                logp[open_] = extra + self.floor
                break
            contexts = self.contexts[level - 1]
            context = codes >> _BITS
            k = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            hit = contexts[k] == context
            extra[hit] += self.backs[level - 1][k[hit]]
            codes = codes & ((1 << (_BITS * level)) - 1)
        full = n > 0
        firsts = np.concatenate([[0], np.cumsum(n[full])[:-1]]).astype(np.int64)
        if full.any():
            total[full] = -np.add.reduceat(logp, firsts, axis=0, dtype=np.float64) / n[full, None]
        return total

    def judge(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, -1 if rejected; confidence) of each line."""
        h = self.cross_entropies(lines)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        confidence = 1 / np.exp(-self.slope * (h - low[:, None])).sum(axis=1)
        if self.limit is not None:
            best = np.where((low > SLACK * self.limit[best]) & (confidence < SURE), -1, best)
        return best, np.where(best < 0, 0.0, confidence)


def _kneser_ney(lines: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: codes, discounted shares, contexts, fall-back weights of the contexts, all of one language; shares are not yet interpolated."""
    s, starts = symbols(lines)
    out = []
    counts: tuple[np.ndarray, np.ndarray] | None = None
    full = gram_codes(s, starts, order)[s > 0]
    for n in range(order, 0, -1):
        if n == order:
            codes, c = np.unique(full, return_counts=True)
        else:
            # Continuation counts: in how many n-grams of the order above a gram is the ending.
            codes, c = np.unique(counts[0] & ((1 << (_BITS * n)) - 1), return_counts=True)
        counts = (codes, c)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context, where = np.unique(codes >> _BITS, return_inverse=True)
        total = np.bincount(where, c)
        kinds = np.bincount(where)
        out.append((codes, np.maximum(c - discount, 0) / total[where], context, discount * kinds / total, where))
    return out[::-1]


def train(samples: dict[str, list[str]], order: int = 5, languages: tuple[str, ...] = LANGUAGES) -> CharModels:
    """Models from lines by language, every tenth line held out to calibrate the confidence and the rejection."""
    languages = tuple(x for x in languages if samples.get(x))
    fit = {x: [t for k, t in enumerate(samples[x]) if k % 10] or samples[x] for x in languages}
    parts = {x: _kneser_ney(fit[x], order) for x in languages}
    m = CharModels(languages, order)
    symbols_ = 1 << _BITS
    lower: np.ndarray | None = None
    for n in range(order):
        grams = np.unique(np.concatenate([parts[x][n][0] for x in languages]))
        contexts = np.unique(np.concatenate([parts[x][n][2] for x in languages]))
        prob = np.zeros((len(grams), len(languages)))
        back = np.ones((len(contexts), len(languages)))
        for k, x in enumerate(languages):
            codes, share, ctx, weight, _ = parts[x][n]
            prob[np.searchsorted(grams, codes), k] = share
            back[np.searchsorted(contexts, ctx), k] = weight
        if n == 0:
            m.floor = np.log(back[0] / symbols_).astype(np.float32)
            below = np.full((len(grams), len(languages)), 1.0 / symbols_)
        else:
            # A gram's ending is a gram of the order below in some language, but not in all: look it up, with what falling back costs.
            below = lower[np.searchsorted(m.grams[n - 1], grams & ((1 << (_BITS * n)) - 1))]
        prob += back[np.searchsorted(contexts, grams >> _BITS)] * below
        lower = prob
        m.grams.append(grams)
        m.logs.append(np.log(prob).astype(np.float32))
        if n:
            m.contexts.append(contexts)
            m.backs.append(np.log(back).astype(np.float32))
    held = [(k, t) for k, x in enumerate(languages) for j, t in enumerate(samples[x]) if j % 10 == 0 and len(t) >= LEAST_CHARS]
    if len(held) > len(languages):
        h = m.cross_entropies([t for _, t in held])
        y = np.array([k for k, _ in held])
        own = h[np.arange(len(h)), y]
        grid = np.geomspace(0.5, 64, 36)
        loss = [np.log(np.exp(-g * (h - own[:, None])).sum(axis=1)).mean() for g in grid]
        m.slope = float(grid[int(np.argmin(loss))])
        # Nearly all of a language's own held-out lines are explained better than this.
        m.limit = np.array([np.quantile(own[y == k], 0.99) if (y == k).any() else np.inf for k in range(len(languages))])
    return m


def label_language(label: Column) -> Column:
    """Language code a label names, however it is spelled; NULL if it is NULL, blank or names none."""
    text = F.regexp_replace(F.lower(F.trim(label)), r"[-_ (].*$", "")
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[text]


def split_lines(text: str | None) -> list[str]:
    """Lines cut at line feeds, trimmed, empty ones dropped."""
    return [x for x in (y.strip() for y in text.split("\n")) if x] if text else []


def sample_lines(documents: DataFrame, jobs: DataFrame, texts_per_language: int = 1500, lines_per_language: int = 12000) -> dict[str, list[str]]:
    """Training lines by language, a bounded sample: `texts_per_language` texts of lowest hash, and so many lines of them.

    `documents.lang` is right; it has no it and nl, for which texts of `jobs` with that label are taken. Such labels can be wrong, so
    the lines are cleaned: models of the other languages are fitted first, and a line stays only if it is foreign to all of them.
    """

    def pick(df: DataFrame, lang: Column, text: str, key: str, only: tuple[str, ...]) -> dict[str, list[list[str]]]:
        out: dict[str, list[list[str]]] = {}
        labelled = df.where(F.col(text).isNotNull()).select(lang.alias("x"), text, F.xxhash64(F.col(key).cast("string")).alias("h"), key)
        sizes = {r["x"]: r["n"] for r in labelled.where(F.col("x").isin(*only)).groupBy("x").agg(F.count("*").alias("n")).collect()}
        for x in only:
            # Hashes below a cut that lets twice the sample through: what is sent to the driver does not grow with the table.
            part = min(1.0, 2.0 * texts_per_language / max(1, sizes.get(x, 0)))
            low = labelled.where((F.col("x") == x) & (F.pmod("h", F.lit(1_000_000)) < int(part * 1_000_000) + 1))
            rows = low.orderBy("h", key).limit(texts_per_language)
            out[x] = [[y for y in split_lines(t) if len(y) >= LEAST_CHARS] for (t,) in rows.select(text).collect()]
        return out

    def flat(texts: list[list[str]], most: int = lines_per_language) -> list[str]:
        return list(dict.fromkeys(y for lines in texts for y in lines))[:most]

    sure = {k: flat(v, lines_per_language // 2) for k, v in pick(documents, label_language(F.col("lang")), "text", "doc_id", ("en", "fr", "de", "es")).items()}
    labelled = pick(jobs, label_language(F.col("description_language")), "description_text", "id", LANGUAGES)
    weak = clean_labelled(sure, {k: labelled.pop(k) for k in ("it", "nl")})
    first = train({**sure, **{k: flat(v) for k, v in weak.items()}})
    return {k: flat([sure.get(k, []), *weak.get(k, []), *agreeing(first, k, labelled.get(k, []))]) for k in LANGUAGES}


def agreeing(m: CharModels, language: str, texts: list[list[str]]) -> list[list[str]]:
    """Texts whose label the models confirm for four lines of five, without the lines they are sure are in another language.

    This adds what listings say and other documents do not, such as statements of pay.
    """
    out = []
    for lines in texts:
        if lines:
            h = m.cross_entropies(lines)
            best = h.argmin(axis=1)
            mine = np.array([m.languages[b] == language for b in best])
            sure = np.exp(-m.slope * (h - h.min(axis=1, keepdims=True))).sum(axis=1) < 1.001
            if mine.mean() >= 0.8:
                out.append([y for y, ok, s in zip(lines, mine, sure) if ok or not s])
    return out


def clean_labelled(sure: dict[str, list[str]], labelled: dict[str, list[list[str]]]) -> dict[str, list[list[str]]]:
    """Texts of weakly labelled languages without those that are in a sure language, and without their lines in one.

    A line is foreign if every sure model explains it worse than nearly all of its own held-out lines; a text stays if most of its
    lines are foreign, and then its foreign lines stay. Two weak languages are told apart by models fitted on what stayed.
    """
    kept = {k: [t for t in v if t] for k, v in labelled.items()}
    kept = {k: v for k, v in kept.items() if v}
    if sum(map(bool, sure.values())) > 1:
        m = train(sure, languages=tuple(sure))
        for k, texts in kept.items():
            if m.limit is None:
                break
            h = m.cross_entropies([y for lines in texts for y in lines])
            foreign, at, out = (h > m.limit).all(axis=1), 0, []
            for lines in texts:
                mine = foreign[at : at + len(lines)]
                at += len(lines)
                if mine.mean() > 0.5:
                    out.append([y for y, ok in zip(lines, mine) if ok])
            kept[k] = out
    m = train({**sure, **{k: [y for lines in v for y in lines] for k, v in kept.items()}}, languages=(*sure, *kept))
    for k, texts in kept.items():
        out = []
        for lines in texts:
            best, _ = m.judge(lines)
            mine = np.array([b >= 0 and m.languages[b] == k for b in best])
            if mine.mean() > 0.5:
                out.append([y for y, ok in zip(lines, mine) if ok])
        kept[k] = out
    return kept


def judged_lines(jobs: DataFrame, models: CharModels, most_known: int = 100_000) -> DataFrame:
    """`id, label, line_no, chars, lang, confidence` of each line of LEAST_CHARS characters or more. Repeated rows give repeated lines.

    Judgements of lines are kept between batches, up to `most_known` lines: stock phrases are judged once.
    """
    held = jobs.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        names = [*m.languages, UNDECIDED]
        known: dict[str, tuple[int, float]] = {}
        for b in batches:
            rows: list[tuple] = []
            new: dict[str, None] = {}
            for key, label, text in zip(b["id"], b["label"], b["description_text"]):
                for k, line in enumerate(split_lines(text)):
                    if len(line) >= LEAST_CHARS:
                        rows.append((key, label, k + 1, line))
                        if line not in known:
                            new[line] = None
            if len(known) + len(new) > most_known:
                known = {}
                new = dict.fromkeys(r[3] for r in rows)
            fresh = list(new)
            # Some 2 MB of text at a time, whatever the lengths.
            start = 0
            while start < len(fresh):
                stop, size = start, 0
                while stop < len(fresh) and (size < 2_000_000 or stop == start):
                    size += len(fresh[stop])
                    stop += 1
                best, sure = m.judge(fresh[start:stop])
                known.update(zip(fresh[start:stop], zip(best.tolist(), sure.tolist())))
                start = stop
            got = [known[r[3]] for r in rows]
            yield pd.DataFrame(
                {
                    "id": pd.Series([r[0] for r in rows], dtype=object),
                    "label": pd.Series([r[1] for r in rows], dtype=object),
                    "line_no": pd.Series([r[2] for r in rows], dtype="int64"),
                    "chars": pd.Series([len(r[3]) for r in rows], dtype="int64"),
                    "lang": pd.Series([names[x] for x, _ in got], dtype=object),
                    "confidence": pd.Series([x for _, x in got], dtype="float64"),
                }
            )

    rows = jobs.where("id is not null and description_text is not null").select("id", label_language(F.col("description_language")).alias("label"), "description_text")
    return rows.mapInPandas(judge, "id string, label string, line_no bigint, chars bigint, lang string, confidence double")


def mislabelled_lines(jobs: DataFrame, documents: DataFrame, models: CharModels | None = None) -> DataFrame:
    """`id, line_no, lang`: the lines whose language is not the one the listing's label names, or all where it names none.

    Lines under LEAST_CHARS characters, rejected lines and NULL or empty texts give no row. Repeated rows count once.
    """
    models = models or train(sample_lines(documents, jobs))
    lines = judged_lines(jobs, models)
    return lines.where((F.col("lang") != UNDECIDED) & ~F.col("lang").eqNullSafe(F.col("label"))).select("id", "line_no", "lang").distinct()


def text_languages(jobs: DataFrame, documents: DataFrame, models: CharModels | None = None) -> DataFrame:
    """`id, label, lang, confidence, share, languages`: the language of each text by characters, and whether lines differ.

    The language of most characters wins (ties: the first by code); confidence is the character-weighted mean of its lines', share its
    part of the judged characters. A text without a judged line (NULL, empty, short lines only, or all rejected) is `und` with confidence 0.
    """
    models = models or train(sample_lines(documents, jobs))
    lines = judged_lines(jobs, models).where(F.col("lang") != UNDECIDED).distinct()
    by = lines.groupBy("id", "lang").agg(F.first("label", ignorenulls=True).alias("label"), F.sum("chars").alias("chars"), F.sum(F.col("chars") * F.col("confidence")).alias("weight"))
    best = by.groupBy("id").agg(
        F.min(F.struct((-F.col("chars")).alias("c"), "lang", "weight")).alias("b"), F.sum("chars").alias("all"), F.count("*").alias("languages"), F.first("label", ignorenulls=True).alias("label")
    )
    told = best.select("id", F.col("b.lang").alias("lang"), F.round(F.col("b.weight") / -F.col("b.c"), 6).alias("confidence"), F.round(-F.col("b.c") / F.col("all"), 6).alias("share"), F.col("languages").cast("bigint").alias("languages"))
    every = jobs.where("id is not null").groupBy("id").agg(F.min(label_language(F.col("description_language"))).alias("label"))
    out = every.join(told, "id", "left")
    return out.select("id", "label", F.coalesce("lang", F.lit(UNDECIDED)).alias("lang"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("confidence", "share")], F.coalesce("languages", F.lit(0)).alias("languages"))


def segment_languages(jobs: DataFrame, documents: DataFrame, models: CharModels | None = None) -> DataFrame:
    """`id, line_no, chars, lang, confidence` of each line of LEAST_CHARS characters or more, `und` where it is rejected. Repeated rows count once."""
    models = models or train(sample_lines(documents, jobs))
    return judged_lines(jobs, models).select("id", "line_no", "chars", "lang", F.round("confidence", 6).alias("confidence")).distinct()
