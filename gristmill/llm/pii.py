"""Personal data in free text: found, and replaced with typed placeholders.

E-mail addresses, phone numbers, identity numbers and street addresses have a form of their own and are read by it. Names have none: what
tells of a person is estimated from co-occurrence over the whole corpus, in bits. A mention of a capitalised term co-occurs with a protected
entity if its letters stand in an e-mail address of the same text, or if it follows a title; within the name of a firm it is certain to be no person's. A first, light pass counts how often each term
does; terms that are frequent and never do, as common words and labels, disclose nothing. The second pass writes down each text's findings
of form, and each mention of another term with what stands before and behind it. From the few certain cases the disclosure of each term is
counted (how many bits its presence adds to the belief that a person is named), from the terms that of each place (the words before, the
words or the finding behind), and from the places that of the terms again, so that a name counts that no address spells out. A mention whose
bits from term and place pass the threshold is a person's, together with the terms beside it that do not speak against it; it is
generalised to a placeholder.

The phrases in SEEDS ("Dear", "Name:") are a prior for places: they count as PRIOR observations beside those of the corpus, so that a
corpus too small for counts has something to go by, and in a larger one weigh little.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

KINDS = ("email", "phone", "id_number", "address", "name")

_AT, _DOT = r"(?:\s?@\s?|\s?[\[(](?:at|AT|arobase)[\])]\s?|\sAT\s)", r"(?:\.|\s?[\[(](?:dot|DOT|point)[\])]\s?|\sDOT\s)"
_AT_SIGN, _MAIL_REST = re.compile(_AT), re.compile(rf"{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_AT_MARKS = ("@", "(at)", "[at]", "(AT)", "[AT]", "(arobase)", "[arobase]", " AT ")
_DIGIT = re.compile(r"\d")
_WORD_AT = re.compile(r"(?<!\w)\w")
_FIGURES = re.compile(r"\d[\d ().\-/]{4,}\d")
_PERMIT = re.compile(r"\d(?<!\w\d)\d[A-Z]{2}\d{5}(?!\w)")
_LEFT, _RIGHT = re.compile(r"(?:\(?\+|\(|(?<!\w)[A-Z]{1,2}[ -]?)$"), re.compile(r"[ -]?[A-Z]{1,2}(?!\w)")
# Phone numbers by form, on a run of figures and marks.
_PHONE = re.compile(
    r"(?:\(?\+\d{1,3}\)?|00[1-9]\d?)(?:[ .\-/]*\(0\))?[ .\-/]*\d(?:[ .\-/]{0,3}\d){6,11}"  # with a country code
    r"|\(0\d{2,4}\) ?\d{3,4}[ -]?\d{3,4}|\(\d{3}\) ?\d{3}[ -]\d{4}"  # area in brackets
    r"|07\d{3} ?\d{6}|0[1-9](?P<sep>[ .-]?)\d\d(?:(?P=sep)\d\d){3}|0\d{2,4}(?: |/| / )(?=(?:\d[ -]?){7,9}$)\d{5,8}(?:[ -]?\d{2,4})?"  # national, led by 0
    r"|\d{3}(?P<dash>[-. ])\d{3}(?P=dash)\d{4}|1[2-9]\d{2}[2-9]\d{6}"  # ten figures, or eleven led by 1
    r"|[06-9]\d{2}(?:[ .-]?\d{3}){2}|[06-9]\d{2}(?:[ .-]\d\d){3}"  # nine figures
)
# Identity numbers by form: national insurance, social security, tax, passports, permits.
_ID = re.compile(
    r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{3}([- ])\d\d\1\d{4}|[12]([ .]?)\d\d\2\d\d\2\d[\dAB]\2\d{3}\2\d{3}(?:[ ./]?\d\d)?"
    r"|[A-Z]{2}\d{7}|\d{7}[A-Z]{2}|\d\d[A-Z]{2}\d{5}|[XYZ]-?\d{7}-?[A-Z]|\d{2}\.?\d{3}\.?\d{3}-?[A-Z]|\d\d([ /]?)\d{3}\3\d{3}\3\d{3}"
)
_FIRM_NUMBER = re.compile(r"\d{3} \d{3} \d{3} \d{5}")
_CALL_WORD = re.compile(r"phone|called|call|tel|cell|mobil|gesprochen|rang|appel|joignable|portable|llam", re.I)
_ID_WORD = re.compile(r"(?:nummer|steuer|number|numéro|número|carné|ausweis|documento|sécurité|\bid\b|tax|pièce)[^\n]{0,14}$", re.I)

_C = r"[A-ZÀ-ÖØ-Þ]"
_W = rf"{_C}[^\W\d]*(?:['’-][^\W\d]+)*"
_CITY = rf"{_C}[^\W\d]+(?:-[^\W\d]+)*(?: {_C}[^\W\d]+(?![\w]))?"
_EN_STREET = "Road|Rd|Street|St|Lane|Ln|Close|Way|Avenue|Ave|Hill|Crescent|Cres|Drive|Court|Place|Square|Terrace|Gardens|Grove|Mews|Row|Walk"
_FR_STREET = "rue|impasse|avenue|av\\.|bd\\.?|boulevard|place|allée|chemin|quai|cours|route|square|passage|r\\."
_FR_OF = "(?:de la |de l'|des |du |de |d'|aux |au |à la |à l')?"
ADDRESSES = (
    re.compile(rf"(?<!\w)(?:(?:Flat|Apt|Apartment|Unit) \d{{1,4}}\w?, )?\d{{1,4}}[A-Za-z]?,? (?:{_C}[\w'’.-]* ){{1,3}}?(?:{_EN_STREET})\b\.?(?!['’])(?:, {_CITY}(?: [A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}})?)?"),
    re.compile(rf"(?<!\w)(?:(?:[Aa]ppt|[Aa]pt|[Aa]ppartement)\.? ?\w+, )?\d{{1,4}}(?: ?(?:bis|ter|quater|BIS|TER))?,? (?i:{_FR_STREET}) {_FR_OF}{_W}(?: {_C}[\w'’-]+)?(?:, bât\. \w+)?(?:(?:, | - )\d{{5}} {_CITY})?"),
    re.compile(rf"(?<![\w-])(?:{_W}(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer)|{_W} (?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz|Ring|Damm|Ufer)|(?:Am|Im|An der|Auf dem|Zum|Zur) {_W}(?: {_W})?) \d{{1,4}} ?[a-z]?(?!\w)(?:, (?:D-)?\d{{5}} {_CITY})?"),
    re.compile(rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Pza\.|Paseo|Ronda|Camino|Travesía|Carretera) (?:de la |de las |de los |del |de )?{_W}(?: {_W})?,?(?: n\.º| nº| núm\.)? \d{{1,4}}(?!\d)(?:, (?:\d+\.º \w+|bajo))?(?:, \d{{5}} {_CITY})?"),
)

_PARTICLES = ("de la", "de las", "de los", "de", "du", "del", "des", "von der", "von", "van der", "van", "di", "da")
_PARTICLE_WORDS = {w for p in _PARTICLES for q in (p, p.upper(), p.capitalize()) for w in q.split(" ")}
_TOKEN = rf"(?:{_C}\.(?!\w)|(?:{_C}['’])?{_C}[^\W\d]*(?:-(?:{_C}['’])?{_C}[^\W\d]*)*(?!\w))"
# _TOKEN where no word goes on before it; a capital stands first in the pattern, so that the search leaps from one to the next.
_MENTION = re.compile(rf"{_C}(?<![\w'’\-].)(?:\.(?!\w)|(?:['’]{_C})?[^\W\d]*(?:-(?:{_C}['’])?{_C}[^\W\d]*)*(?!\w))")
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Dr.", "Prof.", "Mme", "Mlle", "M.", "Monsieur", "Madame", "Herr", "Herrn", "Frau", "Sr.", "Sra.", "Don", "Doña", "Señor", "Señora", "Sir", "Mr.", "Mrs.", "Ms.")
_TITLE_WORDS = frozenset(w for t in TITLES if t != "M." for w in (t, t.rstrip(".")))
_LOWER = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]+)* [^\W\d_]{2,}(?:-[^\W\d_]+)*(?![\w@.])")
# Prior places. before: what leads to a name; behind: what follows one.
SEEDS = {
    "before": ("Name:", "Name :", "Nom :", "Nom:", "Nombre:", "Curriculum vitae of", "CV de", "CV of", "Currículum de", "Lebenslauf von", "spoke with", "According to", "D'après", "Según", "Laut", "ask for", "contact =>", "contacto =>", "Kontakt =>",
               "Present:", "Présents :", "Présents:", "Presentes:", "Anwesend:", "Dear", "Bonjour", "Hola", "Hallo", "Cher", "Chère", "Best,", "Kind regards,", "Regards,", "Un saludo,", "Cordialement,", "Grüßen", "Yours sincerely,", "Cheers,", "Atentamente,"),
    "behind": ("<email>", "<phone>", "<address>", "<id_number>"),
}
#: What a prior place counts as: so many observations, of which so many persons. A finding beside a mention is weaker: labels stand there too.
PRIOR = {"before": (8.0, 7.0), "behind": (3.0, 0.5)}
#: A term or place is judged from so many observations on; of those in fewer than SHARE of the texts, terms that disclose a person are joined, not broadcast.
#: What speaks against a person must have been seen AGAINST times.
SUPPORT, AGAINST, SHARE = 5, 20, 1e-4
#: Terms in this share of the texts are common words, unless they co-occur with addresses.
COMMON = 5e-3
#: Bits from which a term alone counts as disclosing, or as speaking against a person.
THRESHOLD_BITS, VETO_BITS = 2.0, -4.0


# Words that betray an address by language pattern, and marks of firms.
_STREETS = (
    tuple(" " + w for w in _EN_STREET.split("|")),
    ("rue ", "impasse ", "avenue ", "av. ", "bd ", "bd. ", "boulevard ", "place ", "allée ", "chemin ", "quai ", "cours ", "route ", "square ", "passage ", "R. ", "Rue ", "RUE ", "Avenue ", "AVENUE ", "Boulevard ", "Place ", "Impasse ", "Quai ", "Allée ", "Chemin ", "Cours "),
    ("straße ", "strasse ", "str. ", "weg ", "allee ", "gasse ", "platz ", "ring ", "damm ", "ufer ", "Straße ", "Strasse ", "Str. ", "Weg ", "Allee ", "Gasse ", "Platz ", "Ring ", "Damm ", "Ufer ", "Am ", "Im ", "An der ", "Auf dem ", "Zum ", "Zur "),
    ("Calle ", "C/ ", "Avenida ", "Avda. ", "Av. ", "Plaza ", "Pza. ", "Paseo ", "Ronda ", "Camino ", "Travesía ", "Carretera "),
)
_FIRM_MARKS = ("Consulting", "Conseil", "Services", "Solutions", "Systems", "Systèmes", "Engineering", "Technologies", "International", "Partners", "Informatique", "GmbH", "AG", "SAS", "Ltd", "Group", "et Associés", "& Associés", "& Associates")
_BEFORE_FIRM = re.compile(rf"(?:{_TOKEN} ){{1,3}}$")
_CABINET, _AND = re.compile(rf"Cabinet (?:{_TOKEN} ?){{1,3}}"), re.compile(rf" & {_TOKEN}")


def _automaton() -> ahocorasick.Automaton:
    """Everything that is looked for by its letters, in one automaton: a text is scanned once."""
    words: dict[str, list[tuple[str, object]]] = {}
    for k, streets in enumerate(_STREETS):
        for w in streets:
            words.setdefault(w, []).append(("street", k))
    for w in _AT_MARKS:
        words.setdefault(w, []).append(("mail", None))
    for w in _FIRM_MARKS:
        words.setdefault(" " + w, []).append(("firm", "mark"))
    words.setdefault("Cabinet ", []).append(("firm", "cabinet"))
    words.setdefault(" & ", []).append(("firm", "and"))
    a = ahocorasick.Automaton()
    for w, what in words.items():
        a.add_word(w, (len(w), tuple(what)))
    a.make_automaton()
    return a


def scan(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int, object]]]:
    """What the automaton finds, by sort: (start, end, detail)."""
    out: dict[str, list[tuple[int, int, object]]] = {"street": [], "mail": [], "firm": []}
    for end, (n, whats) in automaton.iter(text):
        for sort, detail in whats:
            out[sort].append((end + 1 - n, end + 1, detail))
    return out


def formal_spans(text: str, hits: dict[str, list[tuple[int, int, object]]]) -> list[tuple[int, int, str]]:
    """E-mail addresses, street addresses, phone and identity numbers, without overlaps, the earlier kind first."""
    spans: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= s or e <= a for s, e, _ in spans)

    for start, _, _ in hits["mail"]:
        at = start - 1 if start and text[start - 1] in " \t" and text[start] != " " else start
        rest = _MAIL_REST.match(text, at) or _MAIL_REST.match(text, start)
        a = at
        while a and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        if rest and a < at and (text[at - 1].isalnum() or text[at - 1] == "_") and free(a, rest.end()):
            spans.append((a, rest.end(), "email"))
    tried: dict[int, int] = {}
    for start, end, k in hits["street"]:
        # The pattern is tried at each of the words before the street word, of which an address has so many at most, and must cover it.
        left = max(_words_back(text, start, 9), tried.get(k, 0))
        if k < 2 and not _DIGIT.search(text, left, start):
            # The house number stands before the street in these.
            continue
        for w in _WORD_AT.finditer(text, left, end):
            m = ADDRESSES[k].match(text, w.start())
            if m and m.end() >= end - 1 and free(*m.span()):
                spans.append((*m.span(), "address"))
                tried[k] = m.end()
                break
    for m in _FIGURES.finditer(text):
        kind, (a, b) = _number_kind(text, *m.span())
        if kind and free(a, b):
            spans.append((a, b, kind))
    spans += [(m.start(), m.end(), "id_number") for m in _PERMIT.finditer(text) if free(*m.span())]
    return sorted(spans)


def _words_back(text: str, at: int, n: int) -> int:
    """Where the `n` words before a place begin, in the same line."""
    line = text.rfind("\n", 0, at) + 1
    for _ in range(n):
        at = text.rfind(" ", line, at)
        if at < 0:
            return line
    return at + 1


def _number_kind(text: str, a: int, b: int) -> tuple[str | None, tuple[int, int]]:
    """What a run of figures is, and its exact extent; letters and brackets beside it count only if the form wants them."""
    while not text[b - 1].isdigit():
        b -= 1
    run = text[a:b]
    if _FIRM_NUMBER.fullmatch(run) or text[b : b + 1].isdigit() or (a and text[a - 1] in "/.-" and text[a - 2 : a - 1].isdigit()):
        return None, (a, b)
    left = _LEFT.search(text[max(0, a - 3) : a])
    right = _RIGHT.match(text, b)
    starts = [a - len(left[0]), a] if left else [a]
    ends = [right.end(), b] if right else [b]
    for s in starts:
        for e in ends:
            if (s and text[s - 1].isalnum()) or text[e : e + 1].isalnum():
                continue
            form = text[s:e]
            phone, ident = _PHONE.fullmatch(form), _ID.fullmatch(form)
            if phone and ident:
                before = text[max(text.rfind("\n", 0, s), text.rfind(". ", 0, s)) + 1 : s]
                phone = None if _ID_WORD.search(before) and not _CALL_WORD.search(before) else phone
            if phone and not (form.startswith("(") and ")" not in form):
                return "phone", (s, e)
            if ident:
                return "id_number", (s, e)
    return None, (a, b)


def firm_extents(text: str, company: str | None, hits: dict[str, list[tuple[int, int, object]]]) -> list[tuple[int, int]]:
    """Extents that belong to names of firms: the document's own, and what stands beside a firm's marks."""
    out = []
    if company and company.strip():
        name, at = company.strip(), 0
        low, name = text.lower(), name.lower()
        while len(low) == len(text) and (at := low.find(name, at)) >= 0:
            out.append((at, at + len(name)))
            at += len(name)
    for start, end, mark in hits["firm"]:
        if mark == "cabinet":
            if m := _CABINET.match(text, start):
                out.append(m.span())
            continue
        if text[end : end + 1].isalnum() and mark == "mark":
            continue
        left = _words_back(text, start, 3)
        m = _BEFORE_FIRM.search(text[left:start] + " ")
        if m:
            a = left + m.start()
            if mark == "mark":
                out.append((a, end))
            elif n := _AND.match(text, start):
                out.append((a, n.end()))
    return out


_ACCENTS = str.maketrans("àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def _plain(word: str) -> str:
    return word.lower().translate(_ACCENTS)


# What is written down of a text: its findings of form, and of each mention its term, place and (in `at`, a row of int32 a mention) start, stop, how
# it hangs together with the one before (1: a blank or particle between them, 2: a comma), whether it certainly names a person, and where it starts if
# a particle before it is its own, with the place it has then (`outer`). Strings are joined by _SEP, so that a text is some few values and not hundreds.
_SEP, _FIELDS = "\x1f", 5
NOTED = "forms binary, kinds string, term string, before string, behind string, outer string, at binary"


def _words_before(text: str, at: int) -> str:
    """The two words before a place, in lower case."""
    i = text.rfind(" ", 0, at - 1) if at > 1 else -1
    i = text.rfind(" ", 0, i) if i > 0 else -1
    return text[i + 1 : at].lower()


def _mail_parts(addresses: list[str]) -> list[str]:
    """The parts of the local parts of addresses, plain."""
    return [p for x in addresses for p in re.split(r"[^a-z]+", _plain(_AT_SIGN.split(x, 1)[0])) if p]


def _spelled(word: str, mails: list[str], joined: str) -> bool:
    """Whether an address spells a word out. Short words count as a part of it or at the start of one only."""
    w = word.lower()
    if not (w.isascii() and w.isalpha()):
        w = re.sub(r"[^a-z]", "", _plain(w))
    if len(w) < 3 or w not in joined:
        return False
    return len(w) > 4 or any(w == x or len(w) == 4 and x.startswith(w) for x in mails)


def silent_terms(documents: DataFrame) -> frozenset[str]:
    """The terms that stand in a share of the texts and never co-occur with an address that spells them out, though by their number they should.

    Every text is counted. What is collected are terms in max(AGAINST, COMMON x texts) texts or more: at most (terms a text) / COMMON, however large the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter[str] = Counter()
            certain: Counter[str] = Counter()
            for text in b["text"]:
                if not text:
                    continue
                low = {w.lower() for w in set(_MENTION.findall(text))}
                mails = _mail_parts([text[max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start()), text.rfind(";", 0, m.start())) + 1 : m.start()] for m in _AT_SIGN.finditer(text)]) if any(x in text for x in _AT_MARKS) else []
                seen.update(low)
                if mails:
                    joined = " ".join(mails)
                    certain.update(w for w in low if _spelled(w, mails, joined))
            if seen:
                yield pd.DataFrame({"term": list(seen), "n": list(seen.values()), "s": [certain[w] for w in seen]}).astype({"n": "int64", "s": "int64"})

    counts = cut(documents.select(F.col("text").cast("string")).mapInPandas(count, "term string, n bigint, s bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = documents.where("text <> ''").count()
    t = counts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not t["n"]:
        return frozenset()
    base = math.log2((t["s"] + 1) / (t["n"] - t["s"] + 10))
    share = 1 / (1 + 2.0**-base)
    odds = F.log2((F.col("s") + 2 * share) / (F.col("n") - F.col("s") + 2 * (1 - share)))
    silent = counts.where((F.col("n") >= max(AGAINST, COMMON * total)) & (odds - base <= VETO_BITS) & ~F.col("term").endswith("."))
    return frozenset(r["term"] for r in silent.select("term").collect())


def read_text(text: str, company: str | None, automaton: ahocorasick.Automaton, silent: frozenset[str] = frozenset()) -> tuple[list[tuple[int, int, str]], list[str], list[str], list[str], list[str], list[int]]:
    """Findings of form; terms, places before and behind, places before a particle; _FIELDS numbers a mention."""
    hits = scan(text, automaton)
    spans = formal_spans(text, hits)
    firms = sorted(firm_extents(text, company, hits))
    closed = sorted([*((a, b, 0) for a, b, _ in spans), *((a, b, 1) for a, b in firms)])
    closed.append((len(text) + 1, len(text) + 1, 0))
    mails = _mail_parts([text[a:b] for a, b, k in spans if k == "email"])
    joined = " ".join(mails)
    terms, befores, behinds, outers, numbers = [], [], [], [], []
    last, titled, shut, form, reach = -9, False, 0, 0, [0, 0]
    nearest = spans[0][0] if spans else 1 << 60
    find, rfind = text.find, text.rfind
    for m in _MENTION.finditer(text):
        a, b = m.span()
        while closed[shut][0] < b:
            reach[closed[shut][2]] = max(reach[closed[shut][2]], closed[shut][1])
            shut += 1
        if reach[0] > a:
            continue
        word = m[0]
        # "M." is a title or an initial: it stays a mention, and what follows it is sure.
        if word in _TITLE_WORDS:
            titled, last = True, -9
            continue
        term = word.lower()
        if term in silent:
            titled = False
            continue
        gap = a - last
        if gap == 1 and word in _PARTICLE_WORDS and text[last] == " ":
            # A particle in capitals is a link, no term.
            last = b
            continue
        link = 0
        if last >= 0 and 0 < gap < 14:
            between = text[last:a]
            link = 1 if between == " " or between[0] == " " and all(w in _PARTICLE_WORDS for w in between.split()) else 2 if between == ", " else 0
        i = rfind(" ", 0, a - 1) if a > 1 else -1
        start, outer, lead, sure = a, "", a, False
        if titled or link == 1 or text[i + 1 : a - 1] in _PARTICLE_WORDS or text[rfind("\n", 0, a) + 1 : a - 1] in _PARTICLE_WORDS:
            # Particles before a mention belong to it behind a title, and where no word stands before them.
            j = a
            while j > 1 and text[j - 1] == " " and (q := max(rfind(" ", 0, j - 1), rfind("\n", 0, j - 1)) + 1) < j and text[q : j - 1] in _PARTICLE_WORDS:
                j = q
            head = text[j - 12 if j > 12 else 0 : j].rstrip(" \t\n")
            after_m = link == 1 and terms[-1] == "m."
            sure = titled and head.endswith(TITLES) or after_m
            if j < a and (not link and (sure or not head[-1:].isalnum()) or after_m):
                start = lead = j
            elif j < a and not link:
                outer, lead = _words_before(text, j), j
            titled = False
        if start == a:
            i = rfind(" ", 0, i) if i > 0 else -1
            before = text[i + 1 : a].lower()
        else:
            before = _words_before(text, start)
        while nearest < b:
            form += 1
            nearest = spans[form][0] if form < len(spans) else 1 << 60
        if nearest - b <= 6 and not any(c.isalnum() for c in text[b:nearest]):
            behind = f"<{spans[form][2]}>"
        else:
            e = find(" ", b + 1)
            e = find(" ", e + 1) if e > 0 else e
            behind = text[b:e].lower() if e > 0 else text[b:].lower()
            if "\n" in behind:
                behind = behind[: behind.index("\n") + 1]
        if reach[1] > a:
            # A firm's: as certain a case of no person.
            sure = -1
        elif mails and not sure:
            sure = _spelled(word, mails, joined)
        terms.append(term)
        befores.append(before)
        behinds.append(behind)
        outers.append(outer)
        numbers += (start, b, link, sure, lead)
        last = b
    return spans, terms, befores, behinds, outers, numbers


def mentions(documents: DataFrame, *kept: str) -> DataFrame:
    """`doc_id`, the columns of NOTED and those `kept`: what each text holds."""

    held = documents.sparkSession.sparkContext.broadcast(silent_terms(documents))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, silent = _automaton(), held.value
        for b in batches:
            rows = []
            for text, company in zip(b["text"], b["company"]):
                if not text:
                    rows.append((b"", "", "", "", "", "", b""))
                    continue
                spans, *words, numbers = read_text(text.replace(_SEP, " "), company, automaton, silent)
                rows.append((np.array([x[:2] for x in spans], np.int32).tobytes(), _SEP.join(k for _, _, k in spans), *map(_SEP.join, words), np.array(numbers, np.int32).tobytes()))
            noted = pd.DataFrame(rows, columns=["forms", "kinds", "term", "before", "behind", "outer", "at"], index=b.index)
            yield pd.concat([b[["doc_id", *kept]], noted], axis=1)

    have = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("company").cast("string"))
    return have.mapInPandas(read, "doc_id bigint, " + "".join(f"{c} string, " for c in kept) + NOTED)


def place_keys(side: str, text: str) -> list[str]:
    """The places a string stands for, the longest first: two words before, one, the marks alone; two words behind, one, the marks alone."""
    words = text.split(" ")
    if side == "before":
        # The last word may stand before a blank or before the mention itself.
        n = len(words) - (not words[-1])
        marks = text[len(text.rstrip("\n\t .,;:()<>=|/-!?\"'’")) :]
        keys = [f"before{2 - k} {' '.join(words[n - k :])}" for k in (2, 1) if n >= k]
        return keys + ([f"before2 {marks}"] if marks.strip(" ") else [])
    one = words[0] if words[0] or len(words) == 1 else " " + words[1]
    marks = text[: len(text) - len(text.lstrip("\n\t .,;:()<>=|/-!?\"'’"))]
    return [f"behind0 {text}", *([f"behind1 {one}"] if one != text else []), *([f"behind2 {marks}"] if marks.strip(" ") else [])] if text else []


class Judge:
    """Bits of terms and places. `terms`: term to log odds of a person; `places`: key to bits; `base`: log odds of any mention."""

    def __init__(self, terms: dict[str, float], places: dict[str, float], base: float):
        self.terms, self.places, self.base = terms, places, base
        self.memo: dict[str, dict[str, float]] = {"before": {}, "behind": {}}

    def place(self, side: str, text: str) -> float:
        """Bits of the longest place that has been judged."""
        memo = self.memo[side]
        if (x := memo.get(text)) is not None:
            return x
        x = 0.0
        for key in place_keys(side, text):
            if (y := self.places.get(key)) is not None:
                x = y
                break
        if len(memo) > 200_000:
            memo.clear()
        memo[text] = x
        return x

    def names(self, terms: list[str], before: list[str], behind: list[str], outer: list[str], start: list[int], stop: list[int], link: list[int], sure: list[int], lead: list[int], rare: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
        """Extents of the mentions of persons."""
        n, base, first, then = len(terms), self.base, self.memo["before"], self.memo["behind"]
        known, person, led = [], [], []
        for k in range(n):
            initial, odds = terms[k][-1] == ".", self.terms.get(terms[k])
            if odds is None and "-" in terms[k]:
                odds = max((o for w in terms[k].split("-") if (o := self.terms.get(w)) is not None), default=None)
            if odds is None and terms[k] in rare:
                odds = base + THRESHOLD_BITS
            lean = 0.0 if odds is None or initial else odds - base
            told = lean >= THRESHOLD_BITS
            led.append(x if (x := first.get(before[k])) is not None else self.place("before", before[k]))
            bits = led[k] + (x if (x := then.get(behind[k])) is not None else self.place("behind", behind[k]))
            known.append(1 if told else -1 if lean <= -THRESHOLD_BITS else 0)
            # A term that speaks against a person is one's only in a place where hardly anything else stands.
            if sure[k] < 0:
                known[k] = -1
                person.append(False)
                continue
            person.append(sure[k] and known[k] >= 0 or (told and bits > -2 * THRESHOLD_BITS) or (known[k] == 0 and base + bits + lean >= 0) or (known[k] < 0 and base + led[k] >= THRESHOLD_BITS / 2))
        if not any(person):
            return []
        # What hangs together with a person's term and does not speak against it belongs to the mention.
        for order in (range(1, n), range(n - 2, -1, -1)):
            for k in order:
                j = k - 1 if order.step > 0 else k + 1
                if person[k] or not person[j] or link[max(j, k)] != 1 or (terms[k] == "m." and j > k):
                    continue
                # A blank links to either side, a particle to what stands before a surname.
                near = start[max(j, k)] - stop[min(j, k)] == 1
                person[k] = (known[k] >= 0 and (near or known[k] == 1 or j < k or terms[k][-1] == ".")) or (known[k] < 0 and sure[k] == 0 and known[j] < 0 and near and j < k)
        out: list[list] = []
        for k in range(n):
            # "Last, First" is one mention where a name may begin, if the last name stands alone and is none that is known from elsewhere.
            line = not before[k] or before[k][-1] == "\n"
            fresh = line or (base + max(led[k], self.place("before", outer[k]) if outer[k] else led[k]) >= 0 and not before[k].rstrip().endswith(","))
            pair = k + 1 < n and link[k + 1] == 2 and link[k] != 1 and fresh and sure[k] >= 0 and (known[k] == 0 or known[k] < 0 and (person[k] or line) or sure[k] > 0)
            if pair and (known[k + 1] == 1 or person[k + 1] and (person[k] or line)) and not (out and out[-1][2] == k):
                e = k + 1
                while e + 1 < n and link[e + 1] == 1 and person[e + 1] and start[e + 1] - stop[e] == 1:
                    e += 1
                out.append([lead[k] if outer[k] and base + self.place("before", outer[k]) >= 0 else start[k], stop[e], e])
            elif person[k] and not (out and out[-1][2] >= k):
                if out and link[k] == 1 and out[-1][2] == k - 1:
                    out[-1][1:] = [stop[k], k]
                else:
                    own = outer[k] and known[k] < 1 and base + self.place("before", outer[k]) >= 0
                    out.append([lead[k] if own else start[k], stop[k], k])
        return [(a, b) for a, b, k in out if not (b - a == 2 and terms[k][-1] == ".")]


def _odds(p: float, q: float, base: float) -> float:
    """Log odds of p against q in bits, two observations at the base rate added."""
    share = 1 / (1 + 2.0**-base)
    return math.log2((p + 2 * share) / (q + 2 * (1 - share)))


def _prior_places() -> dict[str, tuple[float, float]]:
    """(persons, others) of the places in SEEDS."""
    out = {}
    n, p = PRIOR["before"]
    for phrase in SEEDS["before"]:
        for end in (" ", "\n"):
            out[place_keys("before", " ".join(phrase.lower().split(" ")[-2:]) + end)[0]] = (p, n - p)
    n, p = PRIOR["behind"]
    for word in SEEDS["behind"]:
        out[f"behind0 {word}"] = (p, n - p)
    return out


def learned(noted: DataFrame, rounds: int = 2) -> tuple[Judge, DataFrame]:
    """(the bits of terms and places that occur in a share of the texts, the rarer terms that disclose a person as `term`).

    What is collected and broadcast: terms and places seen at least max(SUPPORT, SHARE x texts) times, so at most (mentions a text) x 8 / SHARE,
    however large the corpus. Rarer terms from SUPPORT on are judged alike and stay on the cluster.
    """
    spark = noted.sparkSession
    total = noted.where("term <> ''").count()
    least = max(SUPPORT, SHARE * total)

    columns = noted.select("term", "before", "behind", "at")

    def rows(b: pd.DataFrame) -> Iterator[tuple[list[str], list[str], list[str], list[int]]]:
        """Terms, places and sureness of the mentions of each text."""
        for term, before, behind, at in zip(b["term"], b["before"], b["behind"], b["at"]):
            if term:
                yield term.split(_SEP), before.split(_SEP), behind.split(_SEP), np.frombuffer(at, np.int32)[3::_FIELDS].tolist()

    def summed(yes: dict[str, float], no: dict[str, float], names: tuple[str, str, str]) -> Iterator[pd.DataFrame]:
        if no:
            yield pd.DataFrame({names[0]: pd.Series(list(no), dtype=object), names[1]: pd.Series(list(no.values()), dtype=float), names[2]: pd.Series([yes.get(k, 0.0) for k in no], dtype=float)})

    def by_term(batches: Iterator[pd.DataFrame], held=None) -> Iterator[pd.DataFrame]:
        """How often each term stands, and how often as a person's: where it certainly is, or where its place says so."""
        judge, never = held.value if held else (None, frozenset())
        for b in batches:
            n: dict[str, float] = {}
            s: dict[str, float] = {}
            for terms, before, behind, sure in rows(b):
                for t, l, r, x in zip(terms, before, behind, sure):
                    n[t] = n.get(t, 0.0) + 1
                    if x >= 0 and (x > 0 if judge is None else t not in never and (x > 0 or judge.base + judge.place("before", l) + judge.place("behind", r) >= 0)):
                        s[t] = s.get(t, 0.0) + 1
            yield from summed(s, n, ("term", "n", "s"))

    def terms_of(held=None) -> DataFrame:
        each = columns.mapInPandas(lambda batches: by_term(batches, held), "term string, n double, s double")
        return cut(each.groupBy("term").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))

    prior = _prior_places()
    priors = spark.createDataFrame([(k, p, q) for k, (p, q) in prior.items()], "key string, p double, q double")
    judge = Judge({}, {}, -4.0)

    def odds(base: float) -> Column:
        share = 1 / (1 + 2.0**-base)
        return F.log2((F.col("s") + 2 * share) / (F.col("n") - F.col("s") + 2 * (1 - share)))

    by = terms_of()
    never: frozenset[str] = frozenset()
    for k in range(rounds + 1):
        t = by.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        if not t["n"]:
            return judge, by.select("term")
        base = math.log2((t["s"] + 1) / (t["n"] - t["s"] + 10))
        judged = by.where((F.col("n") >= SUPPORT) & ~F.col("term").endswith(".")).withColumn("odds", odds(base)).where((F.col("n") >= AGAINST) | (F.col("odds") >= base))
        common = {r["term"]: r["odds"] for r in judged.where(F.col("n") >= least).select("term", "odds").collect()}
        if k == rounds:
            return Judge(common, judge.places, base), judged.where((F.col("n") < least) & (F.col("odds") - base >= THRESHOLD_BITS)).select("term")
        if k == 0:
            # A term that is often there and never a certain case, as labels are, speaks against a person whatever place it stands in.
            never = frozenset(w for w, o in common.items() if o - base <= VETO_BITS)
        labels = spark.sparkContext.broadcast({w: int(o >= base) for w, o in common.items() if abs(o - base) >= THRESHOLD_BITS})

        def by_place(batches: Iterator[pd.DataFrame], labels=labels) -> Iterator[pd.DataFrame]:
            """Persons and others of each place. A term without a label counts where it certainly is one or the other, elsewhere half against."""
            told, memo = labels.value, {}
            for b in batches:
                p: dict[str, float] = {}
                q: dict[str, float] = {}
                for terms, before, behind, sure in rows(b):
                    for t, l, r, x in zip(terms, before, behind, sure):
                        label = told.get(t)
                        yes = 0.0 if x < 0 or label == 0 else 1.0 if label or x > 0 else 0.0
                        no = 0.0 if yes else 0.5 if label is None and x == 0 else 1.0
                        keys = memo.get((l, r))
                        if keys is None:
                            if len(memo) > 200_000:
                                memo.clear()
                            keys = memo[l, r] = ("", *place_keys("before", l), *place_keys("behind", r))
                        for key in keys:
                            q[key] = q.get(key, 0.0) + no
                        if yes:
                            for key in keys:
                                p[key] = p.get(key, 0.0) + yes
                yield from summed(p, q, ("key", "q", "p"))

        counts = columns.mapInPandas(by_place, "key string, q double, p double").unionByName(priors).groupBy("key").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        kept = {r["key"]: (r["p"], r["q"]) for r in counts.where((F.col("p") + F.col("q") >= least) | F.col("key").isin("", *prior)).collect()}
        p, q = kept.pop("", (0.0, 0.0))
        middle = math.log2((p + 1) / (q + 10))
        judge = Judge({}, {key: _odds(p, q, middle) - middle for key, (p, q) in kept.items()}, middle)
        by = terms_of(spark.sparkContext.broadcast((judge, never)))
    raise AssertionError("unreachable")


def findings(documents: DataFrame, *kept: str) -> DataFrame:
    """`doc_id, starts, stops, kinds` and the columns `kept`, a row a document: all findings in order, positions from 0.

    NULL and empty texts have none. Repeated rows have the same findings each.
    """
    noted = cut(mentions(documents, *kept))
    judge, rare = learned(noted)
    held = documents.sparkSession.sparkContext.broadcast(judge)
    # A text with rare disclosing terms gets them joined; where there are none, as in all but large corpora, nothing is shuffled.
    if rare.limit(1).count():
        row = noted.withColumn("row", F.monotonically_increasing_id())
        row = cut(row)
        own = row.select("row", F.explode(F.split("term", _SEP)).alias("term")).join(rare, "term").groupBy("row").agg(F.collect_set("term").alias("rare"))
        noted = row.join(own, "row", "left").drop("row")
    else:
        noted = noted.withColumn("rare", F.lit(None).cast("array<string>"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = held.value
        for b in batches:
            out: dict[str, list] = {"starts": [], "stops": [], "kinds": []}
            for forms, kinds, term, before, behind, outer, at, own in zip(*[b[c] for c in ("forms", "kinds", "term", "before", "behind", "outer", "at", "rare")]):
                found = [(x, y, k) for (x, y), k in zip(np.frombuffer(forms, np.int32).reshape(-1, 2).tolist(), kinds.split(_SEP))]
                if term:
                    numbers = np.frombuffer(at, np.int32).reshape(-1, _FIELDS).T.tolist()
                    names = judge.names(term.split(_SEP), before.split(_SEP), behind.split(_SEP), outer.split(_SEP), *numbers, frozenset() if own is None else frozenset(own))
                    found = sorted([*found, *((x, y, "name") for x, y in names)])
                for c, v in zip(out, zip(*found) if found else ([], [], [])):
                    out[c].append(list(v))
            yield b[["doc_id", *kept]].assign(**{c: pd.Series(v, index=b.index, dtype=object) for c, v in out.items()})

    return noted.mapInPandas(decide, "doc_id bigint, " + "".join(f"{c} string, " for c in kept) + "starts array<int>, stops array<int>, kinds array<string>")


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each finding replaced by a typed placeholder; nothing else changes."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def found_data(documents: DataFrame) -> DataFrame:
    """`doc_id, kind, start_pos` of each finding, once."""
    each = findings(documents).select("doc_id", F.explode(F.arrays_zip("starts", "kinds")).alias("f"))
    return each.select("doc_id", F.col("f.kinds").alias("kind"), (F.col("f.starts") + 1).cast("long").alias("start_pos")).distinct()


def redacted_texts(documents: DataFrame) -> DataFrame:
    """`doc_id, text`: every text, with placeholders for what was found."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [redact(t, list(zip(x.tolist(), y.tolist(), k.tolist()))) for t, x, y, k in zip(b["text"], b["starts"], b["stops"], b["kinds"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": pd.Series(texts, index=b.index, dtype=object)})

    return findings(documents, "text").mapInPandas(write, "doc_id bigint, text string")
