"""Operators for training data on small tables: edge cases, brute force, round trips and held-out accuracy."""

import itertools
import pathlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import entities, graph, langid, mixing, names, neardup, packing, pii, shingles, terms, tokens

JOB = "id string, title string, company string, location_raw string, date_posted string, description_text string, description_language string, technologies array<string>, end_client_sector string, company_info struct<industry:array<string>>, key string, text string, class int, n int"


def jobs(spark, rows):
    cols = [c.split(" ")[0] for c in re.sub(r"<[^,]*>+", "", JOB).split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], JOB)


def text_of(rng, n=60):
    return " ".join("".join(rng.choice("bdfklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


# -- terms


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame([(1, "sector", "banking", ["banque"]), (2, "sector", "insurance", None), (3, "technology", "Python", []), (4, "technology", "C++", []), (5, "technology", "Go", ["golang"]), (6, "industry", "IT Services", [])], "term_id bigint, kind string, label string, known_aliases array<string>")


def test_terms(spark, ref):
    rows = [
        {"id": "1", "end_client_sector": "banking", "technologies": ["Pyhton", " python ", "Python", None, "cpp", "golang."], "company_info": (["it servces", None],)},
        {"id": "2", "end_client_sector": "Banque ", "technologies": None}, {"id": "3", "end_client_sector": "", "technologies": [], "company_info": (None,)}, {"id": None, "end_client_sector": "bnking"}, {"id": "4", "end_client_sector": "beekeeping"},
        {"id": "5", "end_client_sector": "x" * 100_000},
    ]
    got = {(r["id"], r["kind"], r["raw_value"][:12]): r["term_id"] for r in terms.map_terms(jobs(spark, rows + rows), ref).collect()}
    assert got == {
        ("1", "technology", "Pyhton"): 3, ("1", "technology", " python "): 3, ("1", "technology", "cpp"): 4, ("1", "technology", "golang."): 5, ("1", "industry", "it servces"): 6,
        ("2", "sector", "Banque "): 1, ("3", "sector", ""): 0, (None, "sector", "bnking"): 1, ("4", "sector", "beekeeping"): 0, ("5", "sector", "x" * 12): 0,
    }
    assert terms.map_terms(jobs(spark, []), ref).count() == 0
    assert {r["term_id"] for r in terms.map_terms(jobs(spark, rows[1:2]), ref.limit(0)).collect()} == {0}


def test_pigeonhole_finds_every_slip(spark, ref):
    """Against brute force: all single slips of the longer labels."""
    rng = random.Random(3)
    values = {}
    for n, word in ((1, "banking"), (2, "insurance")):
        for _ in range(60):
            k = rng.randrange(len(word) - 1)
            values.setdefault(rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("xyz") + word[k:], word[:k] + word[k + 1] + word[k] + word[k + 2 :], word[:k] + "q" + word[k + 1 :]]), n)
    values = {v: n for v, n in values.items() if v not in ("banking", "insurance")}
    # Two slips in a long word count, in a short one they do not.
    values |= {"inzurxnce": 2, "insurrancee": 2, "bnkig": 0, "inzurxncy": 0}
    df = spark.createDataFrame([("sector", v) for v in values], "kind string, raw_value string")
    got = {r["raw_value"]: r["term_id"] for r in terms.map_values(df, terms.reference_spellings(ref, {})).collect()}
    assert got == values


# -- shingles, near-duplicates


def test_word_hashes_match_the_pattern():
    words = re.compile(r"[^\W_]+")
    texts = [None, "", "Été à Paris_2 -- x1", "\n\nA a", "É" * 3, "z" * 500_000 + " end", "a b"]
    got = list(shingles.word_hashes(texts))
    seen: dict[str, int] = {}
    for t, ids in zip(texts, got):
        w = words.findall((t or "").lower())
        assert len(w) == len(ids)
        for a, b in zip(w, ids.tolist()):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_bit_counts(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, 64), rng.integers(0, 256, 64)
    b[:40] = a[:40]
    packed = lambda x: [int(v) for v in np.bitwise_or.reduce(x.astype(np.uint64).reshape(-1, 8) << (np.arange(8, dtype=np.uint64) * np.uint64(8)), axis=1).view(np.int64)]
    df = spark.createDataFrame([(packed(a), packed(b))], "a array<bigint>, b array<bigint>")
    assert df.select(neardup.equal_cells(F.col("a"), F.col("b"), 8)).first()[0] == (a == b).sum()


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        words = text_of(rng).split()
        for k in range(4):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = "zz" + str(rng.random())[2:8]
            rows.append({"id": f"{g}-{k}", "description_text": " ".join(w)})
    rows += [{"id": f"copy{k}", "description_text": rows[0]["description_text"]} for k in range(5)] + [{"id": "null"}, {"id": "empty", "description_text": ""}, {"id": "short", "description_text": "two words"}, {"id": None, "description_text": "a b c d"}]
    rows += [{"id": "long", "description_text": text_of(rng, 30_000)}]
    sets = {r["id"]: set(zip(*[(w := r["description_text"].split())[k:] for k in range(3)])) for r in rows if r["id"] and r.get("description_text")}
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b]) and sets[a]}
    df = jobs(spark, rows + rows[:6])
    got = {tuple(r) for r in neardup.pairs_of_listings(df).collect()}
    assert got == want
    star = {tuple(r) for r in neardup.pairs_of_listings(df, most_copies=3).collect()}
    assert star < want and {("0-0", f"copy{k}") for k in range(5)} <= star
    groups = {r["id"]: (r["group_id"], r["class_id"]) for r in neardup.group_listings(df).collect()}
    assert set(groups) == {r["id"] for r in rows if r["id"] and r.get("description_text") is not None}
    assert all(groups[a][0] == groups[b][0] for a, b in want) and groups["copy1"] == groups["0-0"] and groups["0-0"][0] != groups["5-0"][0]
    assert neardup.pairs_of_listings(df.limit(0)).count() == 0


def test_large_bucket_is_compared_in_full(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 16).tolist()
    far = rng.integers(-(2**62), 2**62, 16).tolist()
    # Every class is signed twice, as by two tasks; one is in the bucket without being alike, one is alike without being in it.
    rows = [(k, base, [7, 100 + k]) for k in range(200)] * 2 + [(500, far, [7]), (501, base, [8])]
    classes = spark.createDataFrame(rows, "class bigint, cells array<bigint>, bands array<bigint>")
    for block, hot in ((16, 8), (1000, 8), (16, 1)):
        # With a low bound the bucket counts as hot, and its rows are dealt without being counted.
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(neardup, "RATE", 4)
        got = sorted((r["a"], r["b"]) for r in neardup.likely_pairs(classes, 128, 8, 0.4, block).collect())
        assert got == list(itertools.combinations(range(200), 2))


def test_disk_holds_one_round_of_bands(spark, monkeypatch):
    rng = np.random.default_rng(6)
    cells = rng.integers(-(2**62), 2**62, 16).tolist()
    # Each two neighbours share one band, a different one each.
    rows = [(k, cells, [k if b == k else k - 1 if b == k - 1 else 1000 * b + 100 + k for b in range(7)]) for k in range(8)]
    classes = spark.createDataFrame(rows, "class bigint, cells array<bigint>, bands array<bigint>")
    files = lambda: {f for f in pathlib.Path(spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())).parent.rglob("shuffle_*.data")}
    before, left = files(), []
    kept = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df: [kept(df), time.sleep(0.5), left.append(files() - before)][0])
    pairs = neardup.likely_pairs(classes, 128, 8, 0.4, 16, 3)
    # The hot buckets and the pairs of each round; what was shuffled for them is gone.
    assert len(left) == 6 and not any(left)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(k, k + 1) for k in range(7)]


def test_versions_of_a_text_that_most_rows_hold(spark):
    rng = random.Random(12)
    words = text_of(rng, 90).split()
    texts = {f"copy{k}": list(words) for k in range(60)}
    for k in range(90):
        w = texts[f"edit{k}"] = list(words)
        for at in rng.sample(range(90), 4):
            w[at] = f"zz{k}x{at}"
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in texts.items()}
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    got = {tuple(r) for r in neardup.pairs_of_listings(jobs(spark, [{"id": k, "description_text": " ".join(w)} for k, w in texts.items()])).collect()}
    assert got <= want and len(got) > 0.98 * len(want) and len(want) > 9_000


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- names


def test_names(spark):
    assert names.lcs_length("abcbdab", "bdcaba") == 4 and names.lcs_ratio("", "") == 0.0
    assert names.name_match(["vosepral", "breguvur"], ["breguvur", "vosepral", "sas"]) == "full"
    assert names.name_match(["n.", "bramestil"], ["nathaniel", "bramestil"]) == "full" and names.name_match(["flavretruth", "academy"], ["flavretruth", "figromer"]) == "like" and names.name_match(["dubro"], ["vekan"]) == "none"
    rows = [
        ("a", "dubrokem guvodath", "https://www.dub.test/x", 1980, "FR"), ("b", "doubrokem guvodath sas", "dub.test", None, None), ("c", "guvodath, dubrokem", None, 1980, None), ("d", "dubrokem academy", "acad.test", 1999, "FR"),
        ("e", "dubrokem guvodath", None, 1981, "DE"), ("f", None, None, None, None), ("g", "  ", None, None, None), ("a", "dubrokem guvodath", "https://www.dub.test/x", 1980, "FR"), ("h", "x" * 5000, None, None, None), (None, "dubrokem guvodath", None, None, None),
    ]
    df = spark.createDataFrame([(i, n, u, y, c, None, None, None, "clash") for i, n, u, y, c in rows], "company_id string, name string, homepage_url string, year_founded bigint, hq_country string, stock_symbol string, org_type string, size_employees bigint, cid string")
    assert {tuple(r) for r in names.variant_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    of = {r["company_id"]: r["organisation_id"] for r in names.organisations(df).collect()}
    assert of["a"] == of["b"] == of["c"] == "a" and of["d"] == "d" and set(of) == set("abcdeh")
    assert names.variant_pairs(df.limit(0)).count() == 0


def test_names_of_common_suffixes(spark):
    rng = random.Random(6)
    # Ninety firms whose names end alike and of which nothing else is known, two spellings of one among them; and seventy rows of one
    # organisation that all columns agree on.
    rows = [(f"n{k:02d}", "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) + " mechanika", None, None) for k in range(90)]
    rows += [("v1", "Torvalosk Mechanika", None, None), ("v2", "Mechanika, Torvalosk", None, None)]
    rows += [(f"o{k:02d}", f"Brunikel Mechanika{' SAS' * (k % 2)}", "brunikel.test", 1990) for k in range(70)]
    df = spark.createDataFrame([(i, n, u, y, None, None, None, None, None) for i, n, u, y in rows], "company_id string, name string, homepage_url string, year_founded bigint, hq_country string, stock_symbol string, org_type string, size_employees bigint, x string")
    got = {tuple(r) for r in names.variant_pairs(df).collect()}
    assert ("v1", "v2") in got and {(f"o{a:02d}", f"o{b:02d}") for a in range(70) for b in range(a + 1, 70) if (a + b) % 2} <= got
    rows = spark.createDataFrame([(k, ["w" + str(k), "mechanika"]) for k in range(40)], "nid bigint, words array<string>")
    assert names.names_that_meet(rows, block=8).count() == 780


def test_names_that_agree_all_meet(spark):
    """Against brute force: slips anywhere in a word, initials, abbreviations, stops, words joined and split, short and long words."""
    rng = random.Random(8)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou")
    word = lambda: "".join(syllable() for _ in range(rng.choice((1, 2, 3, 4, 5, 7)))) + rng.choice(("", "n", "rk"))

    def slip(w):
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            k = rng.randrange(len(w))
            w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("xyz") + w[k + 1 :])) or "a"
        return w

    some = []
    for _ in range(60):
        n = [word() for _ in range(rng.choice((1, 2, 2, 2, 3)))]
        some.append(n)
        for _ in range(5):
            m = [slip(w) for w in n]
            k = rng.randrange(len(m))
            m[k] = rng.choice((m[k], m[k], m[k][:1] + ".", m[k][:4] + ".", m[k][:2] + word(), m[k] + "."))
            rng.shuffle(m)
            some.append(rng.choice((m, m, m[:1], [*m, "sas"], ["".join(m)], [*m, word()])))
    some += [["ibm"], ["ibm", "sas"], ["sas", "ibm"], ["group"], ["the", "group"], ["group", "the"]]
    some = [list(x) for x in dict.fromkeys(tuple(x) for x in some)]
    df = spark.createDataFrame(list(enumerate(some)), "nid bigint, words array<string>")
    hosts = spark.createDataFrame([(0, "x"), (200, "x"), (3, None), (4, None)], "nid bigint, host string")
    met = {tuple(r) for r in names.names_that_may_agree(df, hosts, block=8).collect()}
    agree = {(i, j) for i, j in itertools.combinations(range(len(some)), 2) if names.name_match(some[i], some[j]) in ("full", "part")}
    assert len(agree) > 300 and agree <= met and (0, 200) in met and (3, 4) not in met
    assert len(met) < len(some) ** 2 / 8
    words = sorted({w for x in some for w in names.core_words(x)})
    match = {(x, y) for x, y in itertools.combinations(words, 2) if names._word_match(x, y) >= 0.8}
    assert {tuple(sorted(r)) for r in names.matching_words(spark.createDataFrame([(w,) for w in words], "word string"), block=8).collect()} == match


def test_companies_of_no_common_suffix(spark):
    rows = [
        ("a", "IBM", None, None), ("b", "I.B.M. SAS", None, None), ("c", "Torvalosk Brunikel", None, None), ("d", "Torvalosy Brunikex", None, None), ("e", "Vekadu Zorimo", "vek.test", None), ("f", "Vekady Zorimat", "vek.test", None),
        ("g", "Pelumak", None, 1990), ("h", "Pelumar Dovi", None, 1990), ("i", "Pelumar Kato", None, 1991), ("j", "BMW", None, 1916), ("k", "BMW", None, None), ("l", "日本", None, None), ("m", "日本電気", None, None),
    ]
    df = spark.createDataFrame([(i, n, u, y, *[None] * 4) for i, n, u, y in rows], "company_id string, name string, homepage_url string, year_founded bigint, hq_country string, stock_symbol string, org_type string, size_employees bigint")
    assert {(r["a"], r["b"]) for r in names.linked_companies(df).collect()} == {("c", "d"), ("e", "f"), ("g", "h"), ("j", "k")}


# -- entities


def test_entities(spark):
    rng = random.Random(5)
    left, right = [], []
    for k in range(40):
        words = text_of(rng, 40).split()
        left.append({"id": f"l{k:02d}", "title": "Sr Data Engineer", "company": f"Firma{'bdfgklmnp'[k % 9]}o{'bdfgk'[k % 5]}u SAS", "location_raw": "Paris", "date_posted": "2026-03-01", "description_text": " ".join(words)})
        if k % 2 == 0:
            right.append((f"r{k:02d}", "Senior Data Engineer (remote)", left[-1]["company"].upper(), "Paris, FR", "05/03/2026", " ".join(words[: 25 + k % 10])))
    left += [{"id": "null"}, {"id": "empty", "description_text": ""}, left[0]]
    right += [("rnull", None, None, None, None, None), ("rempty", "", "", "", "", ""), right[0], (None, "x", "x", "x", "x", "x")]
    r = spark.createDataFrame([(*x, "clash") for x in right], "jobid string, title string, companyname string, location string, publishedat string, description string, key string")
    got = entities.matched_openings(jobs(spark, left), r).collect()
    assert {(x["id"], x["jobid"]) for x in got} == {(f"l{k:02d}", f"r{k:02d}") for k in range(0, 40, 2)}
    assert all(0.5 <= x["confidence"] <= 1 for x in got)
    assert entities.matched_openings(jobs(spark, []), r).count() == 0
    days = spark.createDataFrame([("2026-03-05T01:00:00Z",), ("05/03/2026",), ("soon",), (None,)], "d string").select(entities.posting_day(F.col("d"))).collect()
    assert [str(x[0]) for x in days] == ["2026-03-05", "2026-03-05", "None", "None"]


def test_openings_of_a_text_that_many_rows_hold(spark):
    rng = random.Random(21)
    others = [text_of(rng, 40) for _ in range(10)]
    hot = text_of(rng, 40)
    posting = ("Data Engineer", "Acme Robotics", "Lyon", "2026-03-05")
    # Thirty listings of one text, title, firm and place: no attribute tells them from each other, and all have records on the other side.
    left = [{"id": f"l{k:02d}", "title": posting[0], "company": posting[1], "location_raw": posting[2], "date_posted": posting[3], "description_text": hot} for k in range(30)]
    left += [{"id": f"o{k}", "title": "Nurse", "company": f"Clinic {k} Lumo", "location_raw": "Nice", "date_posted": posting[3], "description_text": t} for k, t in enumerate(others)]
    right = spark.createDataFrame([(f"r{k:02d}", *posting, hot) for k in range(30)], "jobid string, title string, companyname string, location string, publishedat string, description string")
    got = entities.matched_openings(jobs(spark, left), right).collect()
    assert len(got) == 30 and {x["id"] for x in got} == {f"l{k:02d}" for k in range(30)} and {x["jobid"] for x in got} == {f"r{k:02d}" for k in range(30)}


def test_openings_of_one_firm_title_and_place_without_rare_words(spark):
    rng = random.Random(33)
    vocabulary = text_of(rng, 100).split()
    posting = ("Data Engineer", "Acme Robotics", "Lyon", "2026-03-05")
    left, right = [], []
    for k in range(60):
        # Every word stands in most texts; three of them are changed, so that two texts of an opening share most runs, though not always a band key.
        words = [rng.choice(vocabulary) for _ in range(60)]
        left.append({"id": f"l{k:02d}", "title": posting[0], "company": posting[1], "location_raw": posting[2], "date_posted": posting[3], "description_text": " ".join(words)})
        for at in rng.sample((10, 20, 30, 40, 50), 3):
            words[at] = vocabulary[vocabulary.index(words[at]) - 1]
        right.append((f"r{k:02d}", *posting, " ".join(words)))
    got = entities.matched_openings(jobs(spark, left), spark.createDataFrame(right, "jobid string, title string, companyname string, location string, publishedat string, description string")).collect()
    assert {(x["id"], x["jobid"]) for x in got} == {(f"l{k:02d}", f"r{k:02d}") for k in range(60)}


def test_one_to_one(spark):
    s = spark.createDataFrame([(a, b, c, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for a, b, c in (("x", "p", 0.9), ("x", "q", 0.8), ("y", "p", 0.85), ("y", "q", 0.6), ("z", "p", 0.9))], "a string, b string, confidence double, text double, rare_share double, title double, firm double, place double, date double")
    assert {(r["a"], r["b"]) for r in entities.one_to_one(s).collect()} == {("z", "p"), ("x", "q")}


def test_one_to_one_goes_on_until_no_pair_is_left(spark):
    tied = [(f"x{i:02d}", f"y{j:02d}", 0.9) for i in range(20) for j in range(20)]
    # Each pair of the chain has to wait for the one before.
    chain = [(f"c{k:02d}", f"d{k:02d}", 0.9 - 0.02 * k) for k in range(15)] + [(f"c{k + 1:02d}", f"d{k:02d}", 0.89 - 0.02 * k) for k in range(14)]
    s = spark.createDataFrame([(a, b, c, *[0.0] * 6) for a, b, c in tied + chain], "a string, b string, confidence double, text double, rare_share double, title double, firm double, place double, date double")
    for few in (0, 300, 1000):
        got = {(r["a"], r["b"]) for r in entities.one_to_one(s, few=few).collect()}
        assert got == {(f"x{k:02d}", f"y{k:02d}") for k in range(20)} | {(f"c{k:02d}", f"d{k:02d}") for k in range(15)}


# -- languages


@pytest.fixture(scope="module")
def models():
    sample = {
        "en": ["The people who run the service answer questions from the office every day", "You will review reports that managers open each morning with the team", "Please send a short note and tell us what you built last with others"],
        "fr": ["Les personnes qui exploitent le service répondent aux questions de la direction", "Vous allez relire les tableaux lus chaque matin par les chefs avec l'équipe", "Merci d'envoyer un mot bref et de nous dire ce que vous avez construit"],
        "de": ["Die Menschen im Betrieb beantworten die Fragen der Abteilung an jedem Tag", "Sie werden Berichte prüfen, die Filialleiter morgens mit der Gruppe öffnen", "Bitte schicken Sie uns eine kurze Nachricht und erzählen Sie, was Sie gebaut haben"],
    }
    return langid.train({k: [f"{a} {b}" for a in v for b in v] * 3 for k, v in sample.items()}, languages=("en", "fr", "de"))


def test_kneser_ney_sums_to_one():
    m = langid.train({"en": ["abracadabra abba cab " * 3] * 3, "fr": ["bac a bacca " * 4] * 3}, order=3, languages=("en", "fr"))
    alphabet = list(range(1 << 6))
    for context in ("ab", "zz"):
        codes, _ = langid.symbols([context])
        total = np.zeros(2)
        for c in alphabet:
            code, extra, level = (codes[-2] << 12) | (codes[-1] << 6) | c, np.zeros(2), 2
            while True:
                k = np.searchsorted(m.grams[level], code)
                if k < len(m.grams[level]) and m.grams[level][k] == code:
                    total += np.exp(extra + m.logs[level][k])
                    break
                if level == 0:
                    total += np.exp(extra + m.floor)
                    break
                ctx = code >> 6
                k = np.searchsorted(m.contexts[level - 1], ctx)
                if k < len(m.contexts[level - 1]) and m.contexts[level - 1][k] == ctx:
                    extra = extra + m.backs[level - 1][k]
                level -= 1
                code &= (1 << (6 * (level + 1))) - 1
        assert np.all(np.abs(total - 1) < 0.01)


def test_languages(spark, models):
    en, fr = "Please tell the people what you will review every morning", "Vous allez envoyer un mot bref aux personnes de la direction"
    rows = [
        {"id": "1", "description_language": "EN", "description_text": f"{en}\n\n  {fr}  \nshort line\r\n{en}"}, {"id": "2", "description_text": fr}, {"id": "3", "description_language": "n/a", "description_text": en},
        {"id": "4", "description_language": "French", "description_text": None}, {"id": "5", "description_language": "fr-FR", "description_text": ""}, {"id": "6", "description_language": "anglais", "description_text": en}, {"id": "7", "description_language": "de", "description_text": (fr + "\n") * 3000},
    ]
    got = {tuple(r) for r in langid.mislabelled_lines(jobs(spark, rows + rows), None, models).collect()}
    assert {g for g in got if g[0] != "7"} == {("1", 2, "fr"), ("2", 1, "fr"), ("3", 1, "en")} and len([g for g in got if g[0] == "7"]) == 3000
    whole = {r["id"]: (r["lang"], r["languages"]) for r in langid.text_languages(jobs(spark, rows), None, models).collect()}
    assert whole["1"] == ("en", 2) and whole["2"] == ("fr", 1) and whole["4"] == whole["5"] == ("und", 0)
    parts = {(r["id"], r["line_no"]): r["lang"] for r in langid.segment_languages(jobs(spark, rows), None, models).collect()}
    assert parts["1", 1] == "en" and parts["1", 2] == "fr" and ("1", 3) not in parts
    assert langid.mislabelled_lines(jobs(spark, []), None, models).count() == 0


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    j = spark.read.parquet("/root/testdata/sf0.01/jobs.parquet")
    m = langid.train(langid.sample_lines(d, j, texts_per_language=120))
    other = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null").collect()
    lines = [(x["lang"], y) for x in other for y in langid.split_lines(x["text"]) if len(y) >= 60]
    best, sure = m.judge([y for _, y in lines])
    assert np.mean([m.languages[b] == x for (x, _), b in zip(lines, best)]) > 0.97 and sure.min() >= 0


# -- packing and mixing


def test_token_counts():
    import tiktoken

    c = tokens.TokenCounter()
    for t in ("", None, "Hello, world's  end\n\n 12345 été 日本", "a" * 5000, " \t\n "):
        assert c(t) == (len(c.encoding.encode_ordinary(t)) if t else 0)
    assert tiktoken and len(c.sizes) > 0


def test_sum_of_squares():
    rng = np.random.default_rng(1)
    for capacity in (10, 512):
        sizes = rng.integers(1, capacity + 1, 800)
        place, start, n = packing.sum_of_squares(sizes, capacity)
        place, start = packing.join_leftovers(place, start, sizes, n, capacity)
        for b in np.unique(place):
            mine = np.flatnonzero(place == b)
            mine = mine[np.argsort(start[mine])]
            ends = start[mine] + sizes[mine]
            assert start[mine][0] == 0 and (ends[:-1] == start[mine][1:]).all() and ends[-1] <= capacity
        assert len(np.unique(place)) <= 1.25 * -(-sizes.sum() // capacity) + 2


def test_packing(spark):
    kinds = spark.createDataFrame([("s", 8), ("m", 20), ("bad", 0), (None, 5)], "container string, capacity_tokens bigint")
    items = spark.createDataFrame([(k, n) for k, n in enumerate([3, 5, 8, 9, 20, 41, 0, 1, 7])] + [(0, 3)], "doc_id bigint, n_tokens bigint")
    got = packing.pack(items, kinds, shard_items=4).collect()
    for c, cap in (("s", 8), ("m", 20)):
        mine = [r for r in got if r["container"] == c]
        by_doc = {d: sum(r["n_tokens"] for r in mine if r["doc_id"] == d) for d in {r["doc_id"] for r in mine}}
        assert by_doc == {0: 3, 1: 5, 2: 8, 3: 9, 4: 20, 5: 41, 7: 1, 8: 7}
        fills = {}
        for r in mine:
            fills[r["container_no"]] = fills.get(r["container_no"], 0) + r["n_tokens"]
            assert r["n_tokens"] == cap or r["piece"] == [3, 5, 8, 9, 20, 41, 0, 1, 7][r["doc_id"]] // cap
        assert max(fills.values()) <= cap
    assert {r["container"] for r in got} == {"s", "m"}
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "some words here", "a")], "doc_id bigint, text string, container string")
    assert {r["doc_id"] for r in packing.pack_documents(docs, kinds).collect()} == {3}
    assert packing.fill_report(packing.pack_documents(docs.limit(0), kinds)).count() == 0


def test_splitting_tree():
    q = np.array([100, 7, 0, 33])
    t = mixing.split_quotas(q, 7, 1)
    assert (t.sum(axis=0) == q).all() and t.sum(axis=1).max() - t.sum(axis=1).min() <= 1 and (t == mixing.split_quotas(q, 7, 1)).all()


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(k, "big" if k % 10 else "small", rng.randrange(5, 60)) for k in range(4000)] + [(9001, None, 5), (9002, "other", 5), (9003, "big", 0), (1, "big", 10_000_000)][:3]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.25, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats bigint")
    mixed = mixing.mix(docs, targets, blocks=32, shard_records=500)
    got = mixed.collect()
    assert mixed.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert max(r["copy"] for r in got if r["source"] == "big") == 1 and max(r["copy"] for r in got if r["source"] == "small") <= 3
    share = {r["source"]: r["actual_share"] for r in mixing.share_report(mixed, targets).collect()}
    assert abs(share["big"] - 0.7 / 0.95) < 0.002 and abs(share["small"] - 0.25 / 0.95) < 0.002 and share["absent"] == 0
    for s in {r["shard"] for r in got}:
        assert sorted(r["position"] for r in got if r["shard"] == s) == list(range(sum(1 for r in got if r["shard"] == s)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7), targets, blocks=32, shard_records=500).collect()))
    # Many records to few blocks: shards stay small and the shares stay what they are.
    few = mixing.mix(docs, targets, blocks=2, shard_records=100)
    assert few.groupBy("shard").count().agg(F.max("count")).first()[0] < 200
    again = {r["source"]: r["actual_share"] for r in mixing.share_report(few, targets).collect()}
    assert abs(again["big"] - share["big"]) < 0.003 and few.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.share_report(mixing.mix(docs.limit(0), targets), targets).count() == 3


# -- personal data


def test_personal_data(spark):
    texts = {
        1: "Dear Mr O'Tozovas,\nName: Piotr Rulitror\nMail: p.rulitror+jobs@post.example\nRang (020) 7946 0968 twice.", 2: "Kind regards,\nLeonie Civregil\n+44 (0)7700-900-114",
        3: "The register number of the firm is 779 170 736 59046. Version 4.1.60.8 went live on 06/12/2026. Reference: 5433-2075-83. Follow @datateam.", 4: "contact => Imogen Pabograr <seclovem [at] post [dot] example> / cell 0033 6 39 98 24 65",
        5: "142 ter impasse du Vieux Moulin, 59009 Lille\nN° de sécurité sociale : 1 70 02 99 347 566 72", 6: "The walk from Mill Street station takes ten minutes. Cabinet Leonie Pravotem is hiring.", 7: "Anschrift: Am Alten Wehr 128, 20011 Hamburg\nSteuernummer: 91/173/777/515", 8: None, 9: "", 10: "x " * 50_000,
    }
    rows = [(k, t, "Cabinet Leonie Pravotem" if k == 6 else None, "clash", 1) for k, t in texts.items()]
    rows += [(100 + k, f"Name: Leonie B{c}rat\nPresent: Leonie, Piotr and the council.", None, "clash", 1) for k, c in enumerate("aeiouy")]
    df = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string, company string, kind string, start_pos int")
    got = {(r["doc_id"], r["kind"], texts[r["doc_id"]][r["start_pos"] - 1 :][:8]) for r in pii.found_data(df).collect() if r["doc_id"] < 100}
    assert got == {
        (1, "name", "O'Tozova"), (1, "name", "Piotr Ru"), (1, "email", "p.rulitr"), (1, "phone", "(020) 79"), (2, "name", "Leonie C"), (2, "phone", "+44 (0)7"), (4, "name", "Imogen P"), (4, "email", "seclovem"), (4, "phone", "0033 6 3"),
        (5, "address", "142 ter "), (5, "id_number", "1 70 02 "), (7, "address", "Am Alten"), (7, "id_number", "91/173/7"),
    }
    red = {r["doc_id"]: r["text"] for r in pii.redacted_texts(df).collect()}
    assert red[4] == "contact => [NAME] <[EMAIL]> / cell [PHONE]" and red[3] == texts[3] and red[6] == texts[6] and red[8] is None and red[9] == "" and red[10] == texts[10]
    assert pii.found_data(df.limit(0)).count() == 0


def test_disclosure_is_learned_from_co_occurrence(spark):
    """A place that no prior names is learned from the names that addresses spell out, and tells of names that no address does."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).capitalize()
    people = [(word(), word()) for _ in range(12)]
    rows = [(k, f"Then the board asked {a} {b} about it.\nBudget of the Council stands. Write to {a.lower()}.{b.lower()}@post.example", None) for k, (a, b) in enumerate(people * 5)]
    rows += [(100 + k, f"Then the board asked {word()} {word()} about it.\nBudget of the Council stands.", None) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, company string")
    judge, rare = pii.learned(pii.mentions(docs))
    lean = lambda t: judge.terms[t] - judge.base
    assert lean(people[0][0].lower()) > 1.5 and "budget" in pii.silent_terms(docs) and rare.count() == 0
    got = {(r["doc_id"], r["start_pos"]) for r in pii.found_data(docs).where("kind = 'name'").collect()}
    assert got == {(k, len("Then the board asked ") + 1) for k, _, _ in rows}


def test_rare_terms_are_joined(spark, monkeypatch):
    rows = [(k, "Greta Vo wrote.\nMail: greta.vo@post.example", None) for k in range(12)] + [(50 + k, text_of(random.Random(k), 4).title(), None) for k in range(120)] + [(200, "the old Greta came", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, company string")
    want = {tuple(r) for r in pii.found_data(docs).collect()}
    assert (200, "name", 9) in want
    # With a higher share Greta is too rare to be broadcast, and found all the same.
    monkeypatch.setattr(pii, "SHARE", 0.9)
    assert pii.learned(pii.mentions(docs))[1].where("term = 'greta'").count() == 1 and {tuple(r) for r in pii.found_data(docs).collect()} == want
