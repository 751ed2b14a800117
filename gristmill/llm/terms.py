"""Freely typed values mapped to the entries of a reference list; no Python runs on the data.

Typed values are cleaned by fixed rules, then joined to the spellings of the list in three steps: equal text, equal text without
blanks and marks, and at last a pigeonhole join for typos. There each reference spelling is cut into k + 1 segments; a text within
k edits of it must hold one segment unchanged, shifted by k places at most, so an equality join on (kind, length, place, segment)
finds every candidate and `levenshtein` verifies it. What no step reaches comes out of an anti-join as unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small, cut

#: Spellings beyond the list's own aliases: what people of the trade write for an entry. A parameter of `map_terms`.
SECTOR_SYNONYMS = {
    "banking": ("bank", "banks", "bancaire", "retail banking", "corporate & investment banking", "investment banking", "banque / finance", "private banking", "banca", "bankwesen"),
    "insurance": ("assurance", "assurances", "assurance-vie", "mutuelle", "insurer", "insurers", "versicherung", "versicherungen", "seguros", "assicurazioni"),
    "fintech": ("neobank", "payments tech", "payment tech", "payments", "financial technology", "regtech"),
    "telecom": ("telco", "telcos", "telecommunications", "telecommunication", "opérateur télécom", "telecomunicaciones", "telekommunikation", "telecoms"),
    "energy": ("énergie", "energie", "energía", "energia", "oil & gas", "electricity & gas", "utilities", "utilities (power)", "power utilities"),
    "healthcare": ("health", "health care", "santé", "salud", "gesundheitswesen", "hospital sector", "hospitals", "santé publique / hôpital", "sanità"),
    "luxury": ("luxe & cosmétique", "haute couture", "luxury goods", "lujo", "lusso", "luxusgüter"),
    "retail": ("einzelhandel", "grande distribution", "commerce de détail", "supermarkets", "retail / e-commerce", "retail trade", "comercio minorista"),
    "aerospace_defense": ("aerospace", "aerospace and defense", "aerospace & defence", "défense", "defense", "defence", "aéronautique", "aéro/défense", "luft- und raumfahrt"),
    "automotive": ("auto industry", "carmaker", "car industry", "constructeur automobile", "automobilbau", "automobilindustrie", "automoción"),
    "consulting": ("consultancy", "conseil", "cabinet de conseil", "advisory", "beratung", "unternehmensberatung", "consultoría"),
    "public_sector": ("government", "secteur public", "administration publique", "collectivités territoriales", "sector público", "öffentlicher dienst"),
    "other": ("autres secteurs", "autre secteur", "misc. other", "sonstige", "otros", "altro", "overig", "miscellaneous"),
}
TECHNOLOGY_SYNONYMS = {
    "Python": ("py", "python 3", "langage python"), "SQL": ("sql queries", "langage sql"), "Java": ("jdk", "java se", "jdk 17"), "JavaScript": ("js", "ecmascript", "javascript (es6)", "es6"), "TypeScript": ("ts",),
    "Go": ("go lang",), "Rust": ("rustlang",), "C++": ("cpp", "c plus plus"), "C#": ("csharp",), "R": ("r stats", "langage r", "r language"), "Apache Spark": ("spark sql",),
    "Apache Kafka": ("kafka (confluent)", "kafka streams", "confluent kafka"), "Apache Flink": ("flink sql",), "Dagster": ("dagster.io", "dagster orchestrator"), "Prefect": ("prefect (orchestration)",), "dbt": ("dbt-core",),
    "Snowflake": ("snowflakedb",), "BigQuery": ("bq", "google bigquery"), "Amazon Redshift": ("aws redshift",), "PostgreSQL": ("postgres", "psql", "pg sql", "pgsql", "postgre sql"),
    "MongoDB": ("mongo",), "Elasticsearch": ("es cluster", "elastic stack search", "elastic"), "Redis": ("redis kv", "redis cache"), "Amazon Web Services": ("aws", "amazon aws", "aws cloud"),
    "Microsoft Azure": ("azure cloud",), "Google Cloud Platform": ("gcp", "google cloud", "google cloud plateform"), "Terraform": ("terraform (hashicorp)", "terraform iac"), "Ansible": ("ansible tower",),
    "Kubernetes": ("k8s", "kube", "k8s cluster"), "Docker": ("docker compose", "conteneurs docker"), "GitLab CI": ("gitlab ci/cd", "gitlab"), "GitHub Actions": ("gha", "gh actions"), "Jenkins": ("jenkins pipeline",),
    "Power BI": ("pbi",), "Looker": ("lookml", "looker studio bi", "looker studio"), "Qlik Sense": ("qlik",), "Dataiku": ("dataiku dss",), "Talend": ("talend di", "talend etl"),
    "Informatica PowerCenter": ("powercenter",), "TensorFlow": ("tf2", "tf"), "PyTorch": ("torch",), "scikit-learn": ("scikit", "sci-kit learn"), "pandas": ("python pandas", "pandas lib"),
    "Apache Hadoop": ("hadoop hdfs", "hdp", "hdfs"), "Apache Hive": ("hiveql",), "Apache Iceberg": ("iceberg tables",), "React": ("reactjs", "react.js"), "Node.js": ("node",),
    "SAP HANA": ("hana", "hana db", "sap s/4 hana db", "s/4 hana"), "Linux": ("linux admin",), "Git": ("git vcs", "git versioning"),
}
INDUSTRY_SYNONYMS = {
    "Financial Services": ("fin. services", "financial svcs", "services financiers"), "FinTech": ("fintechs", "payments & lending tech", "financial technology"),
    "Insurance": ("assurance", "assurances", "insurance & reinsurance", "insurtech / insurance"), "Software Development": ("sw dev", "software publisher", "éditeur de logiciels", "logiciels"),
    "IT Services": ("esn", "services informatiques", "it-dienstleistungen", "information technology svcs", "information technology services"),
    "Management Consulting": ("mgmt consulting", "strategy consulting", "conseil en management", "consulting"), "Telecommunications": ("telco", "télécommunications", "télécoms", "telecom"),
    "Energy & Utilities": ("energy", "utilities", "power & utilities", "énergie", "energie"), "Healthcare": ("health care", "hospitals & clinics", "healthtech / care", "santé", "health"),
    "Biotechnology": ("bio-technologies", "biotechnologies", "life sciences (biotech)", "life sciences"), "Pharmaceuticals": ("pharma", "drug makers", "industrie pharmaceutique", "pharmaceutical"),
    "Retail": ("retail trade", "distribution (retail)", "commerce de détail", "einzelhandel"), "E-commerce": ("online retail", "vente en ligne"),
    "Luxury Goods": ("luxury", "luxe", "luxury & jewellery"), "Automotive": ("auto", "automobile", "car industry"), "Aerospace & Defense": ("a&d", "aéronautique et défense", "aerospace and defense", "defense"),
    "Logistics": ("supply chain", "freight and logistics", "transport & logistique", "logistique"), "Media & Entertainment": ("media", "médias", "entertainment"),
    "Education": ("e-learning", "enseignement", "edtech"), "Real Estate": ("property", "immobilier", "real-estate"), "Travel & Hospitality": ("travel", "tourism", "hôtellerie", "hospitality"),
    "Agriculture": ("agritech", "agriculture & food", "agro"), "Public Administration": ("public admin", "government", "secteur public", "administration publique", "public sector"),
    "Gaming": ("video games", "games studio", "jeux vidéo", "games"), "Cybersecurity": ("infosec", "cybersécurité", "it security", "information security"),
}
SYNONYMS = {"sector": SECTOR_SYNONYMS, "technology": TECHNOLOGY_SYNONYMS, "industry": INDUSTRY_SYNONYMS}

#: Words that qualify a technology without changing it, before or after its name.
QUALIFIERS = ("apache", "amazon", "google", "microsoft", "ms", "lang", "language", "langage", "software", "desktop", "orchestrator", "orchestration", "lakehouse", "tables", "cluster", "dwh", "db", "database", "ci", "server", "stats", "tableur")

_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæßłśżźćń", "aaaaaaceeeeiiiinooooouuuuyyoaslszzcn")


def fold(text: Column) -> Column:
    """Lower case, no accents, single blanks."""
    plain = F.translate(F.lower(text), *_ACCENTS)
    return F.trim(F.regexp_replace(plain, r"(?U)[\s ​]+", " "))


def strip_marks(folded: Column) -> Column:
    """A folded value without what people put around a term: level of skill, language mark, 'sector', hash sign, end marks."""
    x = F.regexp_replace(folded, r"^(?:#|secteur ?: ?|sector ?: ?|exp\. |exp |expert )+", "")
    x = F.regexp_replace(x, r"(?: ?\((?:fr|en|de|es|confirme|expert|notions)\)| sector| ?/ ?expert| ?- ?notions| ?\*)+$", "")
    return F.trim(F.regexp_replace(x, r"(?<=[a-z0-9+#\)])[.;,:]+$", ""))


def squeeze(folded: Column) -> Column:
    """Letters, digits, plus and hash signs only."""
    return F.regexp_replace(F.regexp_replace(folded, " and | et | und ", ""), r"[^\p{L}0-9+#]", "")


def unqualified(folded: Column) -> Column:
    """A technology without version and qualifying words; the value itself where nothing would remain."""
    x = F.regexp_replace(folded, r"[ -]?v?\d+(?:\.[\dx]+)*(?:\.x)?$", "")
    words = "|".join(QUALIFIERS)
    x = F.trim(F.regexp_replace(x, rf"^(?:{words}) | \(?(?:{words})\)?$", ""))
    return F.when(F.length(x) > 0, x).otherwise(folded)


def edits_allowed(length: Column) -> Column:
    """Typos are looked for in spellings of four characters and more."""
    return F.when(length >= 4, F.lit(2)).otherwise(F.lit(0))


def reference_spellings(ref_terms: DataFrame, synonyms: dict[str, dict[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """`kind, term_id, rank, folded, key`: every known spelling of every entry. rank 0: label, 1: listed alias, 2: synonym, 3: by rule.

    A spelling that would stand for two entries of a kind keeps the one of the lower rank, then the smaller term_id.
    """
    spark = ref_terms.sparkSession
    synonyms = SYNONYMS if synonyms is None else synonyms
    extra = spark.createDataFrame([(k, label, s) for k, by in synonyms.items() for label, all_ in by.items() for s in all_], "kind string, label string, spelling string")
    listed = ref_terms.select("kind", "term_id", "label", "known_aliases")
    rows = (
        listed.select("kind", "term_id", F.col("label").alias("spelling"), F.lit(0).alias("rank"))
        .unionByName(listed.select("kind", "term_id", F.explode("known_aliases").alias("spelling")).withColumn("rank", F.lit(1)))
        .unionByName(listed.select("kind", "term_id", "label").join(F.broadcast(extra), ["kind", "label"]).select("kind", "term_id", "spelling", F.lit(2).alias("rank")))
        .select("kind", "term_id", "rank", fold(F.col("spelling")).alias("folded"))
    )
    by_rule = rows.where((F.col("kind") == "technology") & (F.col("rank") < 3)).select("kind", "term_id", F.lit(3).alias("rank"), unqualified(F.col("folded")).alias("folded"))
    rows = rows.unionByName(by_rule).where(F.length("folded") > 0).withColumn("key", squeeze(F.col("folded"))).where(F.length("key") > 0)
    best = rows.groupBy("kind", "key").agg(F.min(F.struct("rank", "term_id", "folded")).alias("b"))
    return best.select("kind", "key", "b.rank", "b.term_id", "b.folded")


def typed_values(jobs: DataFrame) -> DataFrame:
    """`id, kind, raw_value`: the distinct values typed into the three fields, NULLs dropped, everything else as stored."""
    of = lambda kind, values: jobs.select("id", F.lit(kind).alias("kind"), values.alias("raw_value"))
    return (
        of("sector", F.col("end_client_sector"))
        .unionByName(of("technology", F.explode("technologies")))
        .unionByName(of("industry", F.explode("company_info.industry")))
        .where(F.col("raw_value").isNotNull())
    )


#: From how many characters on two slips are accepted instead of one.
TWO_SLIPS_FROM = 8


def within_slips(a: Column, b: Column) -> Column:
    """One character put in, left out or replaced, or two neighbours swapped; in spellings of TWO_SLIPS_FROM characters and more any two edits."""
    d = F.levenshtein(a, b)
    swapped = (d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (d <= 1) | swapped | ((d == 2) & (F.least(F.length(a), F.length(b)) >= TWO_SLIPS_FROM))


def map_values(values: DataFrame, spellings: DataFrame) -> DataFrame:
    """`kind, raw_value, term_id` for the distinct values; term_id 0 where nothing fits.

    Steps, the first that gives an entry wins: the value as it is, without marks, without qualifying words (technologies), and one
    slip away. Ties go to the lower distance, then the better rank, then the smaller term_id. `spellings` (the
    reference list and its synonyms) is counted, and broadcast if it is small. Empty values and values without a letter or digit map to 0.
    """
    spellings = broadcast_if_small(spellings.select("kind", F.col("key").alias("ref"), "rank", "term_id"), spellings.count())
    distinct = cut(values.select("kind", "raw_value").distinct())
    forms = distinct.withColumn("folded", fold(F.col("raw_value"))).withColumn("bare", strip_marks(F.col("folded")))
    forms = forms.select(
        "kind", "raw_value",
        F.array(
            squeeze(F.col("folded")), squeeze(F.col("bare")),
            F.when(F.col("kind") == "technology", squeeze(unqualified(F.col("bare")))).otherwise(squeeze(F.col("bare"))),
        ).alias("keys"),
    )
    exact = (
        forms.select("kind", "raw_value", F.posexplode("keys").alias("step", "ref"))
        .where(F.length("ref") > 0)
        .join(spellings, ["kind", "ref"])
        .groupBy("kind", "raw_value")
        .agg(F.min(F.struct("step", "rank", "term_id"))["term_id"].alias("term_id"))
    )
    rest = forms.join(exact, ["kind", "raw_value"], "left_anti").select("kind", "raw_value", F.explode(F.array_distinct("keys")).alias("key")).where(F.length("key") >= 4)
    k = 2
    # Segment i of a reference starts at floor(n * i / (k + 1)); segments of one spelling differ in length by one at most.
    n = F.length("ref")
    start = lambda i: F.floor(n * F.lit(i) / F.lit(k + 1)).cast("int")
    pieces = spellings.where(n >= 4).select(
        "kind", "ref", "rank", "term_id", n.alias("ref_len"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("piece"), start(i).alias("at"), F.col("ref").substr(start(i) + 1, start(i + 1) - start(i)).alias("segment")) for i in range(k + 1)])).alias("s"),
    ).select("kind", "ref", "rank", "term_id", "ref_len", "s.piece", "s.segment")
    # A value of length m probes the segments of references of the lengths m - k .. m + k.
    m = F.length("key")
    probes = rest.select("kind", "raw_value", "key", F.explode(F.array(*[m + d for d in range(-k, k + 1)])).alias("ref_len")).withColumn("piece", F.explode(F.array(*[F.lit(i) for i in range(k + 1)])))
    at = F.floor(F.col("ref_len") * F.col("piece") / F.lit(k + 1)).cast("int")
    width = F.floor(F.col("ref_len") * (F.col("piece") + 1) / F.lit(k + 1)).cast("int") - at
    probes = (
        probes.where(F.col("ref_len") >= 4)
        .select("kind", "raw_value", "key", "ref_len", "piece", at.alias("at"), width.alias("width"), F.explode(F.array(*[F.lit(d) for d in range(-k, k + 1)])).alias("shift"))
        .where((F.col("at") + F.col("shift") >= 0) & (F.col("at") + F.col("shift") + F.col("width") <= F.length("key")))
        .select("kind", "raw_value", "key", "ref_len", "piece", F.col("key").substr(F.col("at") + F.col("shift") + 1, F.col("width")).alias("segment"))
    )
    typos = (
        probes.join(broadcast_if_small(pieces, pieces.count()), ["kind", "ref_len", "piece", "segment"])
        .where(within_slips(F.col("key"), F.col("ref")))
        .groupBy("kind", "raw_value")
        .agg(F.min(F.struct(F.levenshtein(F.col("key"), F.col("ref")).alias("d"), "rank", "term_id"))["term_id"].alias("term_id"))
    )
    found = exact.unionByName(typos)
    unmatched = distinct.join(found, ["kind", "raw_value"], "left_anti").withColumn("term_id", F.lit(0).cast("long"))
    return found.select("kind", "raw_value", F.col("term_id").cast("long")).unionByName(unmatched)


def map_terms(jobs: DataFrame, ref_terms: DataFrame, synonyms: dict[str, dict[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """`id, kind, raw_value, term_id` of each typed value that is not exactly a label of its kind; 0 where it stands for no entry.

    NULL values, NULL arrays and NULL elements give no row; an empty string is a value that stands for nothing. Repeated rows
    and repeated elements give one row. An empty reference list gives 0 for every value.
    """
    labels = broadcast_if_small(ref_terms.select("kind", F.col("label").alias("raw_value")), ref_terms.count())
    # NULL-safe and unskewed: a list of checked size is broadcast, and rows are made distinct before anything is shuffled.
    typed = typed_values(jobs).join(labels, ["kind", "raw_value"], "left_anti").distinct()
    typed = cut(typed)
    mapped = map_values(typed, cut(reference_spellings(ref_terms, synonyms)))
    return typed.join(mapped, ["kind", "raw_value"]).select("id", "kind", "raw_value", "term_id")
