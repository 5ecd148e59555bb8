"""Secret scan: candidates by shape, false positives removed by a random forest.

Candidates are long runs of key characters anywhere in a text and values
assigned to names such as ``password``. The forest sees length, kinds of
characters, character transitions under a model of the corpus' own words,
dictionary coverage, signs of a path and the neighbouring words. It is trained
on labelled findings, by default on those that ``labelled_findings`` can judge
without it: well-known key formats and values that are assigned to a telling
name and are no words are secrets, long words of letters only are not. All other candidates
are for the forest to decide.

Everything is built-in functions and the forest of Spark's own library; no
Python runs on executors.

Word model and dictionary count every word of every row, the forest learns from every labelled
finding, and every word is scanned; nothing is drawn.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavka.llm.stored import stored

DICTIONARY = 400
TREES, DEPTH, SEED = 24, 6, 4
LEAST_PROBABILITY = 0.5

SPACE = r"[ \t\n\x0B\f\r]+"
NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential"
LONG = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ASSIGNED = rf"""(?i:{NAMES})s?["']?[:=]+["']?([^\s"',;]{{6,}})"""
CANDIDATE = rf"{LONG}|{ASSIGNED}"
# Public formats of access keys and tokens.
FORMATS = (
    r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|glpat-[0-9A-Za-z_-]{20})$"
)
HARMLESS = r"(?i)\b(sha|sha1|sha256|md5|commit|hash|uuid|guid|version|build|isbn|serial|checksum|digest|example)\b"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
SYMBOLS = len(LETTERS) + 1

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "distinct", "changes", "transition",
    "coverage", "path", "test_path", "named", "assigned", "quoted", "harmless",
]


def symbol(character: Column) -> Column:
    """1 to 36 for letters and digits, 0 for all else."""
    return F.instr(F.lit(LETTERS), character)


def bigrams(word: Column) -> Column:
    """The numbers of all pairs of neighbouring characters."""
    plain = F.regexp_replace(F.lower(word), "[^a-z0-9]", "_")
    pairs = F.regexp_extract_all(plain, F.lit("(?=(..))"), F.lit(1))
    return F.transform(pairs, lambda p: symbol(F.substring(p, 1, 1)) * SYMBOLS + symbol(F.substring(p, 2, 1)))


def word_model(docs: DataFrame, text: str) -> tuple[list[float], list[str]]:
    """Log probabilities of all pairs of characters, and the most frequent longer words, from all texts.

    Words are counted inside each task first, and only distinct ones are shuffled and taken apart.
    """
    words = docs.select(F.explode(F.split(text, SPACE)).alias("word"))
    words = words.groupBy("word").count()
    words = stored(words.select(F.lower(F.regexp_replace("word", "[^A-Za-z0-9]", "")).alias("word"), "count"), "words")
    pairs = words.select(F.explode(bigrams(F.col("word"))).alias("pair"), "count")
    seen = pairs.groupBy("pair").agg(F.sum("count")).collect()  # at most SYMBOLS**2 rows
    counts = [0.5] * SYMBOLS**2
    for pair, count in seen:
        counts[pair] += count
    rows = [sum(counts[r * SYMBOLS : (r + 1) * SYMBOLS]) for r in range(SYMBOLS)]
    logs = [math.log(counts[n] / rows[n // SYMBOLS]) for n in range(SYMBOLS**2)]
    longer = words.filter(F.rlike("word", F.lit("^[a-z]{4,12}$"))).groupBy("word").agg(F.sum("count").alias("n"))
    best = longer.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    return logs, sorted((r["word"] for r in best), key=lambda w: (-len(w), w))


def candidates(docs: DataFrame, text: str, path: Column, logs: list[float], dictionary: list[str]) -> DataFrame:
    """One row per candidate: the row's other columns, ``word_no``, ``secret`` and the features."""
    likely = docs.filter(F.rlike(F.col(text), F.lit(CANDIDATE)))
    words = likely.withColumn("_path", path).withColumn("_words", F.split(text, SPACE)).drop(text)
    numbered = F.transform("_words", lambda w, n: F.struct(n.alias("n"), w.alias("w")))
    hits = F.filter(numbered, lambda x: F.rlike(x["w"], F.lit(CANDIDATE)))

    def with_context(x: Column) -> Column:
        before = F.slice("_words", F.greatest(x["n"] - 1, F.lit(1)), F.least(x["n"], F.lit(2)))
        values = F.array_union(
            F.regexp_extract_all(x["w"], F.lit(f"({LONG})"), F.lit(1)),
            F.regexp_extract_all(x["w"], F.lit(ASSIGNED), F.lit(1)),
        )
        return F.struct(x["n"].alias("word_no"), x["w"].alias("word"), F.array_join(before, " ").alias("before"), values.alias("values"))

    found = words.select("*", F.explode(F.transform(hits, with_context)).alias("_hit")).drop("_words")
    own = [c for c in found.columns if c not in ("_hit", "_path")]
    one = found.select(*own, "_path", "_hit.word_no", "_hit.word", "_hit.before", F.explode("_hit.values").alias("secret"))
    secret, size = F.col("secret"), F.length("secret").cast("double")
    table = F.lit(logs)
    pairs = bigrams(secret)
    logsum = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(table, p))
    known = "|".join(dictionary)
    covered = size - F.length(F.regexp_replace(F.lower(secret), known, "")) if known else F.lit(0.0)
    lead = F.concat_ws(" ", "before", F.regexp_extract("word", r"^(.*?)[:=]", 1))

    def yes(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    features = {
        "length": size,
        "digits": F.regexp_count(secret, F.lit("[0-9]")) / size,
        "uppers": F.regexp_count(secret, F.lit("[A-Z]")) / size,
        "lowers": F.regexp_count(secret, F.lit("[a-z]")) / size,
        "others": F.regexp_count(secret, F.lit("[^A-Za-z0-9]")) / size,
        "distinct": F.size(F.array_distinct(F.split(secret, ""))) / size,
        "changes": F.regexp_count(secret, F.lit("(?<=[a-zA-Z])[0-9]|(?<=[0-9])[a-zA-Z]|(?<=[a-z])[A-Z]")) / size,
        "transition": logsum / F.greatest(F.size(pairs), F.lit(1)),
        "coverage": covered / size,
        "path": yes(F.rlike("word", F.lit(r"://|/.*/|@|\.[a-z]{2,5}\b"))),
        "test_path": yes(F.rlike("_path", F.lit(r"(?i)test|example|sample|fixture|mock"))),
        "named": yes(F.rlike(lead, F.lit(f"(?i){NAMES}"))),
        "assigned": yes(F.rlike("word", F.lit("[:=]")) | F.rlike("before", F.lit("[:=]$"))),
        "quoted": yes(F.rlike("word", F.lit("^[\"'`]"))),
        "harmless": yes(F.rlike(lead, F.lit(HARMLESS))),
    }
    return one.select(*own, "word_no", "secret", *(f.alias(n) for n, f in features.items()))


def labelled_findings(found: DataFrame) -> DataFrame:
    """The candidates that need no model, with ``label`` 1 for secrets and 0 for others."""
    assigned = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0) & (F.col("coverage") < 0.5)
    words = (F.col("digits") == 0) & (F.col("others") == 0) & (F.col("named") == 0)
    label = F.when(F.rlike("secret", F.lit(FORMATS)) | assigned, 1.0).when(words | (F.col("harmless") == 1), 0.0)
    return found.withColumn("label", label).filter("label IS NOT NULL")


def trained_forest(labelled: DataFrame):
    """The forest, or None without findings of both labels."""
    own = stored(labelled.filter("label IN (0, 1)").select("label", *FEATURES), "labelled")
    if own.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt"
    )
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(own))


def secrets(docs: DataFrame, text: str = "text", path: Column | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``secret``, its ``word_no`` from 0 and ``probability``, with all columns of ``docs`` but the text.

    ``path`` says where a row comes from. ``labelled`` may bring findings with the columns
    ``secret``, ``label`` and ``FEATURES``; else candidates are judged as above. Without findings
    of both labels, the candidates judged to be secrets are returned with probability 1.
    Null and empty texts have no candidate, repeated rows are scanned each.
    """
    docs = docs.drop("word_no", "secret", "probability", *FEATURES)
    logs, dictionary = word_model(docs, text)
    path = F.lit(None).cast("string") if path is None else path
    found = stored(candidates(docs, text, path, logs, dictionary), "candidates")
    labelled = labelled_findings(found) if labelled is None else labelled
    model = trained_forest(labelled)
    kept = [c for c in docs.columns if c != text]
    if model is None:
        sure = labelled.filter("label = 1").withColumn("probability", F.lit(1.0))
        return sure.select(*kept, "word_no", "secret", "probability")
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    judged = judged.withColumn("probability", vector_to_array("probability")[1])
    return judged.filter(F.col("probability") >= LEAST_PROBABILITY).select(*kept, "word_no", "secret", "probability")


MASK = "[SECRET]"


def without_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: Column | None = None) -> DataFrame:
    """All rows and columns, every secret found in a row's text replaced by ``MASK``."""
    keyed = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"),
                        (F.lit(None).cast("string") if path is None else path).alias("_from"))
    found = secrets(keyed, "_text", F.col("_from")).select("_id", "_hash", "secret").distinct()
    masked = stored(found.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("secret")).alias("_secrets")), "secrets")
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    longest_first = F.array_sort("_secrets", lambda a, b: F.length(b) - F.length(a))
    replaced = F.aggregate(longest_first, F.col(text), lambda t, s: F.replace(t, s, F.lit(MASK)))
    joined = docs.join(masked, same, "left")
    return joined.withColumn(text, F.coalesce(replaced, F.col(text))).select(docs.columns)
