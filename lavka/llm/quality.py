"""Quality by document, path and host: hierarchical empirical Bayes.

A logistic model judges the document by its form. The shares of good labels of a
host and of a path on it are beta posteriors: the path's is drawn towards its
host's, the host's towards the share of all, the more the fewer labels it
has. How much is estimated from the labels themselves, by the moments of the
spread between groups. The posterior odds of the path, over those of all, and
the odds of the model together make the score.

Counts are grouped aggregates with partial sums, so that a host of a third of
all rows is one row per task; posteriors are joined back by path. A learned row is
judged by the labels of the others of its path.

Null texts count as empty, null hosts and paths as groups of their own, rows
without a label teach nothing, repeated rows count each. Without labels of both
kinds the model says a half for all.
"""

from __future__ import annotations

import functools

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavka.llm.sampling import sample_of_rows
from lavka.llm.stored import stored

#: The model is fitted on so many labelled rows at most, by a seeded draw.
SAMPLED = 20_000
LEAST_SCORE = 0.5
FEATURES = ["size", "word", "distinct", "spread", "repeated", "bars", "symbols", "digits", "capitals", "lines", "short", "stops"]


def form(text: Column) -> dict[str, Column]:
    """What the model sees of a text: sizes and shares, each within fixed bounds."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    length = F.greatest(F.length(text), F.lit(1)).cast("double")
    distinct = F.size(F.array_distinct(words))
    after = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b)

    def number(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return {
        "size": F.log1p(F.size(words)),
        "word": F.least(length / count, F.lit(50.0)),
        "distinct": distinct / count,
        "spread": F.log1p(distinct) / F.log1p(count),
        "repeated": F.size(F.filter(after, lambda same: same)) / count,
        "bars": F.least(number(r"\|") / count, F.lit(2.0)),
        "symbols": number(r"[#$%&*@^~]") / length,
        "digits": number("[0-9]") / length,
        "capitals": number("[A-Z]") / length,
        "lines": number("\n") / count,
        "short": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / count,
        "stops": F.least(number("[.!?]") / count, F.lit(2.0)),
    }


def fitted(rows: DataFrame):
    """The pipeline's two models, or None without labels of both kinds."""
    sample = sample_of_rows(rows.filter("label IS NOT NULL").select("label", *FEATURES), SAMPLED)
    sample = stored(sample, "sample")
    if sample.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(sample)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(assembled)
    model = LogisticRegression(labelCol="label", regParam=0.001, maxIter=50).fit(scaler.transform(assembled))
    return scaler, model


def strength(groups: DataFrame, mean: Column) -> float:
    """Labels that the level above counts for, from the spread of ``k`` of ``n`` around ``mean``."""
    n, p = F.col("n"), F.least(F.greatest(mean, F.lit(1e-3)), F.lit(1 - 1e-3))
    noise = p * (1 - p)
    total = groups.filter("n > 0").agg(
        F.sum(n * F.pow(F.col("k") / n - p, 2) / noise), F.count("*"), F.sum(n), F.sum(n * n)
    )
    spread, count, labels, squares = total.first()
    if not count or labels <= count:
        return 10.0
    room = labels - squares / labels - (count - 1)
    alike = (spread - (count - 1)) / room if room > 0 else 0.0
    alike = min(max(alike, 1e-4), 0.99)
    return (1 - alike) / alike


def quality(docs: DataFrame, sites: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """``doc_id``, ``learned``, ``document``, ``host_share``, ``path_share``, ``score`` of every row.

    ``docs`` has ``doc_id``, ``text`` and ``source``; ``sites`` has ``doc_id``, ``host`` and ``path``,
    of repeated ids the first by order; a row without a site has its source for host.
    ``labels`` has ``doc_id`` and ``label``, 1 for good, of repeated ones the larger. Only
    labels of rows where ``learn`` holds are used. Texts are read once and never shuffled.
    """
    known = labels.select("doc_id", F.col("label").cast("double")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    places = sites.dropna(subset=["doc_id"]).groupBy("doc_id").agg(F.min(F.struct("host", "path")).alias("site"))
    forms = docs.select(
        "doc_id", F.coalesce(learn, F.lit(False)).alias("learned"), "source",
        *(c.cast("double").alias(n) for n, c in form(F.col("text")).items()),
    )
    rows = stored(forms, "forms").join(places, "doc_id", "left").join(known, "doc_id", "left")
    rows = rows.withColumn("host", F.coalesce("site.host", "source", F.lit("")))
    rows = rows.withColumn("path", F.coalesce("site.path", F.lit(""))).drop("site", "source")
    rows = stored(rows.withColumn("label", F.when(F.col("learned"), F.col("label"))), "rows")

    paths = rows.groupBy("host", "path").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("k"))
    paths = stored(paths, "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "hosts")
    total, good = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
    overall = (good + 1.0) / (total + 2.0)
    host_weight = strength(hosts, F.lit(overall))
    posterior = (F.col("k") + host_weight * overall) / (F.col("n") + host_weight)
    named = hosts.select("host", posterior.alias("host_share"))
    grouped = stored(paths.join(named, "host"), "posteriors")
    path_weight = strength(grouped, F.col("host_share"))

    rows = rows.join(grouped.select("host", "path", "host_share", F.col("n").alias("_n"), F.col("k").alias("_k")), ["host", "path"])
    others = F.col("_n") - F.when(F.col("label").isNull(), 0).otherwise(1)
    good_others = F.col("_k") - F.coalesce("label", F.lit(0.0))
    rows = rows.withColumn("path_share", (good_others + path_weight * F.col("host_share")) / (others + path_weight))
    models = fitted(rows)
    if models is None:
        judged = rows.withColumn("document", F.lit(0.5))
    else:
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(rows)
        judged = functools.reduce(lambda frame, model: model.transform(frame), models, assembled)
        judged = judged.withColumn("document", vector_to_array("probability")[1])

    def odds(share: Column) -> Column:
        inside = F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(inside / (1 - inside))

    at = odds(F.col("document")) + odds(F.col("path_share")) - odds(F.lit(overall))
    return judged.select("doc_id", "learned", "document", "host_share", "path_share", (1 / (1 + F.exp(-at))).alias("score"))
