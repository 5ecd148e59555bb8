"""Quality rules whose limits are learned per language and source.

Every text has counts (words, their characters, symbols, repeated lines and
words). Two rules are fixed: too few words, too many repeated ones. All further
limits come from quantile sketches of each language and source instead of
numbers for all of them: a rate is far out if it lies more than ``FAR`` times
the middle half's width beyond the quartiles.

A sketch holds the number of rows per cell, a cell being all values with equal
seven leading binary digits, so a quantile is at most one part in 64 too low.
Cells depend on the value alone: sketches merge by adding up, in any order and
with the same result, and tasks send one row per cell instead of one per text.
The sketches of a language's sources merge into the language's, and those into
one of everything, which stand in where a source or a language has few rows.

Texts are read once, for the counts. The limits come back to the counts by a
join on language and source, whose limits are one row for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavka.llm.stored import stored

#: The fixed rules.
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
#: Rows below which a source's or a language's sketch gives way to the one above it.
LEAST_ROWS = 100
#: How many widths of the middle half a rate may lie beyond the quartiles,
FAR = 4
#: and the least width, in thousandths of the words, where most texts have the same rate.
LEAST_WIDTH = {"length": 100, "symbols": 10, "lines": 10, "repeats": 50}

WHITE = b" \t\n\r\x0b\f"
INNER = bytes(range(0x80, 0xC0))  # bytes that begin no character
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers, equal only for equal pairs."""
    return np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in some window that occurs twice or more."""
    if len(words) <= WINDOW:
        return 0
    number = {word: at for at, word in enumerate(dict.fromkeys(words))}
    one = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    two = joined(one[:-1], one[1:])
    five = joined(joined(two[:-2], two[2:])[:-1], one[WINDOW - 1 :])
    twice = np.bincount(five)[five] > 1
    return int((np.convolve(twice, np.ones(WINDOW, np.int64)) > 0).sum()) if twice.any() else 0


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text in UTF-8, in the order of ``COUNTS``."""
    text = text or b""
    words = text.split()  # at the six ASCII white spaces
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, WHITE + INNER)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_counts(text: Column) -> Column:
    """A struct of the counts of a text; null counts as empty."""

    @F.arrow_udf(", ".join(f"{name} bigint" for name in COUNTS))
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([text_counts(t.as_py()) for t in batch], np.int64).reshape(-1, len(COUNTS))
            yield pa.StructArray.from_arrays([pa.array(column) for column in found.T], COUNTS)

    return counts(text.cast("binary"))


def rates() -> dict[str, Column]:
    """The rates that limits are learned for, in thousandths of the words."""
    return {
        "length": F.expr("1000 * word_chars div n_words"),
        "symbols": F.expr("1000 * n_symbols div n_words"),
        "lines": F.expr("1000 * n_dup_lines div n_words"),
        "repeats": F.expr("1000 * n_repeat_words div n_words"),
    }


def cell(value: Column) -> Column:
    """The least value with the same leading digits."""
    spare = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    down = F.call_function("shiftright", value, spare)
    return F.call_function("shiftleft", down, spare)


def sketches(counted: DataFrame) -> DataFrame:
    """``level``, ``lang``, ``source``, ``rate``, ``cell``, ``held``: the sketches of all sources
    (level 2), languages (1) and of everything (0), over the rows with a word."""
    values = [F.struct(F.lit(name).alias("rate"), cell(x).alias("cell")) for name, x in rates().items()]
    values.append(F.struct(F.lit("words").alias("rate"), cell(F.col("n_words")).alias("cell")))
    spread = counted.filter("n_words > 0").select("lang", "source", F.explode(F.array(*values)).alias("at"))
    counts = F.count("*").alias("held")
    found = spread.groupBy("lang", "source", "at.rate", "at.cell").agg(counts)
    found = stored(found, "rule-sketches")
    total = F.sum("held").alias("held")
    merged = [
        found.select(F.lit(2).alias("level"), "lang", "source", "rate", "cell", "held"),
        found.groupBy("lang", "rate", "cell").agg(total).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "rate", "cell", "held"),
        found.groupBy("rate", "cell").agg(total).select(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "rate", "cell", "held"),
    ]
    return reduce(DataFrame.union, merged)


def quartiles(found: DataFrame) -> DataFrame:
    """``level``, ``lang``, ``source``, ``held`` and a column ``rate_q`` for each rate and quartile q.

    One window runs over the cells of one sketch, of which there are some hundreds.
    """
    own = Window.partitionBy("level", "lang", "source", "rate")
    upto = found.withColumn("upto", F.sum("held").over(own.orderBy("cell")))
    upto = upto.withColumn("held", F.sum("held").over(own))
    picked = [
        F.min(F.when((F.col("rate") == name) & (4 * F.col("upto") >= q * F.col("held")), F.col("cell"))).alias(f"{name}_{q}")
        for name, q in [*((name, q) for name in LEAST_WIDTH for q in (1, 3)), ("words", 2)]
    ]
    return upto.groupBy("level", "lang", "source").agg(F.max("held").alias("held"), *picked)


def limits(counted: DataFrame) -> DataFrame:
    """``lang``, ``source`` and the quartiles that hold for them: their own, their
    language's or those of everything, the first that has ``LEAST_ROWS`` rows; else the last."""
    found = stored(quartiles(sketches(counted)), "rule-quartiles")
    names = [name for name in found.columns if name not in ("level", "lang", "source")]

    def of(level: int, *keys: str) -> DataFrame:
        return found.filter(F.col("level") == level).select(*[F.col(k).alias(f"{k}_{level}") for k in keys], F.struct(*names).alias(f"of_{level}"))

    own = of(2, "lang", "source")
    own = own.join(of(1, "lang"), F.col("lang_2").eqNullSafe(F.col("lang_1")))
    every = found.filter("level = 0").first()  # one row of some ten numbers; none without texts
    every = F.struct(*[F.lit(every[name] if every else None).cast("bigint").alias(name) for name in names])
    enough = [F.when(F.col(f"of_{level}.held") >= LEAST_ROWS, F.col(f"of_{level}")) for level in (2, 1)]
    return own.select(F.col("lang_2").alias("lang"), F.col("source_2").alias("source"), F.coalesce(*enough, every).alias("limits"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def far_out() -> Column:
    """The names of the rates that lie too far out.

    Rates of short texts scatter more, so the distance allowed grows with the ratio of the
    usual number of words to the text's own: it is multiplied by the root of 1 + usual / own.
    """
    words, usual = F.col("n_words"), F.col("limits.words_2")
    out = []
    for name, rate in rates().items():
        low, high = F.col(f"limits.{name}_1"), F.col(f"limits.{name}_3")
        beyond = F.greatest(rate - high, low - rate, F.lit(0)).cast("double")
        allowed = (FAR * F.greatest(high - low, F.lit(LEAST_WIDTH[name]))).cast("double")
        out.append(F.when(beyond * beyond * words > allowed * allowed * (words + usual), F.lit(name)))
    return F.array_compact(F.array(*out))


def with_verdicts(counted: DataFrame, learned: DataFrame) -> DataFrame:
    """The counted rows with ``base_failed``, ``far_out`` and ``kept``; a row whose language and
    source have no limits, as it has no word, fails the base rules."""
    learned = learned.select(F.col("lang").alias("its_lang"), F.col("source").alias("its_source"), "limits")
    same = F.col("lang").eqNullSafe(F.col("its_lang")) & F.col("source").eqNullSafe(F.col("its_source"))
    found = counted.join(learned, same, "left").withColumn("base_failed", base_failed())
    found = found.withColumn("far_out", F.when(~F.col("base_failed"), far_out()).otherwise(F.array().cast("array<string>")))
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("far_out") == 0)).drop("its_lang", "its_source", "limits")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``far_out`` (names of rates) and ``kept`` of every row.

    A null text has no words and is not kept, like an empty one. Null languages and sources are values of
    their own. Repeated rows are judged each, and each counts in the sketches. A very long text is split
    into words once; its windows take a fixed number of bytes for each word. Ties cannot matter: a quantile is a
    cell. Other columns of ``docs`` take no part, so their names cannot clash; an empty table gives none.
    """
    counts = base_counts(F.col(text)).alias("counts")
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), counts)
    counted = stored(counted.select("doc_id", "lang", "source", "counts.*"), "rule-counts")
    return with_verdicts(counted, stored(limits(counted), "rule-limits")).drop("lang", "source")


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only.

    The texts are counted a second time instead of being shuffled or stored with their counts.
    """
    picked = [F.col(lang).alias("lang"), F.col(source).alias("source"), base_counts(F.col(text)).alias("counts")]
    counted = stored(docs.select(*picked).select("lang", "source", "counts.*"), "rule-counts")
    learned = stored(limits(counted), "rule-limits")
    whole = docs.select(F.struct("*").alias("row"), *picked).select("row", "lang", "source", "counts.*")
    return with_verdicts(whole, learned).filter("kept").select("row.*")
