"""Queries that prepare the whole table of documents as a dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavka.llm import fill_in_middle, merkle, quality_rules
from lavka.llm.batches import bounded_batches
from lavka.llm.registry import query, table

#: Fixed value: rows whose checksum this number divides are tampered with.
TAMPERED = 7

#: CRC-32 of a text of digits, bit by bit: after every character eight steps, marked by a number that is none.
CRC = """list_reduce([CAST(4294967295 AS UBIGINT)] || flatten(list_transform(string_split({0}, ''),
    lambda c: [CAST(ascii(c) AS UBIGINT)] || list_transform(range(8), lambda i: CAST(256 AS UBIGINT)))),
    lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END)"""
MANIFEST_SQL = f"""WITH RECURSIVE rows AS (SELECT doc_id, lang, coalesce(CASE WHEN xor({CRC.format("CAST(doc_id AS VARCHAR)")}, CAST(4294967295 AS UBIGINT)) % {TAMPERED} = 0 THEN n_chars + 1 END, n_chars) AS changed,
    f(doc_id) || f(source) || f(lang) AS head, f(CAST(n_chars AS VARCHAR)) AS own, f(text) AS tail FROM documents),
leaves AS (SELECT doc_id, lang, sha256(head || own || tail) AS leaf, sha256(head || f(CAST(changed AS VARCHAR)) || tail) AS changed_leaf,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || own || tail)) - 1 AS place FROM rows),
nodes AS (SELECT 0 AS level, lang, place, leaf AS digest, count(*) OVER (PARTITION BY lang) AS size FROM leaves UNION ALL
    SELECT level + 1, lang, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(size) + 1) // 2 FROM nodes WHERE size > 1 GROUP BY level, lang, place // 2),
upper AS (SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, lang, digest, count(*) OVER () AS size FROM nodes WHERE size = 1 UNION ALL
    SELECT level + 1, place // 2, NULL, sha256(string_agg(digest, '' ORDER BY place)), (any_value(size) + 1) // 2 FROM upper WHERE size > 1 GROUP BY level, place // 2),
tops AS (SELECT u.lang, u.place, u.digest AS subroot, n.level AS height, (SELECT digest FROM upper WHERE size = 1) AS root
    FROM upper u JOIN nodes n ON n.lang IS NOT DISTINCT FROM u.lang AND n.size = 1 WHERE u.level = 0),
steps AS (SELECT doc_id, l.lang, l.place, leaf, n.level, s.digest AS sibling, (l.place >> n.level) & 1 AS side FROM leaves l
    JOIN (SELECT DISTINCT level, lang FROM nodes WHERE size > 1) n ON n.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = n.level AND s.place = xor(l.place >> n.level, 1)
    UNION ALL SELECT doc_id, l.lang, l.place, leaf, height + n.level, s.digest, (t.place >> n.level) & 1 FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang
    JOIN (SELECT DISTINCT level FROM upper WHERE size > 1) n ON true LEFT JOIN upper s ON s.level = n.level AND s.place = xor(t.place >> n.level, 1)),
proofs AS (SELECT lang, place, string_agg(sibling, '' ORDER BY level) AS proof, list(struct_pack(s := coalesce(sibling, ''), side := side) ORDER BY level) AS path FROM steps GROUP BY lang, place),
results AS (SELECT l.doc_id, l.leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, list_reduce([struct_pack(s := changed_leaf, side := CAST(0 AS BIGINT))] || coalesce(path, []),
    lambda a, x: struct_pack(s := CASE WHEN x.side = 1 THEN sha256(x.s || a.s) ELSE sha256(a.s || x.s) END, side := x.side)).s AS folded_root
    FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.place)
SELECT *, folded_root = root AS verified FROM results"""


def coded(statement: str) -> str:
    """The statement with ``f(x)`` written out: the bytes of a text behind their number, or ``-``."""
    for field in ("doc_id", "source", "lang", "CAST(n_chars AS VARCHAR)", "CAST(changed AS VARCHAR)", "text"):
        plain = f"CAST({field} AS VARCHAR)" if field == "doc_id" else field
        statement = statement.replace(f"f({field})", f"coalesce(CAST(strlen({plain}) AS VARCHAR) || ':' || {plain}, '-')")
    return statement


@query(coded(MANIFEST_SQL))
def op11_merkle(spark, sf_dir):
    """Each document's leaf, subroot, root and proof, and what a tampered row's proof leads to."""
    docs = table(spark, sf_dir, "documents")
    head, tail = [F.col("doc_id"), F.col("source"), F.col("lang")], F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    changed = merkle.row_digest(*head, F.col("n_chars") + 1, tail)
    leaves = docs.select(
        "doc_id",
        "lang",
        merkle.row_digest(*head, F.col("n_chars"), tail).alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), changed).alias("changed"),
    )
    found = merkle.manifest(leaves, F.col("lang"), F.col("doc_id"), F.col("leaf"))
    proof = F.sha2(F.concat_ws("", "siblings"), 256).alias("proof_sha256")
    folded = merkle.folded_root(F.coalesce("row.changed", "leaf"), F.col("siblings"), F.col("sides")).alias("folded_root")
    found = found.select("row.doc_id", "leaf", "subroot", "root", proof, folded)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


RATES = (("length", "word_chars"), ("symbols", "n_symbols"), ("lines", "n_dup_lines"), ("repeats", "n_repeat_words"))
QUARTILES = [*((name, q) for name, _ in RATES for q in (1, 3)), ("words", 2)]
LEVELS = ((2, "lang, source"), (1, "lang, NULL"), (0, "NULL, NULL"))


def _far(name: str, count: str) -> str:
    rate, low, high = f"(1000 * {count} // n_words)", f"q.{name}_1", f"q.{name}_3"
    allowed = f"{quality_rules.FAR} * greatest({high} - {low}, {quality_rules.LEAST_WIDTH[name]})"
    return f"pow(greatest({rate} - {high}, {low} - {rate}, 0), 2) * n_words > pow({allowed}, 2) * (n_words + q.words_2)"


WORD = r"[^\x20\x09-\x0D]"
RULES_SQL = rf"""WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS w FROM documents),
spans AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS times
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
repeats AS (SELECT doc_id, count(DISTINCT spot) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS spot FROM spans WHERE times > 1) GROUP BY doc_id),
counted AS (SELECT doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM words) LEFT JOIN repeats USING (doc_id)),
rated AS (SELECT lang, source, 'words' AS rate, n_words AS v FROM counted WHERE n_words > 0
    {" ".join(f"UNION ALL SELECT lang, source, '{name}', 1000 * {count} // n_words FROM counted WHERE n_words > 0" for name, count in RATES)}),
celled AS (SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS cell, count(*) AS held FROM rated GROUP BY ALL),
levels AS ({" UNION ALL ".join(f"SELECT {level} AS level, {keys.replace('NULL', 'CAST(NULL AS VARCHAR)')}, rate, cell, sum(held) AS held FROM celled GROUP BY ALL" for level, keys in LEVELS)}),
upto AS (SELECT *, sum(held) OVER (PARTITION BY level, lang, source, rate ORDER BY cell) AS upto, sum(held) OVER (PARTITION BY level, lang, source, rate) AS total FROM levels),
quartiles AS (SELECT level, lang, source, max(total) AS total, {", ".join(f"min(cell) FILTER (rate = '{name}' AND 4 * upto >= {q} * total) AS {name}_{q}" for name, q in QUARTILES)}
    FROM upto GROUP BY level, lang, source),
ranked AS (SELECT o.lang AS own_lang, o.source AS own_source, u.*, row_number() OVER (PARTITION BY o.lang, o.source ORDER BY u.total < {quality_rules.LEAST_ROWS} AND u.level > 0, u.level DESC) AS nth
    FROM quartiles o JOIN quartiles u ON u.level = 0 OR u.lang IS NOT DISTINCT FROM o.lang AND (u.level = 1 OR u.source IS NOT DISTINCT FROM o.source AND u.level = 2) WHERE o.level = 2),
failed AS (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({" OR ".join(_far(name, count) for name, count in RATES)}) AS kept
FROM failed c LEFT JOIN ranked q ON q.nth = 1 AND q.own_lang IS NOT DISTINCT FROM c.lang AND q.own_source IS NOT DISTINCT FROM c.source"""


@query(RULES_SQL)
def op12_quality_rules(spark, sf_dir):
    """Each document's counts and whether it passes the rules of its language and source."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judged(docs).drop("far_out")


FORMS_SQL = f"""WITH units AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
drawn AS (SELECT doc_id, text, u, len(u) AS n, {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM units),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fill_in_middle.PLAIN_FROM} THEN 'plain'
    WHEN h4 % 100 < {fill_in_middle.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts"""


@query(FORMS_SQL)
def op13_fill_in_middle(spark, sf_dir):
    """Each document's fill-in-the-middle form, and the digests of the example and of the text rebuilt from it."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle.fill_in_middle(F.col("text"), fill_in_middle.draws(F.col("doc_id")))
    rebuilt = fill_in_middle.restored(F.col("made.output"), F.col("made.form"))
    return docs.select("doc_id", made.alias("made")).select(
        "doc_id",
        "made.n",
        "made.form",
        F.length("made.prefix").cast("long").alias("prefix_chars"),
        F.length("made.middle").cast("long").alias("middle_chars"),
        F.sha2("made.output", 256).alias("output_sha256"),
        F.sha2(rebuilt, 256).alias("restored_sha256"),
    )
