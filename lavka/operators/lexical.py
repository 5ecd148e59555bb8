"""Keyword and combined ranking over chunks of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavka.operators import postings
from lavka.operators.postings import Postings
from lavka.operators.ranking import k_best
from lavka.session import stored

RRF_CONSTANT = 60
LIST_LENGTH = 50  # hits that a keyword search returns unless told otherwise


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def static_chunking(docs: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """(doc_id, text) to overlapping pieces of fixed size that cover the whole
    text. chunk_id is doc_id x 2^20 + chunk number.

    The text is cut into steps in one pass, and each chunk is a step with the
    head of the next, so the work is linear in the length of the text.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("the overlap may take up at most half of a chunk")
    steps = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    paired = F.arrays_zip(F.col("steps"), F.slice("steps", 2, F.greatest(F.lit(1), F.size("steps"))).alias("next"))
    pieces = (
        docs.filter(F.length("text") > 0)
        .select("doc_id", steps.alias("steps"))
        .select("doc_id", F.posexplode(paired).alias("chunk_no", "piece"))
        .filter((F.col("chunk_no") == 0) | (F.length("piece.steps") > overlap))
    )
    following = F.coalesce(F.left("piece.next", F.lit(overlap)), F.lit(""))
    return pieces.select(
        chunk_id().alias("chunk_id"),
        "doc_id",
        F.col("chunk_no").cast("int").alias("chunk_no"),
        F.concat("piece.steps", following).alias("content"),
    )


def chunk_id() -> Column:
    """doc_id x 2^20 + chunk number; what would not fit stops with an error, so
    that no two chunks ever share an id."""
    fits = F.col("doc_id").between(-(1 << 43), (1 << 43) - 1) & (F.col("chunk_no") < 1 << 20)
    joined = F.shiftleft("doc_id", 20) + F.col("chunk_no")
    return F.when(fits | F.col("doc_id").isNull(), joined).otherwise(
        F.raise_error(F.concat(F.lit("no chunk id for document "), F.col("doc_id").cast("string")))
    )


def text_index(chunks: DataFrame, path: str | None = None, **options) -> Postings:
    """The stored index of (chunk_id, content), below ``path`` or in the shared folder."""
    tokenised = chunks.select(F.col("chunk_id").alias("id"), tokens(F.col("content")).alias("tokens"))
    if path is None:
        return postings.indexed(tokenised, **options)
    postings.write_postings(tokenised, path, **options)
    return postings.open_postings(chunks.sparkSession, path, options.get("buckets", postings.BUCKETS))


def _search(queries: DataFrame, corpus: DataFrame | Postings, kinds: tuple[str, ...], k1: float = 1.2, b: float = 0.75, **options):
    """The queries (query_id, text) prepared against an index; chunks are indexed first, by the terms of the queries."""
    asked = queries.select("query_id", tokens(F.col("text")).alias("tokens"))
    terms = asked.select(F.explode("tokens").alias("term")).distinct()
    index = corpus if isinstance(corpus, Postings) else text_index(corpus, terms=terms)
    return postings.prepared(asked, index, kinds, k1, b, **options)


def lexical_bm25(
    queries: DataFrame, corpus: DataFrame | Postings, k: int = LIST_LENGTH, k1: float = 1.2, b: float = 0.75, **options
) -> DataFrame:
    """BM25: (query_id, id, score, rank) of the k best chunks per query."""
    hits = postings.best_chunks(_search(queries, corpus, ("bm25",), k1, b, **options), k)
    return hits.select("query_id", "id", "score", "rank")


def text_near_search(queries: DataFrame, corpus: DataFrame | Postings, k: int = LIST_LENGTH, **options) -> DataFrame:
    """Nearest chunks of a text query by TF-IDF cosine: logarithmic counts on
    both sides, idf on the query's side, both vectors of length one."""
    hits = postings.best_chunks(_search(queries, corpus, ("tfidf",), **options), k)
    return hits.select("query_id", "id", "score", "rank")


def fusion_depth(k: int, c: int = RRF_CONSTANT) -> int:
    """How deep both lists have to be known for the k best of their fusion.

    The k first chunks of either list have shares of at least 1 / (c + k) there. A chunk below
    c + 2k in both lists has less than 2 / (2c + 2k) in sum, so k chunks are before it.
    """
    return c + 2 * k


def fusion_lists(
    queries: DataFrame, corpus: DataFrame | Postings, k: int = 5, c: int = RRF_CONSTANT, **options
) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, rank) by BM25 and by TF-IDF cosine of every chunk that can be among
    the k best of the fusion, each rank being that among all chunks."""
    search = _search(queries, corpus, postings.KINDS, **options)
    hits = stored(postings.best_chunks(search, fusion_depth(k, c)), "hits")
    ranks = stored(postings.exact_ranks(search, hits), "ranks")
    return tuple(ranks.filter(F.col("kind") == kind).drop("kind") for kind in postings.KINDS)


def hybrid_rank_join(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Both hit lists of a query side by side, a missing place being null."""
    left = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    right = vector.select("query_id", "id", F.col("rank").alias("vector_rank"))
    return left.join(right, ["query_id", "id"], "full_outer")


def rrf_score(c: int = RRF_CONSTANT) -> Column:
    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (F.col(rank) + c), F.lit(0.0))

    return F.round(share("lexical_rank") + share("vector_rank"), 9)


def rrf_fusion(lexical: DataFrame, vector: DataFrame, c: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (c + rank) over both lists."""
    return hybrid_rank_join(lexical, vector).withColumn("score", rrf_score(c))


def hybrid_top5(fused: DataFrame, k: int = 5) -> DataFrame:
    """At most k results per query; a fused list is at most two hit lists long."""
    return k_best(fused.withColumn("k", F.lit(k)), largest=k).drop("k")


def hybrid_search(
    queries: DataFrame, docs: DataFrame | Postings, k: int = 5, c: int = RRF_CONSTANT, size: int = 800, overlap: int = 200, **options
) -> DataFrame:
    """The k best chunks by the fused ranks of BM25 and TF-IDF cosine.

    Texts (doc_id, text) are chunked and indexed first; a stored index is searched as it is. The lists have
    no length: ranks are those among all chunks, and which chunks have to be ranked follows from k.
    """
    corpus = docs if isinstance(docs, Postings) else static_chunking(docs, size, overlap)
    return hybrid_top5(rrf_fusion(*fusion_lists(queries, corpus, k, c, **options), c), k)
