"""Lexical and dense retrieval as joins on postings.

Documents are tokenised once; term frequencies, document frequencies and lengths are aggregates, and a query
meets only the postings of its own terms (an equi-join), so no document is touched that shares no term.
``keys`` partitions the corpus: every statistic is per partition, which is one index for each repo or commit.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Terms of queries that are broadcast; more of them are joined by a shuffle.
TERMS = 200_000


def postings(docs: DataFrame, tokens: Column, keys: list[str], doc: str = "doc", asked: DataFrame | None = None, mean: bool = False) -> DataFrame:
    """keys, doc, term, tf, dl, n_docs, avgdl, df. Documents without tokens don't count.

    asked: queries (keys, ``tokens``); then only postings of their terms are formed, with the same statistics. mean:
    also ``mean_idf``, the mean of all terms' okapi weights.

    Texts are dealt by id once, for the counts of terms and for sums over (query, doc). Lengths travel alone, and the
    collection's statistics are counted where the texts lie.
    """
    own_terms = docs.repartition(*keys, doc).select(*keys, doc, F.explode(tokens).alias("term"))
    hint, wanted = lambda x: x, None
    if asked is not None:
        wanted = asked.select(*keys, F.explode("tokens").alias("term")).distinct()
        hint = F.broadcast if wanted.count() <= TERMS else hint
        own_terms = own_terms.join(hint(wanted), [*keys, "term"], "left_semi")
    tf = own_terms.groupBy(*keys, doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    length = docs.select(*keys, doc, F.size(tokens).alias("dl")).where("dl > 0")
    stats = length.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    found = _distinct_terms(docs, tokens, keys, doc)
    df = (found if wanted is None else found.join(hint(wanted), [*keys, "term"], "left_semi")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
    if mean:
        own = found.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
        stats = stats.join(_mean_idf(own.join(stats, keys) if keys else own.crossJoin(F.broadcast(stats)), keys), keys) if keys else stats.crossJoin(_mean_idf(own.crossJoin(F.broadcast(stats)), keys))
    out = tf.join(length, [*keys, doc]).join(hint(df), [*keys, "term"])
    return out.join(stats, keys) if keys else out.crossJoin(F.broadcast(stats))  # stats: one row


def _distinct_terms(docs: DataFrame, tokens: Column, keys: list[str], doc: str) -> DataFrame:
    """keys, term: a row for each document and each of its terms. Rows of one id are one document, so only these are dealt."""
    terms = lambda rows: rows.select(*keys, F.explode(F.array_distinct(tokens)).alias("term"))
    many = docs.groupBy(*keys, doc).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    n = many.count()
    if not n:
        return terms(docs)
    many = many.select(*(F.col(c).alias(f"_many_{c}") for c in (*keys, doc)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_many_{c}")) for c in (*keys, doc)))
    many = F.broadcast(many) if n <= TERMS else many
    merged = docs.join(many, same, "left_semi").select(*keys, doc, F.explode(F.array_distinct(tokens)).alias("term")).distinct()
    return terms(docs.join(many, same, "left_anti")).unionByName(merged.select(*keys, "term"))


def _mean_idf(terms: DataFrame, keys: list[str]) -> DataFrame:
    return terms.groupBy(*keys).agg(F.avg(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("mean_idf"))


def idf(kind: str, mean_idf: Column | None = None) -> Column:
    """lucene: ln(1 + (N - df + .5) / (df + .5)); okapi: ln of the ratio alone, negatives raised to a quarter of the mean."""
    ratio = (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    if kind == "lucene":
        return F.ln(1 + ratio)
    return F.when(F.ln(ratio) < 0, 0.25 * mean_idf).otherwise(F.ln(ratio))


def bm25(posts: DataFrame, queries: DataFrame, keys: list[str], query: list[str], doc: str = "doc", kind: str = "lucene", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query columns, doc, score. queries: keys, query columns, ``tokens``; repeated query terms count repeatedly."""
    if kind == "okapi" and "mean_idf" not in posts.columns:
        mean = _mean_idf(posts.select(*keys, "term", "df", "n_docs").distinct(), keys)
        posts = posts.join(mean, keys) if keys else posts.crossJoin(F.broadcast(mean))
    asked = queries.select(*dict.fromkeys([*keys, *query]), F.explode("tokens").alias("term")).groupBy(*dict.fromkeys([*keys, *query]), "term").agg(F.count(F.lit(1)).alias("qtf"))
    part = idf(kind, F.col("mean_idf") if kind == "okapi" else None) * F.col("qtf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return posts.join(asked, [*keys, "term"]).groupBy(*query, doc).agg(F.round(F.sum(part), 6).alias("score"))


def topk(scored: DataFrame, query: list[str], k: int, tie: str = "doc", last_first: bool = False) -> DataFrame:
    """The k best of each query with ``rank`` from 1; ties by ``tie`` ascending, or descending as a reversed sort leaves them."""
    order = Window.partitionBy(*query).orderBy(F.desc("score"), F.desc(tie) if last_first else F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def full_ranking(scored: DataFrame, docs: DataFrame, queries: DataFrame, query: str = "q", doc: str = "doc") -> DataFrame:
    """query, doc, score of every document, 0 for those not scored; rows without an id are no documents, as in the index.

    A document's scores are one row (an entry a query at most), which meets it by id; the queries are laid beside it there.
    """
    own = scored.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(query, "score"))).alias("_own"))
    met = docs.select(doc).where(F.col(doc).isNotNull()).distinct().join(own, doc, "left")
    return met.crossJoin(F.broadcast(queries.select(query))).select(query, doc, F.coalesce(F.element_at("_own", F.col(query)), F.lit(0.0)).alias("score"))


def tfidf(docs: DataFrame, tokens: Column, queries: DataFrame, query: str, doc: str = "doc") -> DataFrame:
    """Cosine of smoothed TF-IDF vectors; the corpus of a query is all documents and the query itself."""
    tf = docs.select(doc, F.explode(tokens).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    qtf = queries.select(query, F.explode("tokens").alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qtf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    weight = lambda own: F.ln((2 + F.col("n")) / (1 + F.col("df") + own)) + 1  # noqa: E731  n and df count the query
    both = tf.join(df, "term").crossJoin(F.broadcast(n))
    # a query changes the document frequency of its own terms only, so norms are corrected by those terms
    norm = both.withColumn("w", F.col("tf") * weight(0)).groupBy(doc).agg(F.sum(F.col("w") * F.col("w")).alias("norm2"))
    hit = both.join(qtf, "term").withColumns({"w1": F.col("tf") * weight(1), "w0": F.col("tf") * weight(0), "_wq": F.col("qtf") * weight(1)})
    dots = hit.groupBy(query, doc).agg(F.sum(F.col("w1") * F.col("_wq")).alias("dot"), F.sum(F.col("w1") ** 2 - F.col("w0") ** 2).alias("fix"))
    own = qtf.join(df, "term", "left").crossJoin(F.broadcast(n)).withColumn("df", F.coalesce("df", F.lit(0)))
    qnorm = own.groupBy(query).agg(F.sum((F.col("qtf") * weight(1)) ** 2).alias("q2"))
    return dots.join(norm, doc).join(qnorm, query).select(query, doc, F.round(F.col("dot") / F.sqrt((F.col("norm2") + F.col("fix")) * F.col("q2")), 6).alias("score"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def normalised(c: str) -> Column:
    length = F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    return F.when(length > 0, F.transform(c, lambda v: v / length)).otherwise(F.transform(c, lambda v: v.cast("double")))


#: Vectors and queries that meet in one group: 16 and 2 MB of 64 doubles each.
VECTOR_CHUNK, QUERY_BLOCK = 32768, 4096


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, doc, score, rank. queries is a stated set (``query``, ``v``); vectors are (``doc``, ``v``).

    Both are dealt into parts of bounded size, and each part of one meets each of the other in a group of its own, where
    a matrix product finds who can be among the k best. Only these are scored exactly, and only they are shuffled on.
    """
    blocks, chunks = (-(-df.count() // size) or 1 for df, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_CHUNK)))
    dealt = lambda df, c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = vectors.select("doc", normalised("v").alias("v"), dealt(vectors, "doc", chunks).alias("chunk"), every(blocks).alias("block"))
    asked = queries.select("query", normalised("v").alias("v"), dealt(queries, "query", blocks).alias("block"), every(chunks).alias("chunk"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        at = [(i, j, s) for i, j, s in _near(_matrix(right["v"]), _matrix(left["v"]), right["query"].to_numpy(), left["doc"].to_numpy(), k)]
        i, j, s = (np.concatenate(x) if at else np.zeros(0, np.int64) for x in (zip(*at) if at else ((), (), ())))
        return pa.table({"query": right["query"].take(pa.array(i)), "doc": left["doc"].take(pa.array(j)), "score": pa.array(s.astype(float), mask=np.isneginf(s.astype(float)))})

    schema = f"query {queries.schema['query'].dataType.simpleString()}, doc {vectors.schema['doc'].dataType.simpleString()}, score double"
    met = own.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(best, schema)
    return topk(met.select("query", "doc", F.round("score", 6).alias("score")), ["query"], k)


def _matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their lengths); -1 for a list that is null or holds one."""
    lists = lists.combine_chunks()
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, row = lists.flatten(), np.repeat(np.arange(len(length)), length)
    out = np.zeros((len(length), max(length.max(initial=0), 1)))
    column = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    out[row, column] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    length[row[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    length[lists.is_null().to_numpy(zero_copy_only=False)] = -1
    return out, length


def _near(asked: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], query: np.ndarray, doc: np.ndarray, k: int):
    """(query rows, own rows, scores) of all that can be among a query's k best once scores are rounded to six places.

    Scores are summed in the order of the elements, as ``dot`` does; vectors of unlike lengths have none (minus infinity).
    """
    (q, nq), (v, nv) = asked, own
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    order = np.argsort(doc, kind="stable")
    for lo in range(0, len(q), 256):
        score = q[lo : lo + 256] @ v.T
        score[np.isnan(score)] = np.inf
        score[(nq[lo : lo + 256, None] != nv) | (nv < 0)] = -np.inf
        for i in range(len(score)):
            own_score, at = score[i][order], order[doc[order] != query[lo + i]]
            own_score = own_score[doc[order] != query[lo + i]]
            if len(at) > k:
                at = at[own_score >= np.partition(own_score, -k)[-k] - 2e-6]
            exact = np.zeros(len(at))
            for x in range(width):
                exact += v[at, x] * q[lo + i, x]
            exact[np.isneginf(score[i][at])] = -np.inf
            # of equal scores the k first by doc are enough
            by = np.argsort(exact, kind="stable")
            new = np.append(True, np.diff(exact[by]) != 0) if len(by) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            kept = by[np.arange(len(by)) - first < k]
            yield np.full(len(kept), lo + i), at[kept], exact[kept]


def shared_queries(posts: DataFrame, queries: DataFrame, keys: list[str], query: str) -> tuple[DataFrame, DataFrame]:
    """(groups, members): queries of one partition with the same indexed terms, equally often, are one group.

    groups: keys, group, tokens; members: query column, keys, group (null where no term is indexed). Texts differ more
    than what an index knows of them, so there are far fewer groups than queries.
    """
    known = posts.select(*keys, "term").distinct()
    terms = queries.select(*keys, query, F.explode("tokens").alias("term")).join(known, [*keys, "term"])
    own = terms.groupBy(*keys, query).agg(F.array_sort(F.collect_list("term")).alias("tokens")).withColumn("group", F.sha2(F.array_join("tokens", "\n"), 256))
    groups = own.groupBy(*keys, "group").agg(F.first("tokens").alias("tokens"))
    return groups, queries.select(*keys, query).join(own.select(*keys, query, "group"), [*keys, query], "left")
