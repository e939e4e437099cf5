"""Text retrieval: postings, BM25 with prefix and synonyms, line search, vector re-ranking."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.functions.stem import folded, stemmed
from loomgraph.sources.store import Store, Table
from loomgraph.sources.tables import checkpointed, forget

#: Field weights, and the usual BM25 constants.
WEIGHTS: Mapping[str, float] = {"name": 3.0, "name_tokens": 3.0, "signature": 2.0, "doc": 1.0}
K1, B = 1.2, 0.75
QUERY_WORDS = 10_000  # words of queries that every executor may hold


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(rows: DataFrame, fields: Mapping[str, float] = WEIGHTS, key: str = "id") -> DataFrame:
    """(key, term, wtf): weighted term frequency over the fields; null fields hold no terms."""
    def weighted(field: str, weight: float) -> Column:
        return F.transform(words_of(F.coalesce(F.col(field), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    lists = [weighted(f, w) for f, w in fields.items()]
    return rows.select(key, F.explode(F.concat(*lists)).alias("t")).groupBy(key, "t.term").agg(F.sum("t.w").alias("wtf"))


def lengths(rows: DataFrame, fields: Mapping[str, float] = WEIGHTS, key: str = "id") -> DataFrame:
    """(key, len): terms in all fields together."""
    return rows.select(key, sum((F.size(words_of(F.coalesce(F.col(f), F.lit("")))) for f in fields), F.lit(0)).alias("len"))


def bm25(rows: DataFrame, queries: DataFrame, fields: Mapping[str, float] = WEIGHTS, key: str = "id") -> DataFrame:
    """(query, key, bm25) of rows that match every required term or any optional one.

    ``queries`` has (query, slot, term, prefix, required): a slot is one word of the
    query, met by its term, or by any term that begins with it if ``prefix``. A row must
    meet all required slots, or one that is not required.
    """
    size = lengths(rows, fields, key)
    corpus = size.agg(F.count("*").alias("n_rows"), F.avg("len").alias("avg_len"))
    return _scored(postings(rows, fields, key).join(size, key), corpus, queries, key)


def met_slots(post: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query, slot, required, key, wtf, len): which rows meet which words of queries. A batch of more than ``QUERY_WORDS`` words is joined by shuffles, prefixes by their first letters."""
    few = queries.limit(QUERY_WORDS + 1).count() <= QUERY_WORDS
    asked = F.broadcast(queries) if few else queries
    columns = ["query", "slot", "required", key, "wtf", "len"]
    exact = post.join(asked.where("not prefix"), "term").select(columns)
    stems = asked.where("prefix").withColumnRenamed("term", "stem")
    if few:
        begins = post.join(stems, F.col("term").startswith(F.col("stem"))).select(columns)
    else:  # of each word its first letters, as many as a prefix may have, are keys
        words = post.select("term").distinct().withColumn("stem", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n))))
        begins = post.join(words.join(stems.select("stem").distinct(), "stem", "left_semi"), "term").join(stems, "stem").select(columns)
    return exact.unionByName(begins).groupBy("query", "slot", "required", key).agg(F.sum("wtf").alias("wtf"), F.first("len").alias("len"))


def _scored(post: DataFrame, corpus: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """``post`` has (key, term, wtf, len): of all terms, or of those that the queries ask for."""
    met = met_slots(post, queries, key)
    return scored_slots(met, met.groupBy("query", "slot").agg(F.count("*").alias("df")), corpus, queries, key)


def scored_slots(met: DataFrame, df: DataFrame, corpus: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query, key, bm25) of ``met`` (as ``met_slots``), with how many rows meet each slot (query, slot, df) and the one row of ``corpus`` (n_rows, avg_len)."""
    needed = queries.groupBy("query").agg(F.count(F.when(F.col("required"), 1)).alias("needed"))
    idf = F.greatest(F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    saturated = F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = met.join(df, ["query", "slot"]).crossJoin(F.broadcast(corpus)).withColumn("part", idf * saturated)  # corpus has one row
    total = scored.groupBy("query", key).agg(F.sum("part").alias("bm25"), F.count(F.when(F.col("required"), 1)).alias("have"), F.count(F.when(~F.col("required"), 1)).alias("extra"))
    return total.join(needed, "query").where(((F.col("have") == F.col("needed")) & (F.col("needed") > 0)) | (F.col("extra") > 0)).select("query", key, "bm25")


class TextIndex:
    """Postings as a table sorted by term: a look-up opens the files, and in them the row groups, that may hold its terms.

    With ``stems`` terms are English stems without accents, as the queries' then are too.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", stems: bool = False, key_type: str = "long"):
        self.spark, self.key, self.stems = spark, key, stems
        tables = {"postings": Table(f"`{key}` {key_type}, term string, wtf double, len long", order=("term", key)), "corpus": Table("n_rows long, avg_len double")}
        self.store = Store(spark, path, tables)

    def _terms(self, rows: DataFrame, term: str = "term") -> DataFrame:
        if not self.stems:
            return rows
        words = rows.select(term).distinct()
        return rows.join(words.withColumn("_stem", stemmed(folded(F.col(term)))), term).withColumn(term, F.col("_stem")).drop("_stem")

    def write(self, rows: DataFrame, fields: Mapping[str, float] = WEIGHTS) -> TextIndex:
        """Makes the index of ``rows`` anew, as the next version: who searches the one before isn't disturbed."""
        post = self._terms(postings(rows, fields, self.key)).groupBy(self.key, "term").agg(F.sum("wtf").alias("wtf"))
        size = checkpointed(lengths(rows, fields, self.key))
        corpus = size.agg(F.count("*").alias("n_rows"), F.avg("len").alias("avg_len"))
        version = F.lit(self.store.version + 1).cast("long")
        self.store.compact({"postings": post.join(size.withColumn("len", F.col("len").cast("long")), self.key).withColumn("_version", version), "corpus": corpus.withColumn("_version", version)})
        forget(size)
        return self

    def postings(self, exact: list[str], stems: list[str]) -> DataFrame:
        """Postings of some terms, and of those that begin with some; both filters reach the files."""
        held = self.store.read("postings").drop("_version")
        wanted = F.col("term").isin(exact) if exact else F.lit(False)
        for s in stems:
            wanted = wanted | F.col("term").startswith(s)
        return held.where(wanted)

    def search(self, queries: DataFrame) -> DataFrame:
        """As ``bm25``; a query's words come to the driver, its postings don't."""
        plain = self._terms(queries.where("not prefix")).select(*queries.columns)
        queries = plain.unionByName(queries.where("prefix").withColumn("term", folded(F.col("term")) if self.stems else F.col("term")))
        rows = queries.select("term", "prefix").distinct().collect()
        post = self.postings(sorted(r["term"] for r in rows if not r["prefix"]), sorted(r["term"] for r in rows if r["prefix"]))
        return _scored(post, self.store.read("corpus").drop("_version"), queries, self.key)


def snippet(text: Column, term: Column, width: int = 12, before: int = 4) -> Column:
    """``width`` words of a text from ``before`` words ahead of the first that begins with ``term``, which is marked; … stands for what is left out. Null without such a word."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    at = F.array_position(F.transform(words, lambda w: F.startswith(F.lower(w), F.lower(term))), F.lit(True))
    first = F.greatest(F.lit(1), at - before)
    shown = F.transform(F.slice(words, first.cast("int"), width), lambda w, i: F.when(i + first == at, F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
    out = F.concat(F.when(first > 1, "… ").otherwise(""), F.array_join(shown, " "), F.when(F.size(words) >= first + width, " …").otherwise(""))
    return F.when(at > 0, out)


def query_terms(text: Column) -> Column:
    """Words of a query; the last one is a prefix."""
    words = words_of(text)
    return F.transform(words, lambda w, i: F.struct(i.alias("slot"), w.alias("term"), (i == F.size(words) - 1).alias("prefix"), F.lit(True).alias("required")))


def synonyms(domains: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """(query, term): up to ``limit`` keywords of the first domain whose name is the query or one of whose keywords holds it."""
    hit = (F.lower("name") == F.lower("query")) | F.exists("keywords", lambda k: F.contains(F.lower(k), F.lower("query")))
    first = domains.join(F.broadcast(queries), hit).groupBy("query").agg(F.min(F.struct("id", "keywords"))["keywords"].alias("keywords"))
    return first.select("query", F.explode(F.slice(F.filter("keywords", lambda k: F.lower(k) != F.lower("query")), 1, limit)).alias("term"))


def top_by(rows: DataFrame, score: str, key: str, limit: int, by: str = "query") -> DataFrame:
    """The ``limit`` best rows of each query, with their rank; ties go to the smaller key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))).where(F.col("rank") <= limit)


def cosine_to(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Cosine of every vector with the one row of ``query`` (query_vector)."""
    return vectors.crossJoin(F.broadcast(query)).select("symbol_id", S.cosine(F.col("vector"), F.col("query_vector")).alias("cosine"))


def _wanted(pattern: str, is_regex: bool, case_sensitive: bool) -> str:
    wanted = pattern if is_regex else re.escape(pattern)
    return wanted if case_sensitive else f"(?i){wanted}"


def _matches(docs: DataFrame, pattern: str, is_regex: bool, case_sensitive: bool, around: int) -> Column:
    """Of a text's lines those that match, each with its number (from 1) and the lines around it; lines that don't are never rows."""
    wanted, ls = _wanted(pattern, is_regex, case_sensitive), F.split("text", "\n")

    def near(i: Column) -> Column:
        first = F.greatest(F.lit(0), i - around)
        return F.slice(ls, first + 1, F.least(F.size(ls), i + around + 1) - first)

    numbered = F.transform(ls, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    hits = F.filter(numbered, lambda x: x["line"].rlike(wanted))
    return hits if not around else F.transform(hits, lambda x: F.struct(x["line_no"].alias("match_line"), F.greatest(F.lit(1), x["line_no"] - around).alias("first"), near(x["line_no"] - 1).alias("near")))


def _may_match(docs: DataFrame, pattern: str, is_regex: bool, case_sensitive: bool) -> DataFrame:
    """Texts that hold a literal pattern; what an expression says of a line says nothing about the text."""
    return docs if is_regex else docs.where(F.col("text").rlike(_wanted(pattern, False, case_sensitive)))


def grep(docs: DataFrame, pattern: str, is_regex: bool = False, case_sensitive: bool = False, key: str = "doc_id") -> DataFrame:
    """Lines that match: (key, line_no, line). Literal patterns are escaped; case counts only on request."""
    rows = _may_match(docs, pattern, is_regex, case_sensitive)
    return rows.select(key, F.inline(_matches(docs, pattern, is_regex, case_sensitive, 0)))


def grep_context(docs: DataFrame, pattern: str, around: int = 2, key: str = "doc_id", is_regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Matches with the ``around`` lines before and after each: (key, match_line, line_no, line)."""
    if not 0 <= around <= 10:
        raise ValueError("context is 0 to 10 lines")
    rows = _may_match(docs, pattern, is_regex, case_sensitive)
    if not around:
        return grep(docs, pattern, is_regex, case_sensitive, key).select(key, F.col("line_no").alias("match_line"), "line_no", "line")
    hits = rows.select(key, F.inline(_matches(docs, pattern, is_regex, case_sensitive, around)))
    return hits.select(key, "match_line", "first", F.posexplode("near").alias("at", "line")).select(key, "match_line", (F.col("first") + F.col("at")).alias("line_no"), "line")


def by_directory(matches: DataFrame, path: str = "path") -> DataFrame:
    """Files with a match for each parent directory."""
    return matches.select(path).distinct().groupBy(S.parent_dir(F.col(path)).alias("dir")).agg(F.count("*").alias("files"))
