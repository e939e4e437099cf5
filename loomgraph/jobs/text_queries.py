"""Retrieval queries: BM25, synonyms, vectors, line search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.jobs.catalogue import query
from loomgraph.operators import retrieval as R
from loomgraph.operators.grams import GramIndex, contained
from loomgraph.operators.text_store import BlockIndex, SegmentIndex
from loomgraph.sources.tables import checkpointed, scratch
from loomgraph.sources.views import Graph

_WORDS = """
words AS (
  SELECT id, term, w FROM (
    SELECT id, unnest(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+')) AS term, 3.0 AS w FROM symbols
    UNION ALL SELECT id, unnest(regexp_split_to_array(lower(coalesce(name_tokens, '')), '[^\\p{L}\\p{N}]+')), 3.0 FROM symbols
    UNION ALL SELECT id, unnest(regexp_split_to_array(lower(signature), '[^\\p{L}\\p{N}]+')), 2.0 FROM symbols
    UNION ALL SELECT id, unnest(regexp_split_to_array(lower(coalesce(doc, '')), '[^\\p{L}\\p{N}]+')), 1.0 FROM symbols) WHERE term <> ''),
post AS (SELECT id, term, CAST(sum(w) AS DOUBLE) AS wtf FROM words GROUP BY 1, 2),
size AS (SELECT s.id, count(w.id) AS len FROM symbols s LEFT JOIN words w ON w.id = s.id GROUP BY 1)"""

_ASKED = """
asked AS (SELECT query, lower(term) AS term, i - 1 AS slot, i = n AS prefix FROM (SELECT query, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM (
  SELECT query, regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}]+') AS ws FROM (SELECT p_name AS query FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)))),
needed AS (SELECT query, count(*) AS needed FROM asked GROUP BY 1),
met AS (SELECT query, slot, id, sum(wtf) AS wtf FROM post JOIN asked ON CASE WHEN prefix THEN starts_with(post.term, asked.term) ELSE post.term = asked.term END GROUP BY 1, 2, 3),
df AS (SELECT query, slot, count(*) AS df FROM met GROUP BY 1, 2),
scored AS (SELECT query, id, sum(greatest(ln(((SELECT count(*) FROM size) - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM size)))) AS bm25, count(*) AS have
  FROM met JOIN df USING (query, slot) JOIN size USING (id) GROUP BY 1, 2),
hits AS (SELECT query, id, bm25 FROM scored JOIN needed USING (query) WHERE have = needed)"""


def _asked(g: Graph) -> DataFrame:
    """The three names that most parts have, as queries."""
    top = g.raw("part").groupBy(F.col("p_name").alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(3)
    return top.select("query", F.explode(R.query_terms(F.col("query"))).alias("t")).select("query", "t.*")


def _hits(g: Graph) -> DataFrame:
    return R.bm25(g.symbols, _asked(g))


@query("SELECT query, id, round(bm25, 6) AS bm25 FROM hits", f"{_WORDS},{_ASKED}")
def bm25_search(g: Graph) -> DataFrame:
    return _hits(g).select("query", "id", F.round("bm25", 6).alias("bm25"))


@query("SELECT query, id, round(bm25, 6) AS bm25 FROM hits", f"{_WORDS},{_ASKED}")
def bm25_stored(g: Graph) -> DataFrame:
    """The same search in a stored index, of which only the queries' terms are read."""
    index = R.TextIndex(g.spark, scratch(g.spark, "text-index")).write(g.symbols)
    return index.search(_asked(g)).select("query", "id", F.round("bm25", 6).alias("bm25"))


@query("SELECT query, id, round(bm25, 6) AS bm25 FROM hits", f"kept AS (SELECT * FROM symbols WHERE id % 7 <> 3), {_WORDS.replace('FROM symbols', 'FROM kept')},{_ASKED}")
def bm25_segments(g: Graph) -> DataFrame:
    """The search in an index of three segments: two thirds of the symbols; the rest, and a fifth with other words; those as they were, and a seventh of all gone."""
    index = SegmentIndex(g.spark, scratch(g.spark, "segments"))
    rows, part = checkpointed(g.symbols.select("id", *R.WEIGHTS)), F.col("id") % 3 != 0
    other = part & (F.col("id") % 5 == 1)
    index.update(rows.where(part))
    index.update(rows.where(other | ~part).withColumn("doc", F.when(other, F.lit("other words than before")).otherwise(F.col("doc"))))
    index.update(rows.where(other), rows.where("id % 7 = 3").select("id"))
    index.update(None, rows.where("id % 7 = 3").select("id"))
    return index.search(_asked(g)).select("query", "id", F.round("bm25", 6).alias("bm25"))


@query("SELECT query, h.id, s.name, f.path FROM hits h JOIN symbols s ON s.id = h.id JOIN files f ON f.id = s.file_id", f"{_WORDS},{_ASKED}")
def join_fts(g: Graph) -> DataFrame:
    return _hits(g).join(g.symbols, "id").join(g.file_refs.select(F.col("id").alias("file_id"), "path"), "file_id").select("query", "id", "name", "path")


def _ranked_sql(limit: int, score: str = "round(bm25, 6)", rows: str = "hits") -> str:
    return f"SELECT query, id, CAST(r AS INTEGER) AS rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY {score} DESC, id) AS r FROM {rows}) WHERE r <= {limit}"


@query(_ranked_sql(30), f"{_WORDS},{_ASKED}")
def topk_bm25(g: Graph) -> DataFrame:
    return R.top_by(bm25_search(g), "bm25", "id", 30).select("query", "id", "rank")


@query(_ranked_sql(30, "round(bm25, 9)"), f"{_WORDS},{_ASKED}")
def topk_bm25_blocks(g: Graph) -> DataFrame:
    """The best rows from the blocks of postings that can hold them."""
    return BlockIndex(g.spark, scratch(g.spark, "blocks")).write(g.symbols).top(_asked(g), 30).select("query", "id", "rank")


@query("SELECT term, count(*) AS df, round(sum(wtf), 3) AS wtf FROM post GROUP BY term", _WORDS)
def text_index(g: Graph) -> DataFrame:
    return R.postings(g.symbols).groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("wtf"), 3).alias("wtf"))


@query("SELECT query, id, round(sum(wtf), 3) AS wtf FROM met GROUP BY 1, 2", f"{_WORDS},{_ASKED}")
def set_or_terms(g: Graph) -> DataFrame:
    """Rows that meet any word of a query."""
    post, asked = R.postings(g.symbols), F.broadcast(_asked(g))
    met = F.when(F.col("prefix"), F.startswith(post["term"], asked["term"])).otherwise(post["term"] == asked["term"])
    return post.join(asked, met).groupBy("query", "id").agg(F.round(F.sum("wtf"), 3).alias("wtf"))


_SYNONYMS = """
q AS (SELECT r_name AS query FROM region UNION ALL SELECT DISTINCT split_part(p_type, ' ', 1) FROM part UNION ALL SELECT DISTINCT p_brand FROM part),
syn AS (SELECT query, list_filter(keywords, lambda k: lower(k) <> lower(query)) AS ks FROM (SELECT query, keywords, row_number() OVER (PARTITION BY query ORDER BY id) AS r FROM q JOIN domains ON lower(name) = lower(query) OR len(list_filter(keywords, lambda k: contains(lower(k), lower(query)))) > 0) WHERE r = 1)"""


def _synonym_queries(g: Graph) -> DataFrame:
    part = g.raw("part")
    return g.raw("region").select(F.col("r_name").alias("query")).union(part.select(F.split("p_type", " ")[0]).distinct()).union(part.select("p_brand").distinct())


@query("SELECT query, unnest(ks[1:5]) AS term FROM syn", _SYNONYMS)
def synonym_expand(g: Graph) -> DataFrame:
    return R.synonyms(g.domains, _synonym_queries(g))


@query("SELECT query, count(*) AS terms FROM (SELECT query, unnest(ks[1:5]) AS term FROM syn) GROUP BY query", _SYNONYMS)
def cap_synonyms(g: Graph) -> DataFrame:
    return R.synonyms(g.domains, _synonym_queries(g)).groupBy("query").agg(F.count("*").alias("terms"))


_COSINE = """
cos AS (SELECT v.symbol_id, list_dot_product(list_transform(v.vector, lambda x: x::DOUBLE), list_transform(q.vector, lambda x: x::DOUBLE)) / (sqrt(list_dot_product(list_transform(v.vector, lambda x: x::DOUBLE), list_transform(v.vector, lambda x: x::DOUBLE))) * sqrt(list_dot_product(list_transform(q.vector, lambda x: x::DOUBLE), list_transform(q.vector, lambda x: x::DOUBLE)))) AS cosine
  FROM vectors v, (SELECT vector FROM vectors WHERE symbol_id = (SELECT min(symbol_id) FROM vectors)) q)"""


def _cosines(g: Graph) -> DataFrame:
    """Cosine of every vector with that of the smallest id."""
    first = g.vectors.agg(F.min_by("vector", "symbol_id").alias("query_vector"))
    return R.cosine_to(g.vectors, first)


@query("SELECT symbol_id, round(cosine, 5) AS cosine FROM cos", _COSINE)
def fn_cosine(g: Graph) -> DataFrame:
    return _cosines(g).select("symbol_id", F.round("cosine", 5).alias("cosine"))


@query("SELECT symbol_id, CAST(row_number() OVER (ORDER BY round(cosine, 5) DESC, symbol_id) AS INTEGER) AS rank FROM cos QUALIFY rank <= 20", _COSINE)
def vec_topk(g: Graph) -> DataFrame:
    rows = _cosines(g).select("symbol_id", F.round("cosine", 5).alias("cosine")).orderBy(F.desc("cosine"), "symbol_id").limit(20)
    return rows.select("symbol_id", F.row_number().over(Window.orderBy(F.desc("cosine"), "symbol_id")).alias("rank"))


_HYBRID = """
cand AS (SELECT query, id, 1 / (1 + round(bm25, 6)) AS rel FROM (SELECT query, id, bm25, row_number() OVER (PARTITION BY query ORDER BY round(bm25, 6) DESC, id) AS r FROM hits) WHERE r <= 100),
hyb AS (SELECT query, id, round(coalesce(0.6 * (1 - rel) + 0.4 * round(cosine, 5), 1 - rel), 6) AS score FROM cand LEFT JOIN cos ON cos.symbol_id = cand.id)"""


def _hybrid(g: Graph) -> DataFrame:
    """100 candidates of each query; the part of a score that text gives grows with BM25."""
    found = R.top_by(bm25_search(g), "bm25", "id", 100).withColumn("rel", 1 - S.relevance(F.col("bm25"), F.lit(0.0)))
    both = found.join(fn_cosine(g).withColumnRenamed("symbol_id", "id"), "id", "left")
    return both.select("query", "id", F.round(S.hybrid(F.col("rel"), F.col("cosine")), 6).alias("score"))


@query("SELECT query, id, score FROM hyb", f"{_WORDS},{_ASKED},{_COSINE},{_HYBRID}")
def hybrid_rerank(g: Graph) -> DataFrame:
    return _hybrid(g)


@query(_ranked_sql(30, "score", "hyb"), f"{_WORDS},{_ASKED},{_COSINE},{_HYBRID}")
def topk_lookup(g: Graph) -> DataFrame:
    return R.top_by(_hybrid(g), "score", "id", 30).select("query", "id", "rank")


_GREP = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
hit AS (SELECT doc_id, line_no, line FROM ln WHERE regexp_matches(line, '(?i)licen[sc]ed under'))"""
_PATTERN = "licen[sc]ed under"


def _grep(g: Graph) -> DataFrame:
    return R.grep(g.raw("documents"), _PATTERN, is_regex=True)


@query("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM hit", _GREP)
def grep(g: Graph) -> DataFrame:
    return _grep(g)


@query("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM hit", _GREP)
def grep_grams(g: Graph) -> DataFrame:
    """The same lines, of texts that have the expression's grams."""
    docs = g.raw("documents")
    return GramIndex(g.spark, scratch(g.spark, "grams")).write(docs).grep(docs, _PATTERN, is_regex=True)


_NEEDLES = "needles AS (SELECT DISTINCT split_part(text, ' ', 1) AS needle FROM benchmark UNION SELECT r_name FROM region UNION SELECT lower(n_name) FROM nation UNION SELECT 'of ' || split_part(text, ' ', 2) FROM benchmark UNION SELECT substr(text, 1, 2) FROM benchmark)"


@query("SELECT doc_id, needle FROM documents JOIN needles ON contains(text, needle)", _NEEDLES)
def contains_join(g: Graph) -> DataFrame:
    """Which of many strings each text holds."""
    item, word = g.raw("benchmark"), lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    needles = item.select(word(1).alias("needle")).union(g.raw("region").select("r_name")).union(g.raw("nation").select(F.lower("n_name"))).union(item.select(F.concat(F.lit("of "), word(2)))).union(item.select(F.substring("text", 1, 2)))
    return contained(g.raw("documents"), needles, "doc_id").withColumnRenamed("key", "doc_id")


@query("SELECT hit.doc_id, CAST(hit.line_no AS INTEGER) AS match_line, CAST(ln.line_no AS INTEGER) AS line_no, ln.line FROM hit JOIN ln ON ln.doc_id = hit.doc_id AND ln.line_no BETWEEN hit.line_no - 2 AND hit.line_no + 2", _GREP)
def grep_context(g: Graph) -> DataFrame:
    return R.grep_context(g.raw("documents"), _PATTERN, 2, is_regex=True)


@query("SELECT doc_id, match_line, count(*) AS lines FROM (SELECT hit.doc_id, CAST(hit.line_no AS INTEGER) AS match_line FROM hit JOIN ln ON ln.doc_id = hit.doc_id AND ln.line_no BETWEEN hit.line_no - 10 AND hit.line_no + 10) GROUP BY 1, 2", _GREP)
def win_context_lines(g: Graph) -> DataFrame:
    return R.grep_context(g.raw("documents"), _PATTERN, 10, is_regex=True).groupBy("doc_id", "match_line").agg(F.count("*").alias("lines"))


_DIRS = "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT path) AS files FROM hit JOIN files ON files.id = hit.doc_id GROUP BY 1"


@query(_DIRS, _GREP)
def agg_dir_distribution(g: Graph) -> DataFrame:
    return R.by_directory(_grep(g).select(F.col("doc_id").alias("id")).join(g.file_refs, "id"))


@query(f"SELECT dir, files, (SELECT count(*) FROM hit) AS total, (SELECT count(*) FROM hit) > 50 AS summary_only FROM ({_DIRS})", _GREP)
def grep_summary(g: Graph) -> DataFrame:
    total = _grep(g).agg(F.count("*").alias("total")).withColumn("summary_only", F.col("total") > 50)
    return agg_dir_distribution(g).crossJoin(F.broadcast(total))  # one row


_LINES = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"""


@query("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM ln WHERE regexp_matches(line, '^[A-Z][a-z]+ [a-z]+')", _LINES)
def grep_line_start(g: Graph) -> DataFrame:
    """An expression that looks at a line's begin finds lines anywhere in a text."""
    return R.grep(g.raw("documents"), "^[A-Z][a-z]+ [a-z]+", is_regex=True, case_sensitive=True)


@query("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM ln WHERE regexp_matches(line, '[^.]$')", _LINES)
def grep_line_end(g: Graph) -> DataFrame:
    return R.grep(g.raw("documents"), "[^.]$", is_regex=True)


@query("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM ln WHERE contains(lower(line), 'licensed under the')", _LINES)
def grep_literal(g: Graph) -> DataFrame:
    return R.grep(g.raw("documents"), "Licensed under the")


@query("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM hit ORDER BY doc_id, line_no LIMIT 20", _GREP)
def cap_search(g: Graph) -> DataFrame:
    return _grep(g).select("doc_id", "line_no").orderBy("doc_id", "line_no").limit(20)


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS matches FROM pages WHERE contains(html, '<p>')")
def grep_pages(g: Graph) -> DataFrame:
    return g.raw("pages").where(F.contains("html", F.lit("<p>"))).select("page_id", F.regexp_count("html", F.lit("<p>")).cast("long").alias("matches"))
