"""One query for each group of scalar functions, over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.jobs.catalogue import query
from loomgraph.sources.views import Graph


@query("SELECT id, name_tokens, replace(name, '_', ' ') AS spaced FROM symbols")
def fn_tokenize_name(g: Graph) -> DataFrame:
    return g.symbols.select("id", "name_tokens", F.translate("name", "_", " ").alias("spaced"))


@query("SELECT doc_id, substr(trim(split_part(text, chr(10), 1)), 1, 120) AS signature FROM documents")
def fn_signature(g: Graph) -> DataFrame:
    return g.raw("documents").select("doc_id", S.signature(F.col("text")).alias("signature"))


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens FROM documents")
def fn_est_tokens(g: Graph) -> DataFrame:
    return g.raw("documents").select("doc_id", S.estimated_tokens(F.col("text")).alias("tokens"))


@query(
    """SELECT s.id, CAST(ceil(strlen(s.name) / 4) + ceil(strlen(s.kind) / 4) + ceil(strlen(f.path) / 4) + 8 AS BIGINT) AS node_tokens,
    CAST(floor((strlen(s.name) + strlen(s.kind) + strlen(f.path)) / 4) + 8 AS BIGINT) AS route_tokens FROM symbols s JOIN files f ON f.id = s.file_id"""
)
def fn_node_tokens(g: Graph) -> DataFrame:
    at = g.symbols.join(g.file_refs.select(F.col("id").alias("file_id"), "path"), "file_id")
    parts = [F.col(c) for c in ("name", "kind", "path")]
    return at.select("id", S.node_tokens(*parts).alias("node_tokens"), S.route_tokens(*parts).alias("route_tokens"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 400 THEN substr(text, 1, CAST(list_max(list_filter(range(97, 401), lambda k: strlen(substr(text, 1, CAST(k AS INTEGER))) <= 400)) AS INTEGER)) || '… [truncated]' ELSE text END AS text FROM documents")
def fn_truncate_tokens(g: Graph) -> DataFrame:
    return g.raw("documents").select("doc_id", S.truncate_tokens(F.col("text"), 100).alias("text"))


@query("SELECT id FROM files WHERE path ILIKE '%SRC1/_e/%'")
def fn_like(g: Graph) -> DataFrame:
    return g.file_refs.where(S.like_any_case(F.col("path"), "%SRC1/_e/%")).select("id")


@query("SELECT p_partkey AS id, round(1 / (1 + abs(p_retailprice)) * (1 + 0.1 * p_size), 9) AS relevance FROM part")
def fn_relevance(g: Graph) -> DataFrame:
    return g.raw("part").select(F.col("p_partkey").alias("id"), F.round(S.relevance(F.col("p_retailprice"), F.col("p_size")), 9).alias("relevance"))


@query("SELECT p_partkey AS id, round(coalesce(0.6 * 0.5 + 0.4 * label, 0.5), 6) AS score FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def fn_hybrid(g: Graph) -> DataFrame:
    at = g.raw("part").join(g.raw("embeddings"), F.col("vec_id") == F.col("p_partkey"), "left")
    return at.select(F.col("p_partkey").alias("id"), F.round(S.hybrid(F.lit(0.5), F.col("label").cast("double")), 6).alias("score"))


@query("SELECT symbol_id, round(sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM vectors")
def fn_l2norm(g: Graph) -> DataFrame:
    rows = g.vectors.withColumn("unit", S.l2_normalised(F.col("vector")))
    return rows.select("symbol_id", F.round(S.norm(F.col("vector")) * S.norm(F.col("unit")), 5).alias("norm"))


@query("SELECT label, i, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def label_means(g: Graph) -> DataFrame:
    """Mean vector of each label, place by place."""
    at = g.raw("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return at.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query(
    """SELECT vec_id, i, round(CASE WHEN n = 0 THEN 0 ELSE x / n END, 6) AS mean FROM (
      SELECT vec_id, i, (vec_id % 2) + (vec_id % 3 = 0)::INT + (vec_id % 5 = 0)::INT AS n,
        embedding[1 + i]::DOUBLE * (vec_id % 2) + embedding[17 + i]::DOUBLE * (vec_id % 3 = 0)::INT + embedding[49 + i]::DOUBLE * (vec_id % 5 = 0)::INT AS x
      FROM (SELECT vec_id, embedding, unnest(range(0, 16)) AS i FROM embeddings))"""
)
def fn_mean_pool(g: Graph) -> DataFrame:
    """Each vector read as four token vectors of 16, of which a mask takes some, or none."""
    at = g.raw("embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(F.slice("embedding", k * 16 + 1, F.lit(16)), lambda x: x.cast("double")))
    mask = F.array(F.col("vec_id") % 2, (F.col("vec_id") % 3 == 0).cast("long"), F.lit(0).cast("long"), (F.col("vec_id") % 5 == 0).cast("long"))
    pooled = at.select("vec_id", tokens.alias("tokens"), mask.alias("mask")).select("vec_id", S.mean_pooled(F.col("tokens"), F.col("mask"), 16).alias("pooled"))
    return pooled.select("vec_id", F.posexplode("pooled").alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("mean"))


@query("SELECT vec_id, 4 * len(embedding) AS n_bytes, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def fn_vec_codec(g: Graph) -> DataFrame:
    """Vectors as bytes and back."""
    raw = g.raw("embeddings").select("vec_id", S.vector_bytes("embedding").alias("raw"))
    back = raw.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), S.vector_from_bytes("raw").alias("v"))
    return back.select("vec_id", "n_bytes", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT DISTINCT p_name AS query, CASE WHEN p_name LIKE '%e' THEN p_name || '*' WHEN p_name LIKE '%*' THEN p_name ELSE p_name || '*' END AS prefixed FROM part UNION SELECT p_brand || '*', p_brand || '*' FROM part")
def fn_prefix_query(g: Graph) -> DataFrame:
    part = g.raw("part")
    rows = part.select(F.col("p_name").alias("query")).union(part.select(F.concat("p_brand", F.lit("*")))).distinct()
    return rows.select("query", S.prefix_query(F.col("query")).alias("prefixed"))


@query(
    """SELECT doc_id, CASE WHEN first > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(ws[first:first + 11], lambda w, i: CASE WHEN i + first - 1 = spot THEN '«' || w || '»' ELSE w END), ' ')
      || CASE WHEN len(ws) >= first + 12 THEN ' …' ELSE '' END AS shown
    FROM (SELECT doc_id, ws, spot, greatest(1, spot - 4) AS first FROM (SELECT doc_id, ws, list_position(list_transform(ws, lambda w: starts_with(lower(w), 'licen')), true) AS spot FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents WHERE contains(lower(text), 'licen'))) WHERE spot > 0)"""
)
def fn_snippet(g: Graph) -> DataFrame:
    """Twelve words around the first that begins as asked, which is marked."""
    from loomgraph.operators import retrieval as R

    rows = g.raw("documents").where(F.contains(F.lower("text"), F.lit("licen"))).select("doc_id", R.snippet(F.col("text"), F.lit("licen")).alias("shown"))
    return rows.where("shown is not null")


@query("SELECT id, concat_ws(' ', name, signature, doc) AS text FROM symbols")
def fn_embed_input(g: Graph) -> DataFrame:
    return g.symbols.select("id", S.embed_input(F.col("name"), F.col("signature"), F.col("doc")).alias("text"))


@query("SELECT id, len(functions) AS n, array_to_string(functions, ',') AS functions FROM decisions")
def fn_json_array(g: Graph) -> DataFrame:
    """Through JSON text and back."""
    rows = g.decisions.select("id", S.json_strings(F.to_json("functions")).alias("fs"))
    return rows.select("id", F.size("fs").cast("long").alias("n"), F.array_join("fs", ",").alias("functions"))


@query("SELECT name, array_to_string(keywords, '|') AS keywords FROM domains")
def fn_split_csv(g: Graph) -> DataFrame:
    text = F.concat(F.array_join("keywords", ","), F.lit(",,"))
    return g.domains.select("name", F.array_join(S.split_list(text), "|").alias("keywords"))


@query("SELECT id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN contains(lang, '/') THEN 'x' ELSE '.' END AS top FROM files")
def fn_parent_dir(g: Graph) -> DataFrame:
    return g.file_refs.select("id", S.parent_dir(F.col("path")).alias("dir"), S.parent_dir(F.col("lang")).alias("top"))


@query("SELECT id, 'prj_' || substr(md5(path), 1, 20) AS project_id, substr('prj_' || substr(md5(path), 1, 20), 1, 8) || '…' AS short_id FROM files")
def fn_short_id(g: Graph) -> DataFrame:
    key = S.stable_id(F.col("path"))
    return g.file_refs.select("id", key.alias("project_id"), S.short_id(key).alias("short_id"))


@query("SELECT p_partkey AS id, replace(replace(upper(p_brand), '-', '_'), ' ', '_') || '.' || replace(replace(upper(p_name), '-', '_'), ' ', '_') AS code FROM part")
def fn_code_norm(g: Graph) -> DataFrame:
    return g.raw("part").select(F.col("p_partkey").alias("id"), S.code_norm(F.col("p_brand"), F.col("p_name")).alias("code"))


@query("SELECT id, array_to_string(list_transform(string_split(name, '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM symbols")
def fn_title_case(g: Graph) -> DataFrame:
    return g.symbols.select("id", S.title_case(F.col("name")).alias("title"))


@query("SELECT id, upper(name) || '_' || lpad(CAST(id % 10000 AS VARCHAR), 4, '0') AS code FROM symbols")
def fn_autocode(g: Graph) -> DataFrame:
    return g.symbols.select("id", S.auto_code(F.col("name"), F.col("id") % 10_000).alias("code"))


@query("SELECT id, CASE WHEN floor(size_bytes * 997 / 1024) <= 1024 THEN CAST(floor(size_bytes * 997 / 1024) AS BIGINT) || ' KB' ELSE printf('%.1f MB', size_bytes * 997 / 1048576.0) END AS size FROM files")
def fn_db_size(g: Graph) -> DataFrame:
    return g.files.select("id", S.size_text(F.col("size_bytes") * 997).alias("size"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'not indexed' WHEN o_orderpriority = '1-URGENT' THEN 'up to date' ELSE 'indexed by ' || o_orderpriority END AS banner FROM orders")
def fn_version_banner(g: Graph) -> DataFrame:
    version = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return g.raw("orders").select(F.col("o_orderkey").alias("id"), S.version_banner(version, "1-URGENT").alias("banner"))


@query("SELECT id, split_part(path, '/', 1) AS provider, substr(path, strpos(path, '/') + 1) AS model FROM files")
def fn_model_ref(g: Graph) -> DataFrame:
    provider, model = S.model_ref(F.col("path"))
    return g.file_refs.select("id", provider.alias("provider"), model.alias("model"))


_TIER_ROWS = ", ".join(f"('{t[0]}', {t[1]}, {t[2]}, {t[3]}, {t[4]}, {t[5]})" for t in S.TIERS)


@query(f"SELECT p_partkey AS id, tier, max_lines, p_size * 10 > max_lines AS too_long FROM part JOIN (VALUES {_TIER_ROWS}) t(tier, max_lines, max_complexity, max_nesting, review_percent, least_tests) ON tier = 'T' || (p_partkey % 4)")
def fn_tier_constraints(g: Graph) -> DataFrame:
    """Parts beyond the limits of their tier; the tiers are a table of four rows."""
    tiers = g.spark.createDataFrame(list(S.TIERS), "tier string, max_lines int, max_complexity int, max_nesting int, review_percent int, least_tests int")
    at = g.raw("part").withColumn("tier", F.concat(F.lit("T"), (F.col("p_partkey") % 4).cast("string"))).join(F.broadcast(tiers), "tier")
    return at.select(F.col("p_partkey").alias("id"), "tier", "max_lines", (F.col("p_size") * 10 > F.col("max_lines")).alias("too_long"))


@query("SELECT id, epoch(date_trunc('second', ts))::BIGINT AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM tool_calls")
def fn_parse_iso(g: Graph) -> DataFrame:
    """Time as text, and read from the text again."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return g.tool_calls.select("id", F.unix_timestamp(F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("seconds"), iso.alias("iso"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\.')) AS BIGINT) AS dots FROM documents")
def fn_escape_regex(g: Graph) -> DataFrame:
    import re

    return g.raw("documents").select("doc_id", F.regexp_count("text", F.lit(re.escape("."))).cast("long").alias("dots"))


@query("SELECT id, path, lang, size_bytes, line_count, content_hash FROM files")
def scan_documents(g: Graph) -> DataFrame:
    """What a scan keeps of every document: size, line ends, checksum."""
    return g.files
