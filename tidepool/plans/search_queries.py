"""Retrieval queries: vectors, words, fusion, excerpts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions import vectors as V
from tidepool.operators import index_state as I
from tidepool.operators import search as S
from tidepool.operators import word_index as W
from tidepool.plans.registry import query
from tidepool.plans.tables import Tables, tokens_sql, with_tables
from tidepool.sources.shared import shared_folder
from tidepool.sources.word_segments import WordIndex, update_words

UNIT = "list_transform({0}::DOUBLE[], lambda x: (x / sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])))::FLOAT)::DOUBLE[]"
PAIRS = f"""pairs AS (
  SELECT q.query_id, a.asset_id, greatest(-1, least(1, list_inner_product(q.v, a.v)))::FLOAT AS similarity
  FROM (SELECT query_id, model_id, {UNIT.format("embedding")} AS v FROM vector_queries) q
  JOIN (SELECT asset_id, model_id, {UNIT.format("embedding")} AS v FROM {{vectors}}) a USING (model_id))"""
#: Only vectors of complete stages of the current version are searched.
SIMILAR = f"""{PAIRS.format(vectors="current_vectors")},
visual AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, asset_id) AS rank FROM pairs QUALIFY rank <= 100)"""
BM25 = f"""indexed AS (SELECT asset_id, {tokens_sql("text")} AS t FROM texts),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_tokens FROM indexed),
rows AS (SELECT asset_id, len(t) AS n_tokens, unnest(t) AS term FROM indexed),
posts AS (SELECT term, asset_id, count(*) AS tf, any_value(n_tokens) AS n_tokens FROM rows GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
asked AS (SELECT query_id, unnest({tokens_sql("text")}) AS term FROM text_queries
  WHERE octet_length(encode(text)) <= 4096 AND len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*')) <= 32 AND trim(text) <> ''),
wanted AS (SELECT query_id, term, count(*) AS times, count(*) OVER (PARTITION BY query_id) AS n_terms FROM asked GROUP BY query_id, term),
scores AS (
  SELECT w.query_id, p.asset_id,
    -sum(times * greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_tokens))) ORDER BY w.term) AS score
  FROM wanted w JOIN posts p USING (term) JOIN freq f USING (term), stats
  GROUP BY w.query_id, p.asset_id, n_terms HAVING count(*) = n_terms)"""
WORDS = f"""{BM25},
found AS (SELECT s.* FROM scores s JOIN stages g ON s.asset_id = g.asset_id AND g.kind = 'ocr' AND g.version = 'ocr-1' AND g.status = 'complete'),
words AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12), asset_id) AS rank FROM found QUALIFY rank <= 100)"""


VISUAL_TABLES = ("vectors", "vector_queries", "stages", "current_vectors")


def current_vectors(t: Tables) -> DataFrame:
    """Vectors of complete embedding stages of the current version, from the index; the version prunes partitions."""
    return t.index.vectors.where("version = 'clip-1'").select("asset_id", "model_id", "embedding")


def searchable_texts(t: Tables) -> DataFrame:
    return I.searchable(t.index.stages, "ocr", "ocr-1")


def word_scores(t: Tables) -> DataFrame:
    w = t.words
    return W.all_matches(t.text_queries, w.blocks, w.frequencies, w.statistics, w.tombstones)


def word_hits(t: Tables, k: int = S.CANDIDATES, words: WordIndex | None = None, searchable: DataFrame | None = None) -> DataFrame:
    """The k best texts of each query among those that are complete and current."""
    S.check_limit(k, S.RESULTS_LIMIT)
    w = words or t.words
    return W.bounded_top_k(t.text_queries, w.blocks, w.frequencies, w.statistics, w.tombstones, searchable or searchable_texts(t), k)[0]


@query(with_tables(*VISUAL_TABLES) + f", {SIMILAR} SELECT query_id, asset_id, similarity, rank FROM visual")
def semantic_topk(t: Tables) -> DataFrame:
    return S.semantic_top_k(t.vector_queries, current_vectors(t))


@query(with_tables(*VISUAL_TABLES, "files") + f""", {SIMILAR}
SELECT query_id, asset_id, similarity, rank, relative_path FROM visual
JOIN files ON relative_path = concat('docs/', lpad(asset_id::VARCHAR, 10, '0'), '.txt') WHERE rank <= 10""")
def semantic_top10(t: Tables) -> DataFrame:
    top = S.semantic_top_k(t.vector_queries, current_vectors(t), 10)
    path = F.concat(F.lit("docs/"), F.lpad(F.col("asset_id").cast("string"), 10, "0"), F.lit(".txt"))
    return top.withColumn("relative_path", path).join(t.files.select("relative_path"), "relative_path")


@query(with_tables(*VISUAL_TABLES) + f", {SIMILAR} SELECT query_id, asset_id, similarity, rank FROM visual")
def incremental_topk(t: Tables) -> DataFrame:
    """The best of the old page and of a new one, cut again, are the best of all."""
    pages = [S.semantic_top_k(t.vector_queries, current_vectors(t).where(f"asset_id % 2 = {p}")).drop("rank") for p in (0, 1)]
    return S.top_k(pages[0].unionByName(pages[1]), S.CANDIDATES, "similarity")


@query(with_tables(*VISUAL_TABLES) + " SELECT query_id, model_id FROM vector_queries WHERE model_id NOT IN (SELECT model_id FROM current_vectors)")
def incompatible_queries(t: Tables) -> DataFrame:
    return S.compatible(t.vector_queries, current_vectors(t))[1].select("query_id", "model_id")


@query(f"SELECT vec_id, {UNIT.format('embedding')}::FLOAT[] AS unit FROM embeddings")
def normalized_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", V.normalized(F.col("embedding")).alias("unit"))


@query(with_tables("vectors", "vector_queries") + f", {PAIRS.format(vectors='vectors')} SELECT query_id, asset_id, similarity FROM pairs")
def cosine_pairs(t: Tables) -> DataFrame:
    return S.cosine_scores(t.vector_queries, t.vectors)


@query(f"SELECT count(*) AS n_docs, avg(len({tokens_sql('text')})) AS avg_tokens FROM documents")
def bm25_corpus_stats(t: Tables) -> DataFrame:
    return S.corpus_statistics(t.texts)


@query(with_tables("texts") + f", r AS (SELECT asset_id, unnest({tokens_sql('text')}) AS term FROM texts) SELECT term, asset_id, count(*) AS tf FROM r GROUP BY ALL")
def term_frequencies(t: Tables) -> DataFrame:
    return S.postings(t.texts).select("term", "asset_id", "tf")


@query(with_tables("texts") + f", r AS (SELECT DISTINCT asset_id, unnest({tokens_sql('text')}) AS term FROM texts) SELECT term, count(*) AS df FROM r GROUP BY ALL")
def document_frequencies(t: Tables) -> DataFrame:
    return t.words.frequencies


@query(with_tables("texts", "text_queries") + f", {BM25} SELECT query_id, asset_id, round(score, 12) AS score FROM scores")
def bm25_scores(t: Tables) -> DataFrame:
    return word_scores(t)


@query(with_tables("texts", "text_queries", "stages") + f", {WORDS} SELECT query_id, asset_id, round(score, 12) AS score, rank FROM words")
def bm25_topk(t: Tables) -> DataFrame:
    """The k best by words; blocks that cannot hold one of them are not read."""
    return word_hits(t)


@query()
def word_search_work(t: Tables) -> DataFrame:
    """How many postings the terms of each query have, and how many its search read."""
    w = t.words
    terms = W.weighted_terms(t.text_queries, w.frequencies, w.statistics)
    read = W.bounded_top_k(t.text_queries, w.blocks, w.frequencies, w.statistics, w.tombstones, searchable_texts(t), 10)[1]
    return W.work_report(read, terms, w.blocks)


@query(with_tables("next_texts", "text_queries") + f""", {BM25.replace("FROM texts)", "FROM next_texts)")}
SELECT query_id, asset_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12), asset_id) AS rank FROM scores QUALIFY rank <= 100""")
def updated_topk(t: Tables) -> DataFrame:
    """Word search after a snapshot: only texts that it changed are tokenized, into a segment of their own."""
    diff = I.snapshot_diff(t.assets, t.snapshot, t.invalidated, list(RECORD))
    root = f"{shared_folder(t.spark)}/words-{uuid.uuid4().hex}"
    words = update_words(t.texts, t.next_texts, diff, root, t.words_root)
    return word_hits(t, words=words, searchable=t.next_texts.select("asset_id"))


@query(with_tables("texts", "text_queries") + f", {BM25} SELECT query_id, asset_id FROM scores")
def literal_and_match(t: Tables) -> DataFrame:
    return word_scores(t).select("query_id", "asset_id")


RECORD = ("width", "height", "creation_s", "modification_s")


def records(t: Tables) -> DataFrame:
    return t.index.assets.select("asset_id", *RECORD)


@query(f"""{with_tables("texts", "text_queries", "stages", "assets")}, {WORDS}
SELECT query_id, asset_id, rank, 1.0::DOUBLE / (60 + rank) AS fused, {", ".join(RECORD)} FROM words JOIN assets USING (asset_id) WHERE rank <= 20""")
def search_text(t: Tables) -> DataFrame:
    return S.search_text(word_hits(t, 20), records(t))


FUSED = f"""{SIMILAR}, {WORDS},
merged AS (SELECT coalesce(v.query_id, w.query_id) AS query_id, coalesce(v.asset_id, w.asset_id) AS asset_id, similarity,
         coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + w.rank), 0) AS fused, v.rank AS visual_rank, w.rank AS text_rank
  FROM visual v FULL OUTER JOIN words w ON v.query_id = w.query_id AND v.asset_id = w.asset_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, asset_id) AS rank FROM merged QUALIFY rank <= 50)"""
FUSED_TABLES = with_tables(*VISUAL_TABLES, "texts", "text_queries")


def fused_results(t: Tables) -> DataFrame:
    return S.search_combined(t.vector_queries, current_vectors(t), word_hits(t))


@query(f"{FUSED_TABLES}, {FUSED} SELECT query_id, asset_id, visual_rank, text_rank, fused, rank FROM best")
def rrf_fuse(t: Tables) -> DataFrame:
    return fused_results(t).select("query_id", "asset_id", "visual_rank", "text_rank", "fused", "rank")


@query(f"""{FUSED_TABLES}, {FUSED}, {with_tables("assets")[5:]}
SELECT query_id, b.asset_id, similarity, fused, rank, {", ".join(RECORD)}, CASE WHEN text_rank IS NOT NULL THEN text END AS text
FROM best b JOIN assets a ON b.asset_id = a.asset_id JOIN texts x ON b.asset_id = x.asset_id""")
def search_combined(t: Tables) -> DataFrame:
    """The flagship: both channels for a table of queries, fused, with the assets' records and recognised texts."""
    found = S.with_records(fused_results(t), records(t), t.index.texts)
    return found.select("query_id", "asset_id", "similarity", "fused", "rank", *RECORD, "text")


@query(f"""{FUSED_TABLES}, {FUSED}, {with_tables("assets", "snapshot")[5:]}
SELECT query_id, b.asset_id, rank FROM best b JOIN assets a ON a.asset_id = b.asset_id JOIN snapshot s ON s.asset_id = b.asset_id
WHERE NOT a.hidden AND a.width = s.width AND a.height = s.height AND a.creation_s = s.creation_s AND a.modification_s IS NOT DISTINCT FROM s.modification_s""")
def access_filtered_results(t: Tables) -> DataFrame:
    same = ["width", "height", "creation_s", "modification_s"]
    return S.accessible(fused_results(t), t.visible, t.snapshot, same).select("query_id", "asset_id", "rank")


@query(with_tables(*VISUAL_TABLES) + f""", {SIMILAR},
firsts AS (SELECT query_id, asset_id // 3 AS asset_id, min(rank) AS r FROM visual GROUP BY ALL)
SELECT query_id, asset_id, 1.0::DOUBLE / (60 + r) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY r, asset_id) AS rank FROM firsts QUALIFY rank <= 50""")
def rrf_duplicates(t: Tables) -> DataFrame:
    """Assets that occur several times in a channel count once, at the first rank; ranks aren't closed up."""
    top = S.semantic_top_k(t.vector_queries, current_vectors(t)).withColumn("asset_id", F.floor(F.col("asset_id") / 3).cast("long"))
    none = top.limit(0).select("query_id", "asset_id", "rank")
    return S.fuse(top.select("query_id", "asset_id", "rank"), none).select("query_id", "asset_id", "fused", "rank")


@query()
def search_snippets(t: Tables) -> DataFrame:
    found = S.search_text(word_hits(t, 20), records(t))
    return S.snippets(found, t.index.texts, t.text_queries)


@query(with_tables("texts") + f", r AS (SELECT asset_id, {tokens_sql('text')} AS t FROM texts) SELECT asset_id, len(t) AS n, array_to_string(t, ' ') AS folded FROM r")
def folded_tokens(t: Tables) -> DataFrame:
    tokens = T.tokens(F.col("text"))
    return t.texts.select("asset_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("folded"))


@query(r"SELECT item_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*'), ' ') AS terms FROM benchmark")
def query_terms(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


@query(r"""WITH b AS (SELECT item_id, octet_length(encode(text)) AS bytes, len(regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*')) AS terms, text FROM benchmark)
SELECT item_id, bytes, terms, CASE WHEN bytes > 4096 OR terms > 32 THEN 'too_long' WHEN trim(text) = '' THEN 'empty' ELSE 'ok' END AS status FROM b""")
def query_bounds(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.benchmark.select("item_id", F.octet_length(c).alias("bytes"), F.size(T.terms(c)).alias("terms"), T.query_status(c).alias("status"))


@query(r"""WITH l AS (SELECT doc_id, regexp_replace(text, '[^\p{L}]', '', 'g') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) < 4 THEN 'short' WHEN regexp_full_match(s, '\p{Latin}+') THEN 'latin' WHEN regexp_full_match(s, '\p{Cyrillic}+') THEN 'cyrillic'
WHEN regexp_full_match(s, '[\p{Latin}\p{Cyrillic}]+') THEN 'mixed' ELSE 'other' END AS script FROM l""")
def script_routing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.script(F.col("text")).alias("script"))


@query()
def clean_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.clean_text(F.col("html")).alias("clean"))


@query(r"""SELECT page_id, contains(html, chr(65533)) OR regexp_matches(html, '[\x{C2}-\x{DF}][\x{80}-\x{BF}]|[\x{E0}-\x{EF}][\x{80}-\x{BF}]{2}|[\x{F0}-\x{F4}][\x{80}-\x{BF}]{3}') AS corrupt FROM pages""")
def mojibake_flags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.mojibake(F.col("html")).alias("corrupt"))
