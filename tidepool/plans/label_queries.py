"""Queries of evaluation sets, scores, lines, geometry and pluggable models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import geometry as G
from tidepool.functions.text import safe_path
from tidepool.functions.text import script as script_of
from tidepool.operators import encoders
from tidepool.operators import evaluation as E
from tidepool.operators import labels as L
from tidepool.operators import lines as N
from tidepool.operators import search as S
from tidepool.plans.registry import ORACLES, query
from tidepool.plans.search_queries import SIMILAR, VISUAL_TABLES, current_vectors
from tidepool.plans.tables import Tables, with_tables
from tidepool.sources.shared import shared_folder
from tidepool.sources.tables import export_splits

CORPUS = "corpus AS (SELECT doc_id::VARCHAR AS image_id FROM documents)"
LABELS = with_tables("evaluation_labels") + f", {CORPUS}"


def corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("image_id"))


@query(with_tables("files") + " SELECT 'img_' || substr(sha256, 1, 12) AS image_id, min(relative_path) AS relative_path, sha256, count(*) AS copies FROM files GROUP BY sha256")
def content_inventory(t: Tables) -> DataFrame:
    return L.inventory(t.files)


@query(with_tables("files") + " SELECT sha256, count(*) - 1 AS extra FROM files GROUP BY sha256 HAVING count(*) > 1")
def duplicate_contents(t: Tables) -> DataFrame:
    return L.inventory(t.files).where("copies > 1").select("sha256", (F.col("copies") - 1).alias("extra"))


@query(with_tables("files") + " SELECT substr(sha256, 1, 3) AS prefix, count(DISTINCT sha256) AS contents FROM files GROUP BY ALL HAVING count(DISTINCT sha256) > 1")
def short_id_collisions(t: Tables) -> DataFrame:
    """Collisions of short ids, of three digits so that there are some."""
    rows = t.files.select("sha256").distinct().groupBy(F.substring("sha256", 1, 3).alias("prefix")).agg(F.count("*").alias("contents"))
    return rows.where("contents > 1")


@query(with_tables("files") + """, a AS (SELECT relative_path, CASE WHEN bytes % 10 = 0 THEN sha256(sha256) ELSE sha256 END AS sha256 FROM files WHERE bytes % 7 <> 0)
SELECT coalesce(e.relative_path, a.relative_path) AS relative_path, CASE WHEN a.sha256 IS NULL THEN 'missing' WHEN e.sha256 IS NULL THEN 'unexpected' ELSE 'changed' END AS state
FROM (SELECT * FROM files WHERE bytes % 9 <> 0) e FULL OUTER JOIN a ON e.relative_path = a.relative_path WHERE e.sha256 IS DISTINCT FROM a.sha256""")
def inventory_diff(t: Tables) -> DataFrame:
    digest = F.when(F.col("bytes") % 10 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    actual = t.files.where("bytes % 7 <> 0").select("relative_path", digest.alias("sha256"))
    return L.inventory_difference(t.files.where("bytes % 9 <> 0"), actual)


@query("""(SELECT lang, source, 'missing' AS side FROM (SELECT lang, source FROM documents EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 3 = 0))
UNION ALL (SELECT lang, source, 'unexpected' FROM (SELECT lang, source FROM documents WHERE doc_id % 3 = 0 EXCEPT ALL SELECT lang, source FROM documents))""")
def table_differences(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", "source", "doc_id")
    return L.table_difference(rows.drop("doc_id"), rows.where("doc_id % 3 = 0").drop("doc_id"))


#: Images of a manifest, about: a source with more has several.
MANIFEST_IMAGES = 10_000


def manifests(files: DataFrame) -> DataFrame:
    """(source, part, json) of files: a source's images spread over as many manifests as their number asks for."""
    image = F.struct(L.short_id(F.col("sha256")).alias("id"), F.col("relative_path").alias("path"), F.col("sha256").alias("hash"))
    parts = files.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / MANIFEST_IMAGES).alias("_parts"))
    rows = files.join(parts, F.col("source").eqNullSafe(F.col("_source")))
    part = F.pmod(F.xxhash64("relative_path"), F.col("_parts"))
    return rows.groupBy("source", part.alias("part")).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(image).alias("images"))).alias("json"))


@query(with_tables("files") + " SELECT source, 'img_' || substr(sha256, 1, 12) AS image_id, relative_path, sha256 FROM files")
def manifest_flatten(t: Tables) -> DataFrame:
    """Manifests, one or more a source, written as nested JSON and read back into image rows."""
    from tidepool.sources.manifests import flatten_manifests

    return flatten_manifests(manifests(t.files), "json").select("source", F.col("image.id").alias("image_id"), F.col("image.path").alias("relative_path"), F.col("image.hash").alias("sha256"))


DIGEST = """digests AS (SELECT sha256(to_json({row})) AS h FROM {table}),
quarters AS (SELECT count(*) AS n, {sums} FROM digests),
print AS (SELECT sha256(concat_ws(':', n::VARCHAR, {names})) AS fingerprint FROM quarters)"""


def fingerprint_sql(table: str, columns: list[str]) -> str:
    """``print``, the fingerprint of a table in one row."""
    row = "{" + ", ".join(f"'{c}': {c}" for c in sorted(columns)) + "}"
    sums = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 16 * i}, 15))::BIGINT), 0) AS s{i}" for i in range(4))
    return DIGEST.format(row=row, table=table, sums=sums, names=", ".join(f"s{i}::VARCHAR" for i in range(4)))


@query("WITH parts AS (SELECT *, CASE WHEN doc_id % 10 < 7 THEN 'development' ELSE 'holdout' END AS split FROM labels), "
       + fingerprint_sql("parts", ["doc_id", "quality", "toxic", "split"]) + " SELECT split, count(*) AS rows, any_value(fingerprint) AS fingerprint FROM parts, print GROUP BY split")
def split_counts(t: Tables) -> DataFrame:
    """The label set exported by split, and the sizes and fingerprint of what was written."""
    split = F.when(F.col("doc_id") % 10 < 7, "development").otherwise("holdout")
    return export_splits(t.labels.withColumn("split", split), f"{shared_folder(t.spark)}/splits-{uuid.uuid4().hex}")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, path, NOT (len([x FOR x IN parts IF x IN ('', '.', '..')]) > 0 OR contains(path, chr(92))) AS safe FROM s""")
def url_path_rules(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return t.pages.select("page_id", path.alias("path"), safe_path(path).alias("safe"))


PROBLEMS = """marked AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM evaluation_labels),
problems AS (SELECT 'blank_query_id' AS rule, query_id AS entity_id FROM marked WHERE query_id = ''
UNION ALL SELECT 'duplicate_query_id', query_id FROM marked WHERE query_id <> '' AND n > 1
UNION ALL SELECT 'missing_group', query_id FROM marked WHERE group_id = ''
UNION ALL SELECT 'split', query_id FROM marked WHERE split = 'test'
UNION ALL SELECT 'missing_text', query_id FROM marked WHERE trim(query) = ''
UNION ALL SELECT 'expected', query_id FROM marked WHERE len(list_distinct(expected)) <> len(expected)
UNION ALL SELECT 'unknown_expected', query_id FROM (SELECT DISTINCT query_id, unnest(expected) AS x FROM marked) WHERE x NOT IN (SELECT image_id FROM corpus)),
pairs AS (SELECT group_id, count(*) = 2 AND count(*) FILTER (language = 'ru') = 1 AND count(*) FILTER (language = 'en') = 1 AS pair, count(DISTINCT split) AS s,
  count(DISTINCT kind) AS k, count(DISTINCT array_to_string(list_sort(list_distinct(expected)), '|')) AS e FROM evaluation_labels GROUP BY group_id),
bad_groups AS (SELECT group_id, 'pair' AS rule FROM pairs WHERE NOT pair UNION ALL SELECT group_id, 'split' FROM pairs WHERE s <> 1
UNION ALL SELECT group_id, 'kind' FROM pairs WHERE k <> 1 UNION ALL SELECT group_id, 'expected' FROM pairs WHERE e <> 1),
leaks AS (SELECT image_id, count(DISTINCT split) AS splits FROM (SELECT split, unnest(expected) AS image_id FROM evaluation_labels) GROUP BY image_id HAVING count(DISTINCT split) > 1)"""


@query(f"{LABELS}, {PROBLEMS} SELECT rule, entity_id FROM problems")
def label_rule_violations(t: Tables) -> DataFrame:
    return L.label_problems(t.evaluation_labels, corpus(t))


@query(f"{LABELS} SELECT DISTINCT query_id, x AS image_id FROM (SELECT query_id, unnest(expected) AS x FROM evaluation_labels) WHERE x NOT IN (SELECT image_id FROM corpus)")
def unknown_references(t: Tables) -> DataFrame:
    return L.unknown_references(t.evaluation_labels, corpus(t))


@query(f"{LABELS}, {PROBLEMS} SELECT group_id, rule FROM bad_groups")
def group_violations(t: Tables) -> DataFrame:
    return L.group_problems(t.evaluation_labels)


@query(f"{LABELS}, {PROBLEMS} SELECT image_id, splits FROM leaks")
def label_leakage(t: Tables) -> DataFrame:
    return L.leaked(t.evaluation_labels)


@query(f"{LABELS} SELECT kind, language, split, count(*) AS queries, count(DISTINCT group_id) AS groups FROM evaluation_labels GROUP BY ALL")
def label_counts(t: Tables) -> DataFrame:
    return L.label_counts(t.evaluation_labels)


@query(f"""{LABELS}, {PROBLEMS}, thin AS (SELECT w.kind, w.split FROM (VALUES ('visual', 'development', 14), ('visual', 'holdout', 6), ('text', 'development', 14), ('text', 'holdout', 6)) w(kind, split, least)
LEFT JOIN (SELECT kind, split, count(DISTINCT group_id) AS n FROM evaluation_labels GROUP BY ALL) h ON h.kind = w.kind AND h.split = w.split WHERE coalesce(n, 0) < least)
SELECT rule, count(*) AS n FROM (SELECT rule FROM problems UNION ALL SELECT 'group_' || rule FROM bad_groups UNION ALL SELECT 'leaked' FROM leaks UNION ALL SELECT 'thin_group' FROM thin) GROUP BY rule""")
def label_report(t: Tables) -> DataFrame:
    return L.label_report(t.evaluation_labels, corpus(t))


ODD_IMAGES = """SELECT concat('img_', substr(sha256, 1, CASE WHEN bytes % 31 = 0 THEN 11 ELSE 12 END)) AS image_id, CASE WHEN bytes % 37 = 0 THEN concat('/', relative_path) ELSE relative_path END AS relative_path,
CASE WHEN bytes % 41 = 0 THEN upper(sha256) ELSE sha256 END AS sha256, CASE WHEN bytes % 43 = 0 THEN 'other' ELSE 'clip' END AS model_id, CASE WHEN bytes % 47 = 0 THEN 2 ELSE 1 END AS schema_version,
source AS text FROM {files}"""


@query(with_tables("files") + f""", m AS ({ODD_IMAGES.format(files='files')}), c AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS i, count(*) OVER (PARTITION BY lower(relative_path)) AS p FROM m)
SELECT image_id, 'schema_version' AS rule FROM c WHERE schema_version <> 1 UNION ALL SELECT image_id, 'model' FROM c WHERE model_id <> 'clip'
UNION ALL SELECT image_id, 'hash' FROM c WHERE NOT regexp_full_match(sha256, '[0-9a-f]{{64}}') UNION ALL SELECT image_id, 'id' FROM c WHERE image_id <> 'img_' || substr(sha256, 1, 12)
UNION ALL SELECT image_id, 'duplicate_id' FROM c WHERE i > 1 UNION ALL SELECT image_id, 'duplicate_path' FROM c WHERE p > 1
UNION ALL SELECT image_id, 'path' FROM c WHERE relative_path LIKE '/%'""".replace("{{64}}", "{64}"))
def manifest_rule_violations(t: Tables) -> DataFrame:
    return L.manifest_problems(t.spark.sql(ODD_IMAGES, files=t.files), "clip", 1)


LICENSE = "CASE WHEN source IN ('src0', 'src1', 'src2') THEN concat('http://example.org/licenses/by/', source) ELSE concat('http://example.org/licenses/nc/', source) END"
SEEDED = "SELECT image_id, name, url FROM licensed ORDER BY sha256('seed' || image_id::VARCHAR) LIMIT 40"


def licensed_images(t: Tables) -> DataFrame:
    licenses = t.documents.select(F.col("source").alias("license"), F.upper("source").alias("name"), F.expr(LICENSE).alias("url")).distinct()
    return L.licensed(t.documents.select(F.col("doc_id").alias("image_id"), F.col("source").alias("license")), licenses)


@query(f"WITH licensed AS (SELECT doc_id AS image_id, upper(source) AS name, {LICENSE} AS url FROM documents WHERE {LICENSE} LIKE '%/licenses/by/%') {SEEDED}")
def licensed_sample(t: Tables) -> DataFrame:
    return L.exact_sample(licensed_images(t), "image_id", 40, "seed").select("image_id", "name", "url")


@query("SELECT doc_id FROM documents ORDER BY sha256('7' || doc_id::VARCHAR) LIMIT 25")
def seeded_sample(t: Tables) -> DataFrame:
    return L.seeded_sample(t.documents.select("doc_id"), "doc_id", 25, "7")


#: A question is a source and language, its image the source; each word of a text is an answer.
ANSWERS = r"SELECT concat(source, '-', lang) AS question_id, source AS image_id, concat(' ', word) AS answer, doc_id * 100000 + place AS place FROM {documents} LATERAL VIEW posexplode(split(text, '[ \\n]')) w AS place, word"
VOTES = r"""words AS (SELECT source || '-' || lang AS question_id, source AS image_id, doc_id, string_split_regex(text, '[ \n]') AS w FROM documents),
answers AS (SELECT question_id, image_id, lower(trim(unnest(w))) AS answer, doc_id * 100000 + generate_subscripts(w, 1) - 1 AS place FROM words),
votes AS (SELECT question_id, answer, count(*) AS votes, min(place) AS seen FROM answers GROUP BY ALL),
modal AS (SELECT question_id, answer, votes FROM votes QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, seen) = 1),
agreed AS (SELECT question_id, answer, votes FROM modal WHERE votes >= 8 AND length(answer) >= 3 AND regexp_matches(answer, '\p{L}') AND answer NOT IN """ + f"{L.EMPTY_ANSWERS})"
QUESTIONS = """images AS (SELECT image_id, min(a.question_id) AS question_id FROM agreed a JOIN (SELECT DISTINCT question_id, image_id FROM answers) q ON a.question_id = q.question_id GROUP BY image_id),
questions AS (SELECT image_id, question_id, answer FROM images JOIN agreed USING (question_id) ORDER BY sha256('seed' || image_id) LIMIT 12)"""


def answers(t: Tables) -> DataFrame:
    return t.spark.sql(ANSWERS, documents=t.documents)


@query(f"WITH {VOTES} SELECT question_id, answer, votes FROM agreed")
def consensus_answers(t: Tables) -> DataFrame:
    return L.consensus(answers(t))


@query(f"""WITH {VOTES}, {QUESTIONS}, licensed AS (SELECT doc_id AS image_id, upper(source) AS name, {LICENSE} AS url FROM documents WHERE {LICENSE} LIKE '%/licenses/by/%'),
sample AS ({SEEDED}) SELECT 'images' AS dataset, image_id::VARCHAR AS source_id, url, NULL::VARCHAR AS question_id, NULL::VARCHAR AS answer FROM sample
UNION ALL SELECT 'questions', image_id, NULL, question_id, answer FROM questions""")
def evaluation_sample(t: Tables) -> DataFrame:
    """Both halves: licensed images, and images by the first question that people agree on, each a seeded sample."""
    none = F.lit(None).cast("string")
    images = licensed_sample(t).select(F.lit("images").alias("dataset"), F.col("image_id").cast("string").alias("source_id"), "url", none.alias("question_id"), none.alias("answer"))
    given = answers(t)
    chosen = L.sampled_questions(given.select("question_id", "image_id").distinct(), given, 12, "seed", exact=True)
    return images.unionByName(chosen.select(F.lit("questions").alias("dataset"), F.col("image_id").alias("source_id"), none.alias("url"), "question_id", "answer"))


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn, text) AS captions FROM conversations GROUP BY conv_id)
SELECT doc_id AS image_id, coalesce(len(captions), 0) AS n, coalesce(array_to_string(captions, '|'), '') AS captions FROM documents LEFT JOIN c ON doc_id = conv_id""")
def captions_per_image(t: Tables) -> DataFrame:
    captions = t.conversations.select(F.col("conv_id").alias("image_id"), F.col("turn").alias("place"), F.col("text").alias("caption"))
    rows = L.with_captions(t.documents.select(F.col("doc_id").alias("image_id")), captions)
    return rows.select("image_id", F.size("captions").alias("n"), F.array_join("captions", "|").alias("captions"))


@query("SELECT source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_per_key(t: Tables) -> DataFrame:
    return L.first_per_key(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id")


@query("WITH " + fingerprint_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]) + " SELECT fingerprint FROM print")
def dataset_fingerprint(t: Tables) -> DataFrame:
    return L.fingerprint(t.documents)


@query(with_tables("files") + " SELECT sum(bytes)::BIGINT AS total_bytes, max(bytes) AS largest, sum(bytes) > 2621440000 OR max(bytes) > 5242880 AS over FROM files")
def corpus_size_caps(t: Tables) -> DataFrame:
    total, most = F.sum("bytes"), F.max("bytes")
    return t.files.agg(total.alias("total_bytes"), most.alias("largest"), ((total > 500 * (5 << 20)) | (most > 5 << 20)).alias("over"))


@query("""WITH g AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'visual' ELSE 'text' END AS kind, 1 + (doc_id // 2) % 20 AS n FROM documents)
SELECT kind || '-' || lpad(n::VARCHAR, 2, '0') || '-' || language AS query_id, kind || '-' || lpad(n::VARCHAR, 2, '0') AS group_id,
CASE WHEN n <= 14 THEN 'development' ELSE 'holdout' END AS split, language, kind FROM g, (VALUES ('ru'), ('en')) l(language)""")
def label_template(t: Tables) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 0, "visual").otherwise("text")
    groups = t.documents.select(kind.alias("kind"), (1 + F.floor(F.col("doc_id") / 2) % 20).alias("n")).distinct()
    return L.label_template(groups)


POSITIVES = "positives AS (SELECT q.vec_id // 20 AS query_id, a.vec_id AS asset_id FROM embeddings q JOIN embeddings a ON q.label = a.label AND q.vec_id <> a.vec_id AND q.vec_id % 20 = 0)"
#: Queries, and whether their case failed: null where there is no case, which counts as failed.
ASKED = """asked AS (SELECT vec_id // 20 AS query_id, CASE WHEN vec_id % 40 = 0 THEN 'ru' ELSE 'en' END AS language,
coalesce(CASE WHEN vec_id % 220 <> 200 THEN vec_id % 180 = 160 END, true) AS failed FROM embeddings WHERE vec_id % 20 = 0)"""
FIRST = f"{SIMILAR}, {POSITIVES}, firsts AS (SELECT query_id, min(rank) AS first_rank FROM visual JOIN positives USING (query_id, asset_id) WHERE rank <= 10 GROUP BY query_id)"


def positives(t: Tables, ranked: DataFrame) -> DataFrame:
    """Ranked assets of their query's own label: labels are looked up for the few that are ranked, never all pairs of a label."""
    asset = t.embeddings.select(F.col("vec_id").alias("asset_id"), F.col("label").alias("_label"))
    wanted = t.embeddings.where("vec_id % 20 = 0").select(F.floor(F.col("vec_id") / 20).alias("query_id"), F.col("vec_id").alias("_own"), F.col("label").alias("_wanted"))
    hits = ranked.select("query_id", "asset_id").join(asset, "asset_id").join(wanted, "query_id")
    return hits.where("_label = _wanted AND asset_id <> _own").select("query_id", "asset_id")


def asked(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    language, failed = F.when(v % 40 == 0, "ru").otherwise("en"), F.when(v % 220 != 200, v % 180 == 160)
    return t.embeddings.where("vec_id % 20 = 0").select(F.floor(v / 20).alias("query_id"), language.alias("language"), failed.alias("failed"))


@query(with_tables(*VISUAL_TABLES) + f", {FIRST} SELECT query_id, first_rank FROM firsts")
def first_relevant_rank(t: Tables) -> DataFrame:
    ranked = S.semantic_top_k(t.vector_queries, current_vectors(t), 10)
    return E.first_relevant(ranked, positives(t, ranked))


@query(with_tables(*VISUAL_TABLES) + f""", {FIRST}, {ASKED}, h AS (SELECT *, coalesce(first_rank <= 1, false) AND NOT failed AS h1, coalesce(first_rank <= 5, false) AND NOT failed AS h5,
CASE WHEN NOT failed THEN coalesce(1.0::DOUBLE / first_rank, 0) ELSE 0 END AS rr FROM asked LEFT JOIN firsts USING (query_id))
SELECT language, count(*) AS queries, count(*) FILTER (h1) AS hits_1, count(*) FILTER (h5) AS hits_5, avg(h1::INT) AS success_1, avg(h5::INT) AS success_5, round(avg(rr), 9) AS mrr_10, count(*) FILTER (failed) AS failed FROM h GROUP BY language""")
def retrieval_scores(t: Tables) -> DataFrame:
    ranked = S.semantic_top_k(t.vector_queries, current_vectors(t), 10)
    return E.retrieval_scores(asked(t), ranked, positives(t, ranked)).withColumn("mrr_10", F.round("mrr_10", 9))


@query("""WITH c AS (SELECT CASE WHEN doc_id % 50 = 3 THEN doc_id - 1 ELSE doc_id END AS query_id, list_transform(range(CASE WHEN doc_id % 7 = 0 THEN 9 ELSE 10 END), lambda i: CASE WHEN doc_id % 11 = 0 AND i = 1 THEN doc_id ELSE doc_id + i END) AS ids,
CASE WHEN doc_id % 13 = 0 THEN ' ' WHEN doc_id % 17 = 0 THEN 'x' END AS error FROM documents WHERE doc_id < (SELECT max(doc_id) - 8 FROM documents)),
m AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM c), k AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 4)
SELECT query_id, 'unknown_query' AS rule FROM m WHERE query_id NOT IN (SELECT doc_id FROM k) UNION ALL SELECT query_id, 'duplicate_query' FROM m WHERE n > 1
UNION ALL SELECT query_id, 'duplicate_id' FROM m WHERE len(list_distinct(ids)) <> len(ids) UNION ALL SELECT query_id, 'count' FROM m WHERE error IS NULL AND len(ids) <> 10
UNION ALL SELECT query_id, 'error' FROM m WHERE trim(error) = '' UNION ALL SELECT DISTINCT query_id, 'unknown_id' FROM (SELECT query_id, unnest(ids) AS x FROM m) WHERE x NOT IN (SELECT doc_id FROM documents)""")
def ranking_rule_violations(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    ids = F.transform(F.sequence(F.lit(0), F.when(d % 7 == 0, 8).otherwise(9)), lambda i: F.when((d % 11 == 0) & (i == 1), d).otherwise(d + i))
    last = t.documents.agg((F.max("doc_id") - 8).alias("last"))
    cases = t.documents.crossJoin(last).where("doc_id < last").select(
        F.when(d % 50 == 3, d - 1).otherwise(d).alias("query_id"), ids.alias("ranked_ids"), F.when(d % 13 == 0, " ").when(d % 17 == 0, "x").alias("error")
    )
    known = t.documents.where("doc_id % 5 <> 4").select(d.alias("query_id"))
    return E.ranking_problems(cases, known, t.documents.select(d.alias("asset_id")))


NUDGED = "list_transform(embedding::DOUBLE[], lambda x, i: x + 0.001 * ((vec_id + i - 1) % 7))"


@query(f"""WITH p AS (SELECT vec_id AS name, embedding::DOUBLE[] AS a, {NUDGED} AS r FROM embeddings),
e AS (SELECT *, list_transform(range(len(a)), lambda i: abs(a[i + 1] - r[i + 1])) AS d, list_inner_product(a, r) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(r, r))) AS c FROM p)
SELECT name, round(list_sum(d) / len(d), 9) AS mean_error, round(list_max(d), 9) AS max_error, round(c, 9) AS cosine, c >= 0.999 AS passed FROM e""")
def vector_parity(t: Tables) -> DataFrame:
    moved = F.transform(F.col("embedding"), lambda x, i: x.cast("double") + 0.001 * ((F.col("vec_id") + i) % 7))
    reference = t.embeddings.select(F.col("vec_id").alias("name"), moved.alias("v"))
    rows = E.vector_parity(t.embeddings.select(F.col("vec_id").alias("name"), F.col("embedding").alias("v")), reference)
    return rows.withColumns({c: F.round(c, 9) for c in ("mean_error", "max_error", "cosine")})


@query(f"""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v, {NUDGED} AS w FROM embeddings)
SELECT t.vec_id AS text_id, round(max(abs(list_inner_product(i.v, t.v) - list_inner_product(i.w, t.w))), 9) AS drift FROM p i, p t WHERE t.vec_id % 20 = 0 GROUP BY t.vec_id""")
def similarity_drift(t: Tables) -> DataFrame:
    moved = F.transform(F.col("embedding"), lambda x, i: x.cast("double") + 0.001 * ((F.col("vec_id") + i) % 7))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), moved.alias("w"))
    return E.similarity_drift(rows, rows.where("id % 20 = 0")).withColumn("drift", F.round("drift", 9))


PARITY, DRIFT = ORACLES["vector_parity"], ORACLES["similarity_drift"]


@query(f"""SELECT cases, min_cosine, max_drift, all_passed AND max_drift <= 0.01 AS passed FROM
(SELECT count(*) AS cases, min(cosine) AS min_cosine, bool_and(passed) AS all_passed FROM ({PARITY})), (SELECT max(drift) AS max_drift FROM ({DRIFT}))""")
def parity_summary(t: Tables) -> DataFrame:
    """The whole run: the smallest cosine of any case, the largest drift of any pair, and whether all pass."""
    return E.parity_summary(vector_parity(t), similarity_drift(t))


@query("""WITH s AS (SELECT doc_id, n_chars * 40 - 400 AS w, 1 + (n_chars * 7) % 5000 AS h FROM documents)
SELECT doc_id, CASE WHEN w <= 0 OR h <= 0 THEN 'invalidImage' WHEN w > 65536 OR h > 65536 OR w * h > 100000000 THEN 'imageTooLarge' END AS problem,
CASE WHEN w > 0 AND w <= 65536 AND w * h <= 100000000 THEN greatest(1, floor(greatest(w, h) * least(1.0::DOUBLE, 1600.0::DOUBLE / least(w, h), sqrt(24000000.0::DOUBLE / (w::DOUBLE * h)))))::INT END AS edge FROM s""")
def decode_rules(t: Tables) -> DataFrame:
    w, h = F.col("n_chars") * 40 - 400, 1 + (F.col("n_chars") * 7) % 5000
    rows = t.documents.select("doc_id", w.alias("w"), h.alias("h")).withColumn("problem", G.decode_problem(F.col("w"), F.col("h")))
    return rows.select("doc_id", "problem", F.when(F.col("problem").isNull(), G.thumbnail_edge(F.col("w"), F.col("h"))).alias("edge"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)
SELECT event_type AS name, max(value) FILTER (n = 1) AS cold_ms, count(*) FILTER (n > 1) AS warm_calls, round(median(value) FILTER (n > 1), 9) AS warm_median, min(value) FILTER (n > 1) AS warm_min, max(value) FILTER (n > 1) AS warm_max FROM c GROUP BY event_type""")
def latency_summary(t: Tables) -> DataFrame:
    calls = t.events.select(F.col("event_type").alias("name"), F.col("ts").alias("started"), F.col("event_id").alias("seq"), F.col("value").alias("ms"))
    return E.latency_summary(calls).withColumn("warm_median", F.round("warm_median", 9))


@query("""WITH h AS (SELECT doc_id AS text_id, lang AS language, (1 + doc_id % 10) / 10.0::DOUBLE AS confidence FROM documents
UNION ALL SELECT doc_id, 'xx', ((doc_id // 10) % 10) / 10.0::DOUBLE FROM documents), r AS (SELECT *, row_number() OVER w AS n, lead(confidence) OVER w AS second FROM h WINDOW w AS (PARTITION BY text_id ORDER BY confidence DESC, language DESC))
SELECT text_id, CASE WHEN confidence >= 0.8 AND confidence - coalesce(second, 0) >= 0.2 THEN language END AS language FROM r WHERE n = 1""")
def language_margin(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    own = t.documents.select(d.alias("text_id"), F.col("lang").alias("language"), ((1 + d % 10) / F.lit(10.0)).alias("confidence"))
    other = t.documents.select(d.alias("text_id"), F.lit("xx").alias("language"), (F.floor(d / 10) % 10 / F.lit(10.0)).alias("confidence"))
    return E.best_language(own.unionByName(other))


BOX = """SELECT doc_id // 2 AS asset_id, cast(doc_id % 2 AS int) AS tile, cast(doc_id % 7 AS int) AS seq, source AS text, 0.5 + (doc_id % 5) / 10.0 AS confidence, doc_id % 3 = 0 AS interior,
0.1 + 0.01 * (doc_id % 4) AS x, 0.2 + 0.01 * (doc_id % 3) AS y, 0.5 AS w, 0.1 AS h FROM documents"""


def boxes(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    num = lambda base, step, mod: (F.lit(base) + F.lit(step) * (d % mod)).cast("double")
    return t.documents.select(
        F.floor(d / 2).alias("asset_id"), (d % 2).cast("int").alias("tile"), (d % 7).cast("int").alias("seq"), F.col("source").alias("text"),
        (0.5 + (d % 5) / 10.0).alias("confidence"), (d % 3 == 0).alias("interior"), num(0.1, 0.01, 4).alias("x"), num(0.2, 0.01, 3).alias("y"),
        F.lit(0.5).alias("w"), F.lit(0.1).alias("h"),
    )


@query(f"""WITH b AS (SELECT asset_id, tile, seq, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM ({BOX})),
p AS (SELECT a.asset_id, a.tile, a.seq, c.tile AS other_tile, c.seq AS other_seq, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x) AS wide, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y) AS high, a.w * a.h AS s, c.w * c.h AS u, a.h AS ah, c.h AS ch
FROM b a JOIN b c ON a.asset_id = c.asset_id AND a.tile < c.tile)
SELECT asset_id, tile, seq, other_tile, other_seq, round(wide * high / least(s, u), 9) AS overlap FROM p WHERE wide > 0 AND high > 0 AND wide * high / least(s, u) >= 0.6 AND high / least(ah, ch) >= 0.7""")
def box_overlaps(t: Tables) -> DataFrame:
    return N.box_overlaps(boxes(t)).withColumn("overlap", F.round("overlap", 9))


@query()
def merged_lines(t: Tables) -> DataFrame:
    return N.merge_lines(boxes(t))


@query("""WITH l AS (SELECT doc_id, doc_id % 5 AS revision, len(string_split(text, chr(10))) AS n, (doc_id % 12) / 10.0 AS confidence, (doc_id % 10) / 10.0 AS x, [z FOR z IN string_split(text, chr(10)) IF trim(z) = ''] AS blank FROM documents)
SELECT doc_id, 'revision' AS rule FROM l WHERE revision NOT BETWEEN 1 AND 3 UNION ALL SELECT doc_id, 'confidence' FROM l WHERE confidence > 1
UNION ALL SELECT doc_id, 'box' FROM l WHERE x > 0.5 UNION ALL SELECT doc_id, 'text' FROM l WHERE len(blank) > 0""")
def ocr_lines_quality(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    line = lambda s: F.struct(
        s.alias("text"), ((d % 12) / 10.0).alias("confidence"), ((d % 10) / 10.0).alias("x"), F.lit(0.1).alias("y"), F.lit(0.5).alias("w"), F.lit(0.1).alias("h")
    )
    lines = F.transform(F.split("text", "\n"), line)
    return t.documents.select("doc_id", F.explode(N.result_problems((d % 5).cast("int"), F.array(F.lit("ru"), F.lit("en")), lines)).alias("rule"))


@query("SELECT doc_id, text AS joined FROM documents")
def joined_texts(t: Tables) -> DataFrame:
    """Recognised lines joined again: the lines of a text give the text."""
    lines = F.transform(F.split("text", "\n", -1), lambda s: F.struct(s.alias("text")))
    return t.documents.select("doc_id", N.joined_text(lines).alias("joined"))


TILES = """axis AS (SELECT doc_id, n_chars AS width, 3000 AS height FROM documents WHERE n_chars > 0),
tx AS (SELECT doc_id, width, unnest(range(0, (greatest(ceil((width - 2048) / 1792), 0) * 1792 + 1)::BIGINT, 1792)) AS x FROM axis),
ty AS (SELECT doc_id, height, unnest(range(0, (greatest(ceil((height - 2048) / 1792), 0) * 1792 + 1)::BIGINT, 1792)) AS y FROM axis),
tiles AS (SELECT doc_id, width, height, (row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, x) - 1)::INT AS tile, x::INT AS x, y::INT AS y, least(2048, width - x)::INT AS tile_width, least(2048, height - y)::INT AS tile_height FROM tx JOIN ty USING (doc_id))"""


def tiles(t: Tables) -> DataFrame:
    return G.tile_plan(t.documents.where("n_chars > 0").select("doc_id", F.col("n_chars").alias("width"), F.lit(3000).alias("height")))


@query(f"WITH {TILES} SELECT * FROM tiles")
def tile_plan(t: Tables) -> DataFrame:
    return tiles(t)


@query(f"""WITH {TILES} SELECT doc_id, tile, round((x + 0.25 * tile_width) / width, 9) AS bx, round((y + 0.002 * tile_height) / height, 9) AS "by", round(0.5 * tile_width / width, 9) AS bw, round(0.25 * tile_height / height, 9) AS bh,
(x = 0 OR 0.25 * tile_width >= 8) AND (y = 0 OR 0.002 * tile_height >= 8) AND (x + tile_width = width OR 0.25 * tile_width >= 8) AND (y + tile_height = height OR 0.748 * tile_height >= 8) AS interior FROM tiles""")
def mapped_boxes(t: Tables) -> DataFrame:
    box = {c: F.lit(v) for c, v in zip("xywh", (0.25, 0.002, 0.5, 0.25), strict=True)}
    tile = {"x": F.col("x"), "y": F.col("y"), "width": F.col("tile_width"), "height": F.col("tile_height")}
    m = G.mapped_box(box, tile, {"width": F.col("width"), "height": F.col("height")})
    return tiles(t).select("doc_id", "tile", *[F.round(m[c], 9).alias(f"b{c}") for c in "xywh"], m["interior"].alias("interior"))


@query("""WITH s AS (SELECT doc_id, 1 + n_chars AS w, 1 + (n_chars * 7) % 5000 AS h FROM documents)
SELECT doc_id, CASE WHEN w <= h THEN 224 ELSE 224 * w // h END AS resized_width, CASE WHEN h <= w THEN 224 ELSE 224 * h // w END AS resized_height,
round_even((CASE WHEN w <= h THEN 224 ELSE 224 * w // h END - 224) / 2.0, 0)::INT AS crop_x, round_even((CASE WHEN h <= w THEN 224 ELSE 224 * h // w END - 224) / 2.0, 0)::INT AS crop_y,
greatest(1, floor(greatest(w, h) * least(1.0::DOUBLE, 1600.0::DOUBLE / least(w, h), sqrt(24000000.0::DOUBLE / (w::DOUBLE * h)))))::INT AS edge FROM s""")
def resize_geometry(t: Tables) -> DataFrame:
    w, h = 1 + F.col("n_chars"), 1 + (F.col("n_chars") * 7) % 5000
    g = G.resize_geometry(w, h)
    return t.documents.select("doc_id", *[c.alias(n) for n, c in g.items()], G.thumbnail_edge(w, h).alias("edge"))


@query()
def embed_documents(t: Tables) -> DataFrame:
    """A pluggable encoder over the documents; here a hash encoder, since no model is shipped."""
    vector = encoders.encoder_udf(encoders.hash_encoder, dimension=16)
    return t.documents.select("doc_id", vector("text").alias("embedding"))


@query()
def prepared_queries(t: Tables) -> DataFrame:
    """Queries routed by language, translated where needed, and encoded; the original text stays."""
    prepared = encoders.prepare_queries(t.text_queries, encoders.script_detector, encoders.upper_translator, encoders.hash_encoder, 16)
    return prepared.withColumn("script", script_of(F.col("original_text")))
