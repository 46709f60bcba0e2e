"""The library's tables, derived from the given ones by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.text import _latin_fold
from tidepool.operators.stage_machine import running_counts
from tidepool.sources.shared import shared_folder
from tidepool.sources.tables import Index, publish_index, read_index
from tidepool.sources.word_segments import WordIndex, build_words, read_words

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: name -> (given or derived tables it reads, SQL)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "assets": (
        ("documents",),
        """SELECT doc_id AS asset_id, n_chars AS width, length(lang) + 1 AS height, 1577836800 + 60 * doc_id AS creation_s,
           CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1577923200 + 60 * doc_id END AS modification_s, doc_id % 97 = 0 AS hidden
           FROM {documents}""",
    ),
    "snapshot": (
        ("documents",),
        """SELECT asset_id, width, height, creation_s, modification_s FROM (
           SELECT doc_id AS asset_id, n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS width, length(lang) + 1 AS height,
           1577836800 + 60 * doc_id AS creation_s, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1577923200 + 60 * doc_id END AS modification_s
           FROM {documents} WHERE doc_id % 11 <> 0
           UNION ALL SELECT doc_id + 100000000, n_chars, length(lang) + 1, 1577836800 + 60 * doc_id, NULL FROM {documents} WHERE doc_id % 17 = 0) s""",
    ),
    "invalidated": (("documents",), "SELECT doc_id AS asset_id FROM {documents} WHERE doc_id % 19 = 0"),
    "stages": (
        ("documents", "embeddings"),
        """SELECT d.doc_id AS asset_id, 'embedding' AS kind, CASE WHEN d.doc_id % 5 = 0 THEN 'clip-old' ELSE 'clip-1' END AS version,
           CASE WHEN v.vec_id IS NOT NULL THEN 'complete' WHEN d.doc_id % 4 = 0 THEN 'pending' WHEN d.doc_id % 4 = 1 THEN 'processing'
                WHEN d.doc_id % 4 = 2 THEN 'requiresDownload' ELSE 'failed' END AS status
           FROM {documents} d LEFT JOIN {embeddings} v ON d.doc_id = v.vec_id
           UNION ALL SELECT doc_id, 'ocr', CASE WHEN doc_id % 10 = 0 THEN 'ocr-old' ELSE 'ocr-1' END,
           CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'complete' END FROM {documents}""",
    ),
    "texts": (("documents",), "SELECT doc_id AS asset_id, text FROM {documents}"),
    # Texts as of the snapshot: changed and invalidated ones are read anew, removed ones are gone.
    "next_texts": (
        ("documents",),
        """SELECT doc_id AS asset_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 19 = 0 THEN concat(substr(text, 20, 300), ' ', source) ELSE text END AS text
           FROM {documents} WHERE doc_id % 11 <> 0
           UNION ALL SELECT doc_id + 100000000, text FROM {documents} WHERE doc_id % 17 = 0""",
    ),
    "vectors": (("embeddings",), "SELECT vec_id AS asset_id, CASE WHEN vec_id % 50 = 49 THEN 'old' ELSE 'clip' END AS model_id, embedding FROM {embeddings}"),
    "current_vectors": (
        ("vectors", "stages"),
        """SELECT v.asset_id, v.model_id, v.embedding FROM {vectors} v JOIN {stages} g ON v.asset_id = g.asset_id
           WHERE g.kind = 'embedding' AND g.version = 'clip-1' AND g.status = 'complete'""",
    ),
    "vector_queries": (
        ("embeddings",),
        """SELECT cast(vec_id / 20 AS bigint) AS query_id, CASE WHEN vec_id = 140 THEN 'other' ELSE 'clip' END AS model_id, embedding
           FROM {embeddings} WHERE vec_id % 20 = 0""",
    ),
    # Whole items, many of which are too long for a query, and each of their sentences.
    "text_queries": (
        ("benchmark",),
        r"""SELECT item_id AS query_id, text FROM {benchmark}
           UNION ALL SELECT 1000000 + 1000 * item_id + place, sentence FROM {benchmark} LATERAL VIEW posexplode(split(text, '[.\\n]')) s AS place, sentence""",
    ),
    "files": (
        ("documents",),
        "SELECT concat('docs/', lpad(cast(doc_id AS string), 10, '0'), '.txt') AS relative_path, sha2(text, 256) AS sha256, n_chars AS bytes, source FROM {documents}",
    ),
    "evaluation_labels": (
        ("documents",),
        """SELECT CASE WHEN doc_id % 40 = 39 THEN '' WHEN doc_id % 30 = 29 THEN concat('q', cast(doc_id - 1 AS string)) ELSE concat('q', cast(doc_id AS string)) END AS query_id,
           CASE WHEN doc_id % 50 = 49 THEN '' ELSE concat('g', cast((doc_id - doc_id % 2) AS string)) END AS group_id,
           CASE WHEN doc_id % 70 = 69 THEN 'test' WHEN doc_id % 20 < 14 THEN 'development' ELSE 'holdout' END AS split,
           CASE WHEN doc_id % 2 = 0 THEN 'ru' ELSE 'en' END AS language, CASE WHEN doc_id % 60 < 30 THEN 'visual' ELSE 'text' END AS kind,
           CASE WHEN doc_id % 45 = 44 THEN ' ' ELSE lang END AS query,
           array(cast(doc_id - doc_id % 2 AS string), cast((doc_id * 7) % 1009 AS string)) AS expected FROM {documents}""",
    ),
    # A result answers the first begin since the last result or upsert; some carry an old generation, version or attempt.
    "log": (
        ("begun",),
        """SELECT user_id AS `key`, ts, event_id AS seq,
           CASE WHEN event_type = 'signup' THEN 'upsert' WHEN event_type = 'click' THEN 'begin'
             WHEN event_type = 'purchase' AND ticket IS NOT NULL THEN CASE WHEN event_id % 4 = 1 THEN 'complete' ELSE 'cancel' END
             WHEN event_type = 'error' AND ticket IS NOT NULL THEN CASE WHEN event_id % 4 = 1 THEN 'needsDownload' ELSE 'fail' END
             ELSE CASE WHEN event_id % 50 = 2 THEN 'recover' WHEN event_id % 3 = 1 THEN 'retryDownloads' ELSE 'retry' END END AS event,
           event_type = 'signup' AS changed,
           CASE WHEN event_type IN ('purchase', 'error') THEN ticket - CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END END AS attempt,
           CASE WHEN event_type IN ('purchase', 'error') AND ticket IS NOT NULL THEN generation - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END END AS generation,
           CASE WHEN event_type = 'signup' THEN 'v1' WHEN event_type IN ('purchase', 'error') AND ticket IS NOT NULL THEN CASE WHEN event_id % 17 = 0 THEN 'v0' ELSE 'v1' END END AS version
           FROM {begun}""",
    ),
    # Requests and answers, in a time that runs five thousand times as fast.
    "requests": (("log",), "SELECT seq AS request, ts FROM {log} WHERE event = 'begin'"),
    "answers": (("log",), "SELECT attempt AS request, ts, seq FROM {log} WHERE attempt IS NOT NULL"),
}


#: Folders of the indexes that this process has published, by session and state of the given tables.
_PUBLISHED: dict[tuple, str] = {}


class Tables:
    """Given tables of a folder, and the derived ones, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in DERIVED:
                reads, sql = DERIVED[name]
                self._known[name] = self.spark.sql(sql, **{r: getattr(self, r) for r in reads})
            elif name in GIVEN:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._known[name]

    def _published(self, part: str, build: Callable[[str], object]) -> str:
        """Where a part of this folder's index is: published once in the session to the shared folder, and searched there."""
        at = lambda name: self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        files = lambda path: path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        marks = []
        for name in ("documents", "embeddings"):
            path = at(f"{self.sf_dir}/{name}.parquet")
            marks += [files(path).getContentSummary(path).getLength(), files(path).getFileStatus(path).getModificationTime()]
        key = (part, self.spark.sparkContext.applicationId, self.sf_dir, *marks)
        root = _PUBLISHED.get(key)
        if not root or not files(at(root)).exists(at(f"{root}/{part}")):  # the folder may have been cleared
            root = f"{shared_folder(self.spark)}/index-{uuid.uuid4().hex}"
            build(root)
            _PUBLISHED[key] = root
        return root

    @cached_property
    def index(self) -> Index:
        """Assets, stages and texts in place, and the published vectors; a search of vectors alone tokenizes nothing."""
        in_place = (self.assets, self.stages, self.texts)
        root = self._published("vectors/_current_versions", lambda root: publish_index(*in_place, self.vectors, root, copies=False))
        return read_index(self.spark, root, in_place)

    @cached_property
    def words_root(self) -> str:
        return self._published("words/segments", lambda root: build_words(self.texts, f"{root}/words")) + "/words"

    @cached_property
    def words(self) -> WordIndex:
        return read_words(self.spark, self.words_root)

    @cached_property
    def begun(self) -> DataFrame:
        """Events with their user's generation, and the first click since the last signup or result before each."""
        kind = F.col("event_type")
        rows = self.events.withColumns({"key": F.col("user_id"), "seq": F.col("event_id")})
        rows = running_counts(rows, {"generation": kind == "signup"})
        rows = running_counts(rows, {"_group": kind.isin("signup", "purchase", "error")}, own=False)
        first = rows.where(kind == "click").groupBy("key", "_group").agg(F.min_by("seq", F.struct("ts", "seq")).alias("ticket"))
        return rows.join(first, ["key", "_group"], "left").drop("key", "seq", "_group")

    @cached_property
    def visible(self) -> DataFrame:
        return self.assets.where("NOT hidden")


_DUCK = {
    "text_queries": r"""SELECT item_id AS query_id, text FROM benchmark
                        UNION ALL SELECT 1000000 + 1000 * item_id + generate_subscripts(s, 1) - 1, unnest(s)
                        FROM (SELECT item_id, string_split_regex(text, '[.\n]') AS s FROM benchmark)""",
    "begun": """SELECT *, arg_min(CASE WHEN event_type = 'click' THEN event_id END, CASE WHEN event_type = 'click' THEN (ts, event_id) END) OVER (PARTITION BY user_id, g) AS ticket
                FROM (SELECT *, cast(count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS int) AS generation,
                count(*) FILTER (event_type IN ('signup', 'purchase', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM events)""",
    "files": "SELECT concat('docs/', lpad(doc_id::VARCHAR, 10, '0'), '.txt') AS relative_path, sha256(text) AS sha256, n_chars AS bytes, source FROM documents",
}

#: Tokens as the index folds them, in DuckDB.
TOKENS = "regexp_extract_all(regexp_replace(translate(lower({0}), '%s', '%s'), '([a-z])\\p{{Mn}}+', '\\1', 'g'), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*')" % _latin_fold()


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


def duck(name: str) -> str:
    """``name AS (...)`` for DuckDB."""
    if name in _DUCK:
        return f"{name} AS ({_DUCK[name]})"
    reads, sql = DERIVED[name]
    sql = sql.replace("`", '"').replace("AS string)", "AS VARCHAR)").replace("array(cast", "list_value(cast")
    return f"{name} AS ({sql.format(**{r: r for r in reads})})"


def with_tables(*names: str, recursive: bool = False) -> str:
    """The WITH clause of derived tables, to be followed by more of them or a SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(map(duck, names))
