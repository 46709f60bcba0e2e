"""Evaluation sets: inventory by content, rule suites, sampling, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import safe_path
from tidepool.functions.vectors import broken
from tidepool.operators.counts import with_repeats

#: What counts as an image file, the label enums, and the smallest set.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "tif", "tiff", "webp")
SPLITS, LANGUAGES, LABEL_KINDS = ("development", "holdout"), ("ru", "en"), ("visual", "text")
LEAST_GROUPS = {"development": 14, "holdout": 6}
#: Answers that say nothing about an image.
EMPTY_ANSWERS = (
    "yes", "no", "none", "unknown", "unanswerable", "nothing", "unreadable",
    "black", "white", "red", "blue", "green", "yellow", "orange", "pink",
    "purple", "brown", "gray", "grey", "silver", "gold", "left", "right",
    "top", "bottom", "up", "down", "one", "two", "three", "four", "five",
    "six", "seven", "eight", "nine", "ten",
)


def short_id(sha: Column) -> Column:
    return F.concat(F.lit("img_"), F.substring(sha, 1, 12))


def inventory(files: DataFrame) -> DataFrame:
    """(image_id, relative_path, sha256, copies) of distinct contents of (relative_path, sha256)."""
    rows = files.groupBy("sha256").agg(F.min("relative_path").alias("relative_path"), F.count("*").alias("copies"))
    return rows.select(short_id(F.col("sha256")).alias("image_id"), "relative_path", "sha256", "copies")


def id_collisions(files: DataFrame) -> DataFrame:
    """Short ids that stand for more than one content."""
    ids = files.select("sha256").distinct().withColumn("image_id", short_id(F.col("sha256")))
    return ids.groupBy("image_id").agg(F.count("*").alias("contents")).where(F.col("contents") > 1)


def table_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side only, as often as they lack on the other, with ``side``."""
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def inventory_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(relative_path, state): missing, unexpected or changed, by (relative_path, sha256)."""
    e = expected.select("relative_path", F.col("sha256").alias("_e"))
    a = actual.select("relative_path", F.col("sha256").alias("_a"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("changed")
    both = e.join(a, "relative_path", "full_outer").where(~F.col("_e").eqNullSafe(F.col("_a")))
    return both.select("relative_path", state.alias("state"))


def label_problems(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule, entity_id) of label rows (query_id, group_id, split, language, kind, query, expected array)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    expected = F.coalesce("expected", F.array().cast("array<string>"))
    rules = [
        ("blank_query_id", blank("query_id")),
        ("duplicate_query_id", ~blank("query_id") & (F.col("_same") > 1)),
        ("missing_group", blank("group_id")),
        ("split", ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))),
        ("language", ~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False))),
        ("kind", ~F.coalesce(F.col("kind").isin(*LABEL_KINDS), F.lit(False))),
        ("missing_text", blank("query")),
        ("expected", (F.size(expected) == 0) | F.exists(expected, lambda x: x == "") | (F.size(F.array_distinct(expected)) != F.size(expected))),
    ]
    counted = with_repeats(labels, F.col("query_id"), "_same")
    rows = counted.select(F.explode(broken(rules)).alias("rule"), F.col("query_id").alias("entity_id"))
    return rows.unionByName(unknown_references(labels, corpus).select(F.lit("unknown_expected").alias("rule"), F.col("query_id").alias("entity_id")))


def unknown_references(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, image_id) of expected ids that the corpus (image_id) lacks."""
    asked = labels.select("query_id", F.explode("expected").alias("image_id")).where(F.col("image_id") != "").distinct()
    return asked.join(corpus.select("image_id"), "image_id", "left_anti").select("query_id", "image_id")


def group_problems(labels: DataFrame) -> DataFrame:
    """(group_id, rule): a group is one row of each language, in one split and kind, with one expected set."""
    key = F.concat_ws("|", F.array_sort(F.array_distinct("expected")))
    each = [F.count_if(F.col("language") == x).alias(x) for x in LANGUAGES]
    one = [F.countDistinct(c).alias(f"n_{n}") for n, c in (("split", F.col("split")), ("kind", F.col("kind")), ("expected", key))]
    groups = labels.groupBy("group_id").agg(F.count("*").alias("n"), *each, *one)
    pair = (F.col("n") == len(LANGUAGES)) & (F.col("ru") == 1) & (F.col("en") == 1)
    rules = [("pair", ~pair)] + [(n, F.col(f"n_{n}") != 1) for n in ("split", "kind", "expected")]
    return groups.select("group_id", F.explode(broken(rules)).alias("rule"))


def leaked(labels: DataFrame) -> DataFrame:
    """Expected ids that more than one split uses."""
    ids = labels.select("split", F.explode("expected").alias("image_id"))
    return ids.groupBy("image_id").agg(F.countDistinct("split").alias("splits")).where(F.col("splits") > 1)


def thin_groups(labels: DataFrame) -> DataFrame:
    """(kind, split, groups) with fewer groups than a set needs; all combinations are looked at."""
    least = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("split"), F.lit(n).alias("least")) for k in LABEL_KINDS for s, n in LEAST_GROUPS.items()]))
    wanted = labels.sparkSession.range(1).select(least.alias("w")).select("w.*")
    have = labels.groupBy("kind", "split").agg(F.countDistinct("group_id").alias("groups"))
    rows = F.broadcast(wanted).join(have, ["kind", "split"], "left").withColumn("groups", F.coalesce("groups", F.lit(0)))
    return rows.where(F.col("groups") < F.col("least")).select("kind", "split", "groups")


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("kind", "language", "split").agg(F.count("*").alias("queries"), F.countDistinct("group_id").alias("groups"))


def manifest_problems(images: DataFrame, model: str, version: int) -> DataFrame:
    """(image_id, rule) of (image_id, relative_path, sha256, model_id, schema_version, text)."""
    counted = with_repeats(with_repeats(images, F.col("image_id"), "_ids"), F.lower("relative_path"), "_paths")
    rules = [
        ("schema_version", ~F.col("schema_version").eqNullSafe(F.lit(version))),
        ("model", ~F.col("model_id").eqNullSafe(F.lit(model))),
        ("hash", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("id", ~F.col("image_id").eqNullSafe(short_id(F.col("sha256")))),
        ("duplicate_id", F.col("_ids") > 1),
        ("duplicate_path", F.col("_paths") > 1),
        ("path", ~safe_path(F.col("relative_path"))),
        ("text", F.octet_length("text") > 16_384),
    ]
    return counted.select("image_id", F.explode(broken(rules)).alias("rule"))


def seeded_sample(rows: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of a seeded hash of the id, whatever the order of the input."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256)).limit(n)


def exact_sample(rows: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """A seeded sample of n rows; fewer candidates are an error, never a smaller sample."""
    found = seeded_sample(rows, id_col, n, seed)
    if (there := found.count()) < n:
        raise ValueError(f"{n} rows are asked for, and {there} pass the filters")
    return found


def modal_answers(answers: DataFrame) -> DataFrame:
    """(question_id, answer, votes): the most frequent trimmed lower-case answer, ties to the first seen."""
    clean = answers.select("question_id", F.lower(F.trim("answer")).alias("answer"), "place")
    votes = clean.groupBy("question_id", "answer").agg(F.count("*").alias("votes"), F.min("place").alias("seen"))
    best = F.max_by(F.struct("answer", "votes"), F.struct("votes", -F.col("seen")))
    return votes.groupBy("question_id").agg(best.alias("b")).select("question_id", "b.answer", "b.votes")


def consensus(answers: DataFrame, least_votes: int = 8) -> DataFrame:
    """Modal answers that enough people gave and that say something."""
    a = F.col("answer")
    return modal_answers(answers).where(
        (F.col("votes") >= least_votes) & (F.length(a) >= 3) & a.rlike(r"\p{L}") & ~a.isin(*EMPTY_ANSWERS)
    )


def sampled_questions(questions: DataFrame, answers: DataFrame, n: int, seed: str, least_votes: int = 8, exact: bool = False) -> DataFrame:
    """(image_id, question_id, answer, votes): of each image the question (question_id, image_id) with the lowest id
    that has a consensus answer, and of these images a seeded sample of ``n``;
    with ``exact``, fewer are an error."""
    agreed = questions.join(consensus(answers, least_votes), "question_id")
    return (exact_sample if exact else seeded_sample)(first_per_key(agreed, "image_id", "question_id"), "image_id", n, seed)


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the lowest order value of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def licensed(images: DataFrame, licenses: DataFrame) -> DataFrame:
    """Images whose license is an attribution license, with its name and url; licenses are a short lookup."""
    allowed = licenses.where(F.col("url").contains("/licenses/by/"))
    return images.join(allowed, "license")


def with_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Images with their captions in order, an empty list where there are none."""
    lists = captions.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "caption"))), lambda x: x["caption"]).alias("captions"))
    return images.join(lists, "image_id", "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>")))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row, fingerprint: the same for the same rows in any order and partitioning.

    Each row is hashed as compact JSON of its columns in name order; the digest's four
    quarters, of fifteen hex digits each, are summed over all rows, and the row count and
    sums are hashed. Sums are pre-aggregated, so no task holds more than one row's hash.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    quarter = lambda i: F.conv(F.substring("h", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(quarter(i)), F.lit(0)).cast("string") for i in range(4)]
    whole = F.concat_ws(":", F.count("*").cast("string"), *sums)
    return rows.select(digest.alias("h")).agg(F.sha2(whole, 256).alias("fingerprint"))


def label_template(groups: DataFrame) -> DataFrame:
    """Empty label rows for (kind, n): both languages, the first 14 of 20 groups for development."""
    languages = F.explode(F.array(*map(F.lit, LANGUAGES)))
    rows = groups.select("kind", "n", languages.alias("language"))
    group = F.concat_ws("-", "kind", F.lpad(F.col("n").cast("string"), 2, "0"))
    split = F.when(F.col("n") <= LEAST_GROUPS["development"], "development").otherwise("holdout")
    return rows.select(F.concat_ws("-", group, "language").alias("query_id"), group.alias("group_id"), split.alias("split"), "language", "kind")


def label_report(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule, n) of all suites, the way a freeze asks for it: no rows mean a valid set."""
    suites = [
        label_problems(labels, corpus).select("rule"),
        group_problems(labels).select(F.concat(F.lit("group_"), "rule").alias("rule")),
        leaked(labels).select(F.lit("leaked").alias("rule")),
        thin_groups(labels).select(F.lit("thin_group").alias("rule")),
    ]
    rows = suites[0]
    for s in suites[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("rule").agg(F.count("*").alias("n"))
