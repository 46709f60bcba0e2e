"""The trie of conversations that share their first turns, found by blocks of turns.

A prefix is named by a sum of hashes of its turns and their places. Conversations are grouped
by blocks of BLOCK turns first. Where one block alone follows a prefix, its turns are nodes as
they are; only where siblings diverge within a block are its turns told apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import Scratch, join_sized

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a block; blocks of a conversation, and depths of an owner, whose prefix sums share a window.
BLOCK, SPAN = 4, 1024
#: Conversations that end at one node whose ids are joined in a row; more are joined in chunks of so many.
ENDS = 4096
PARTS = "abcd"


def _zero() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(x) for x in PARTS])


def _plus(one: Column, other: Column) -> Column:
    return F.struct(*[(one[x] + other[x]).alias(x) for x in PARTS])


def _sums(name: str = "") -> list[Column]:
    return [F.sum(f"{name}{x}").alias(x) for x in PARTS]


def number_turns(turns: DataFrame, scratch: Scratch, name: str = "turns") -> DataFrame:
    """``turns`` with pos, the place of each within its conversation by (turn, role, digest), from 0.

    Rows are dealt by ranges of that order, so a conversation with many of all turns lies in
    many tasks; each counts its own, and the few that lie across a border, two a partition at
    most, add what is before them.
    """
    order = ["conv_id", "turn", "role", "digest"]
    dealt = turns.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order, "_at").sortWithinPartitions(*order).drop("_at", "turn", "role")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column("conv_id").to_numpy()
            heads = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            local = np.arange(len(conv)) - np.repeat(heads, np.diff(np.append(heads, len(conv))))
            if conv[0] == last:
                local[: heads[1] if len(heads) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(local)], names=[*batch.schema.names, "part", "local"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    local = scratch.keep(dealt.mapInArrow(number, f"{kinds}, part int, local long"), name)
    edges = local.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    across = local.join(F.broadcast(edges), "part").where(F.col("conv_id").isin(F.col("lo"), F.col("hi"))).groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    across = across.select("conv_id", "part", before.alias("before")).where(F.col("before") > 0)
    found = local.join(F.broadcast(across), ["conv_id", "part"], "left")  # two rows a partition at most
    return found.withColumn("pos", F.col("local") + F.coalesce("before", F.lit(0))).drop("part", "local", "before")


def running(rows: DataFrame, key: str, order: Column, values: list[str]) -> DataFrame:
    """``rows`` with before_<value>, the sums of the rows of the same key that come before by ``order``.

    Sums are taken within spans of the order and over the spans of the few keys that have
    several, so no window holds a whole key.
    """
    spans = rows.withColumn("_order", order).withColumn("_span", F.floor(F.col("_order") / SPAN))
    ahead = Window.partitionBy(key, "_span").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inner = spans.select("*", *[F.coalesce(F.sum(v).over(ahead), zero).alias(f"before_{v}") for v in values])
    totals = spans.groupBy(key, "_span").agg(*[F.sum(v).alias(v) for v in values])
    wide = totals.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(key)
    over = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = join_sized(totals, wide, [key], "left_semi").select(key, "_span", *[F.coalesce(F.sum(v).over(over), zero).alias(f"_off_{v}") for v in values])
    found = join_sized(inner, offsets, [key, "_span"], "left")
    for v in values:
        found = found.withColumn(f"before_{v}", F.col(f"before_{v}") + F.coalesce(F.col(f"_off_{v}"), zero))
    return found.drop("_order", "_span", *[f"_off_{v}" for v in values])


def rebuild(turns: DataFrame, family: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, their rebuilt turns) of numbered ``turns``: each begins with the first turns of its family's first one.

    Conversation c takes the first h turns of c - c % family (all if it has fewer, none if it
    is absent), h being the unsigned crc32 of its id modulo ``shared``, and then its own after
    its first h. The remainder has the sign of c, as in SQL.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    convs = turns.select("conv_id").distinct().withColumn("h", h)
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < shared - 1)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    heads = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
    taken = F.least(F.coalesce(F.size("head"), F.lit(0)), F.col("h").cast("int"))
    heads = heads.select("conv_id", "h", taken.alias("taken"), F.slice("head", F.lit(1), taken).alias("head"))
    short = heads.where(F.col("taken") < F.col("h")).select("conv_id", (F.col("taken") - F.col("h")).alias("shift"))
    own = join_sized(turns.where(F.col("pos") >= h), short, ["conv_id"], "left")
    own = own.select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "digest", "words")
    return convs.select("conv_id"), own.unionByName(heads.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.words"))


def turn_blocks(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, k, s, turns): the blocks of each conversation with the name of the prefix before them."""
    halves = []
    for seed in (0, 1):
        mixed = F.xxhash64(F.lit(seed), "pos", "digest")
        halves += [mixed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(mixed, 32)]
    placed = turns.select("conv_id", "pos", F.floor(F.col("pos") / BLOCK).alias("k"), *[x.alias(n) for x, n in zip(halves, PARTS, strict=True)], "words")
    placed = placed.repartition("conv_id", F.floor(F.col("k") / SPAN))
    turn = F.struct("pos", *PARTS, "words")
    blocks = placed.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(turn)).alias("turns"), *_sums())  # BLOCK turns at most
    summed = running(blocks, "conv_id", F.col("k"), list(PARTS))
    return scratch.keep(
        summed.select(
            "conv_id", "k", F.struct(*[F.col(f"before_{x}").alias(x) for x in PARTS]).alias("s"),
            F.transform("turns", lambda t: F.struct(*[t[x].alias(x) for x in [*PARTS, "words"]])).alias("turns"),
        ),
        "blocks",
    )


def block_nodes(groups: DataFrame, diverging: DataFrame, sums: list[Column], names: list[str]) -> DataFrame:
    """(depth, p, prev, words, names...): the nodes of distinct blocks.

    A block that alone follows its prefix gives its turns as nodes with the block's own
    figures; the turns of diverging siblings are told apart and their figures aggregated.
    """
    steps, at = [], F.col("s")
    for i in range(BLOCK):
        turn = F.get("turns", F.lit(i))
        after = _plus(at, turn)
        steps.append(F.when(F.size("turns") > i, F.struct((F.col("k") * BLOCK + i + 1).alias("depth"), after.alias("p"), at.alias("prev"), turn["words"].alias("words"))))
        at = after
    nodes = lambda rows: rows.select(F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("n"), *names).select("n.*", *names)
    alone = nodes(join_sized(groups, diverging, ["k", "s"], "left_anti"))
    apart = nodes(join_sized(groups, diverging, ["k", "s"], "left_semi"))
    return alone.unionByName(apart.groupBy("depth", "p", "prev", "words").agg(*sums))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p, n_ends, ends_sha256): the digest of the ascending ids of the conversations that end at each node.

    Up to ENDS ids are joined in a row. The ids of a node with more are sorted by ranges,
    joined in chunks by many tasks, and the chunks go through the hash one after another, as
    the digest of one string asks; no task holds a node's ids.
    """
    counts = ends.groupBy("depth", "p").agg(F.count("*").alias("n_ends"))
    hot = counts.where(F.col("n_ends") > ENDS).select("depth", "p")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    few = join_sized(ends, hot, ["depth", "p"], "left_anti").groupBy("depth", "p").agg(F.count("*").alias("n_ends"), F.sha2(F.array_join(ids, ","), 256).alias("ends_sha256"))
    key = ["depth", *PARTS]
    many = join_sized(ends, hot, ["depth", "p"], "left_semi").select("depth", "p.*", "conv_id")
    many = many.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    kinds = "depth long, a long, b long, c long, d long"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.column_stack([batch.column(c).to_numpy() for c in key])
            conv = batch.column("conv_id")
            cuts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]).any(1))) if len(node) else np.zeros(0, int)
            cuts = sorted({*cuts.tolist(), *range(0, len(node), ENDS), len(node)})
            rows = [(*node[a].tolist(), conv[a].as_py(), b - a, ",".join(map(str, conv[a:b].to_pylist()))) for a, b in zip(cuts, cuts[1:], strict=False)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*key, "first", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([*[pa.array([x]) for x in now], pa.array([n]), pa.array([state.hexdigest()])], names=[*key, "n_ends", "ends_sha256"])
        for batch in batches:
            for i in range(len(batch)):
                node = tuple(batch.column(c)[i].as_py() for c in key)
                if node != now:
                    if now is not None:
                        yield done()
                    now, state, n = node, hashlib.sha256(), 0
                else:
                    state.update(b",")
                state.update(batch.column("ids")[i].as_py().encode())
                n += batch.column("n")[i].as_py()
        if now is not None:
            yield done()

    joined = many.mapInArrow(chunks, f"{kinds}, first long, n long, ids string").repartition(*key).sortWithinPartitions(*key, "first")
    large = joined.mapInArrow(hashed, f"{kinds}, n_ends long, ends_sha256 string")
    return few.unionByName(large.select("depth", F.struct(*PARTS).alias("p"), "n_ends", "ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    A node is a sequence of first turns, equal by role and text (hashes of 128 bits); the root
    has none. conv_id is the smallest conversation that starts with it.

    Turns go by ``turn``, null first, ties by role and then by a digest of the text; repeated
    rows are turns each. A null role or text is empty; rows without conv_id belong to no
    conversation. Whole texts are hashed where they are, however long; long conversations are
    cut into spans. Other columns, whatever their names, are not read; no rows give no nodes.

    Sums over subtrees take no walk: a node's figures belong to its smallest conversation,
    its owner, and a node's subtree has all figures of its conversations but what its own
    owner owns above it.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    convs, rebuilt = rebuild(number_turns(turns, scratch))
    blocks = turn_blocks(rebuilt, scratch)

    groups = scratch.keep(blocks.groupBy("k", "s", "turns").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")), "groups")
    diverging = groups.groupBy("k", "s").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("k", "s")
    diverging = scratch.keep(diverging, "diverging")
    below = block_nodes(groups, diverging, [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")], ["n_convs", "conv_id"])
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where(F.col("n_convs") > 0)
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), _zero().alias("p"), F.lit(None).cast(below.schema["p"].dataType).alias("prev"), zero.alias("words"), "n_convs", "conv_id")

    turned = blocks.select("conv_id", F.explode("turns").alias("t")).select("conv_id", F.lit(1).cast("long").alias("one"), *[F.col(f"t.{x}").alias(x) for x in PARTS])
    ends = turned.unionByName(convs.select("conv_id", zero.alias("one"), *[zero.alias(x) for x in PARTS])).groupBy("conv_id").agg(F.sum("one").alias("depth"), *_sums())
    ended = end_digests(scratch.keep(ends.select("conv_id", "depth", F.struct(*PARTS).alias("p")), "ends"))

    nodes = below.unionByName(root).join(ended, ["depth", "p"], "left")
    leaf = (F.coalesce("n_ends", zero) == F.col("n_convs")).cast("long")
    nodes = nodes.select("depth", "p", "prev", "n_convs", "conv_id", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "ends_sha256")
    nodes = scratch.keep(nodes, "nodes")

    owned = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    passing = blocks.join(owned, "conv_id").groupBy("k", "s", "turns").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    names = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    under = block_nodes(passing, diverging, names, ["leaves", "saved"]).select("depth", "p", "leaves", F.col("saved").alias("all_saved"))
    whole = owned.agg(*names).where(F.col("leaves").isNotNull()).select(zero.alias("depth"), _zero().alias("p"), "leaves", F.col("saved").alias("all_saved"))

    children = nodes.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("prev").alias("p")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("prev"), F.col("conv_id").alias("parent_conv_id"))
    found = running(nodes, "conv_id", F.col("depth"), ["saved"])
    found = found.join(under.unionByName(whole), ["depth", "p"]).join(children, ["depth", "p"], "left").join(parents, ["depth", "prev"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("all_saved") - F.col("before_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) - 1 AS pos FROM turns
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, range(8 * length(conv_id::VARCHAR))::UBIGINT[]),
    lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::UBIGINT) >> 1,
      3988292384::UBIGINT * (xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::UBIGINT) & 1))
  ), 4294967295::UBIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, p.pos, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos < c.h
  UNION ALL SELECT c.conv_id, 1, p.pos, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos >= c.h
), paths AS (
  SELECT c.conv_id, coalesce(list(md5(strlen(role) || ':' || role || text) ORDER BY part, pos) FILTER (WHERE part IS NOT NULL), []) AS path,
    coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, pos) FILTER (WHERE part IS NOT NULL), []) AS words
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id
), members AS (
  SELECT conv_id, d, path[1:d] AS node, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, len(path) = d AS ends FROM paths, unnest(range(len(path) + 1)) AS u(d)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, bool_and(ends) AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node, d
), under AS (
  SELECT node[1:k] AS node, k AS d, sum(leaf::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM nodes, unnest(range(d + 1)) AS u(k) GROUP BY ALL
), children AS (
  SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, u.n_leaves::BIGINT AS n_leaves,
  u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN under u ON u.node = n.node AND u.d = n.d LEFT JOIN children c ON c.node = n.node AND c.d = n.d
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""
