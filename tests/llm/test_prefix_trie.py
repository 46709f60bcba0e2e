"""The prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import prefix_trie as trie
from tidepool.llm.prefix_trie import number_turns, prefix_trie
from tidepool.llm.shared import Scratch

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """rows: (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0, role, tie), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, below = set(), {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        kids = children[node]
        leaves = sum(below[k][0] for k in kids) or 1
        saved = (len(members[node]) - 1) * words + sum(below[k][1] for k in kids)
        below[node] = leaves, saved
        ends = ",".join(str(c) for c in members[node] if len(paths[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.add((members[node][0], len(node), parent, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 130), -40, -39, -1, 200, 205, 217]:
        if c in (40, 60):  # families whose first conversation is absent
            continue
        kind = rng.integers(3)
        for t in range(int(rng.integers(1, 14))):
            text = f"turn {t}" if t < 4 * kind else f"turn {t} {rng.integers(2)}"
            rows.append((c, t if rng.random() > 0.05 else None, ["user", "assistant", None][t % 3], text if rng.random() > 0.05 else None))
    rows += [(300, t, "user", "same again") for t in range(90)] + [(301, t, "user", "same again") for t in range(70)]  # two long ones
    rows += [(400, 1, "user", "tie"), (400, 1, "user", "tie"), (400, 1, "assistant", "tie"), (400, 1, "user", "other"), (None, 1, "user", "nobody's")]
    rows += [(c, 0, "user", "hello") for c in range(1000, 1060)]  # copies
    return rows


@pytest.mark.parametrize("sizes", [(4, 1024, 4096), (3, 2, 5)])
def test_nodes_are_those_of_a_dictionary(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "SPAN", "ENDS"), sizes, strict=True):
        monkeypatch.setattr(trie, name, value)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("pos", "k", "s", "p", "depth", "words", "part")})
    assert found(prefix_trie(df.repartition(3))) == plain(rows)


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr("tidepool.llm.shared.BROADCAST_ROWS", 0)
    rows = conversations(1)
    assert found(prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == plain(rows)


def test_places_of_a_conversation_over_many_tasks(spark):
    turns = spark.range(5000).select(
        F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).cast("long").alias("conv_id"), F.floor(F.col("id") / 3).alias("turn"), F.lit("u").alias("role"),
        F.md5(F.col("id").cast("string").cast("binary")).alias("digest"), F.lit(1).cast("long").alias("words"),
    )
    for n in ("3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        try:
            got = number_turns(turns, Scratch(spark, "test")).groupBy("conv_id").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == 50 and all(r.p == list(range(len(r.p))) for r in got)


def test_empty_table_has_no_nodes(spark):
    assert prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
