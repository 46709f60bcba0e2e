"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import BROADCAST_ROWS, Scratch, join_sized

WORD = r"[^\x20\x09-\x0D]+"
#: Most words of a packet, and the packets that a source's target has at least, where it has as many words.
PACKET, PACKETS_PER_TARGET = 256, 128
#: Parts of the rows of one id and size, where a span of the shuffle is crowded.
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, repeats: float = 2.0
) -> DataFrame:
    """Targets of sources from (source, source_size): one row per source, two small windows.

    Sources in code-point order, null last, take the weights in turn. A source stops at
    ``repeats`` times its size; what it leaves goes to the others by weight. In order of
    cap / weight the level is the largest of (budget - caps before) / (weights from here),
    so no loop is needed. Sources without words get 0; no sources, no rows.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    sizes = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).alias("weight"))
    sizes = sizes.withColumn("cap", repeats * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    budget = share * F.sum("source_size").over(everything)
    level = sizes.withColumn("level", (budget - before) / onward)
    filled = F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything))
    return level.select("source", "source_size", filled.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    repeats: int = 2,
    packet: int = PACKET,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """What the mix takes of each document, by weighted fair queueing.

    Documents of a source are shuffled by the md5 of their id and queue ``repeats`` times over,
    in packets of at most ``packet`` words (fewer where a source's target is small), so that
    a long document can't carry its source past its target. A packet's virtual finish time is
    the source's words up to its end over the source's target. The queue of all sources is
    ordered by finish time and cut at the budget, the sum of the targets; nothing else
    decides. Its order is that of ranges of finish time, and within a range of the packets;
    only the range that holds the cut has to be sorted, so the queue itself is never
    shuffled, and no task holds a source. Where one id (or none) has so many rows that a span
    of the shuffle is crowded, the span is cut by id and size, and rows equal in these, which
    are interchangeable, are spread over ``SALTS`` parts.

    Columns: doc_id, size, source, source_size, target, takes (a struct of epoch, taken
    words and finish for each repeat; a document's taken words are its first ones). Null
    and empty text has size 0 and takes nothing; null source is a source; null ids shuffle
    as ''; repeated rows are documents of their own; ties of the shuffle go by id and size,
    ties of the queue by source, shuffle, epoch and packet. A very long text is many packets.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = scratch.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("place"),
            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
        ),
        "sized",
    )
    n = max(1, sized.count())
    ranges = math.isqrt(n) + 1
    sized = sized.withColumn("span", F.floor(F.col("place") / (2.0**60 / ranges)).cast("int"))

    spans = sized.groupBy("source", "span").agg(F.sum("size").alias("span_size"), F.count("*").alias("span_rows"))
    sizes = spans.groupBy("source").agg(F.sum("span_size").alias("source_size"))
    targets = scratch.keep(source_targets(sizes, weights, share, repeats), "targets")
    ahead = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    crowded = (F.col("span_rows") > 16 * ranges).alias("crowded")  # a usual span has at most about ``ranges`` rows
    spans = spans.select("source", "span", crowded, F.coalesce(F.sum("span_size").over(ahead), F.lit(0)).alias("ahead"))
    spans = spans.join(targets, spans["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    s = spans.select(F.col("source").alias("_source"), F.col("span").alias("_span"), "crowded", "ahead", "source_size", "target")
    placed = sized.join(s, sized["source"].eqNullSafe(s["_source"]) & (sized["span"] == s["_span"])).drop("_source", "_span")
    placed = placed.withColumn("cell", F.when(F.col("crowded"), F.struct("place", "doc_id", "size", "salt")))
    cells = placed.where("crowded").groupBy("source", "span", "cell").agg(F.sum("size").alias("cell_size"))
    lower = Window.partitionBy("source", "span").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        F.col("source").alias("_source"), F.col("span").alias("_span"), F.col("cell").alias("_cell"),
        F.coalesce(F.sum("cell_size").over(lower), F.lit(0)).alias("below"),
    )
    cells = scratch.keep(cells, "cells")
    if many := cells.count():
        same = placed["source"].eqNullSafe(cells["_source"]) & (placed["span"] == cells["_span"]) & (placed["cell"] == cells["_cell"])
        placed = placed.join(F.broadcast(cells) if many <= BROADCAST_ROWS else cells, same, "left").drop("_source", "_span", "_cell")
        placed = placed.withColumn("ahead", F.col("ahead") + F.coalesce("below", F.lit(0))).drop("below")
    # By all three: a partitioning by source and span alone would keep a crowded span in one task.
    placed = placed.repartition("source", "span", "cell")
    within = Window.partitionBy("source", "span", "cell").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("start", F.col("ahead") + F.sum("size").over(within) - F.col("size"))
    quantum = F.greatest(F.lit(1), F.least(F.lit(packet), F.ceil(F.col("target") / PACKETS_PER_TARGET))).cast("long")
    placed = placed.withColumn("quantum", quantum).withColumn("row", F.monotonically_increasing_id()).drop("span", "ahead", "crowded", "cell", "salt")
    placed = scratch.keep(placed, "placed")
    scratch.drop("sized", "cells")

    size, each = F.col("size"), F.col("quantum")

    def packets(epoch: Column | int) -> Column:
        """Packets of a document's epoch, in order: number, words, finish."""
        upto = lambda p: F.least(size, p * each)
        one = lambda p: F.struct(
            p.alias("packet"), (upto(p) - (p - 1) * each).alias("words"),
            ((F.col("start") + F.col("source_size") * (epoch - 1) + upto(p)) / F.col("target")).alias("finish"),
        )
        return F.when(size > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(size / each)), one))

    # Packets that finish after twice the time share the last range; the budget ends at time 1.
    slot = lambda finish: F.floor(F.least(finish, F.lit(2.0)) * ranges).cast("long")
    epochs = placed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    queue = epochs.withColumn("p", F.explode(packets(F.col("epoch")))).select("*", "p.*").withColumn("slot", slot(F.col("finish")))
    slots = queue.groupBy("slot").agg(F.sum("words").alias("slot_words"))
    before = F.sum("slot_words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slot_words")
    budget = F.broadcast(targets.agg(F.floor(F.sum("target") + 1e-6).alias("budget")))  # one row
    crossed = slots.select("slot", "slot_words", before.alias("before")).crossJoin(budget)
    crossed = crossed.where(F.col("before") + F.col("slot_words") >= F.col("budget")).orderBy("slot")
    found = crossed.select("slot", (F.col("budget") - F.col("before")).alias("room")).first()  # the range that holds the cut
    edge, room = found or (-1, 0)

    order = Window.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), "place", "doc_id", "size", "row", "epoch", "packet")
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    last = queue.where(F.col("slot") == edge).withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), room - upto)))
    last = last.groupBy("row", "epoch").agg(F.sum("taken").alias("taken"))
    last = last.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "taken"))).alias("last"))
    last = scratch.keep(last, "last")

    def take(epoch: Column) -> Column:
        own = packets(epoch)
        whole = F.filter(own, lambda p: slot(p["finish"]) < edge)
        words = F.aggregate(F.coalesce(whole, F.array().cast("array<struct<packet:long,words:long,finish:double>>")), F.lit(0).cast("long"), lambda a, p: a + p["words"])
        taken = words + F.coalesce(F.try_element_at("last", epoch), F.lit(0))
        return F.struct(epoch.alias("epoch"), taken.cast("long").alias("taken"), F.element_at(own, -1)["finish"].alias("finish"))

    rows = join_sized(placed, last, ["row"], "left")
    takes = F.transform(F.sequence(F.lit(1), F.lit(repeats)), take).alias("takes")
    return rows.select("doc_id", "size", "source", "source_size", "target", takes)


def mixed_totals(mix: DataFrame) -> DataFrame:
    """Per document what the mix takes of it: doc_id, size, source_size, target, taken."""
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["taken"])
    return mix.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: DuckDB SQL for mixed_totals(mix_sources(documents)) with the default parameters.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(doc_id::VARCHAR) AS place FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, d.source, substr(d.place, 1, 15) AS place, t.source_size, t.target, row_number() OVER () AS id,
         greatest(1, least(256, ceil(target / 128)))::BIGINT AS quantum,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.place, 1, 15), d.doc_id, d.size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
packets AS (
  SELECT *, unnest(range(1, (size + quantum - 1) // quantum + 1)) AS packet
  FROM placed, (VALUES (1), (2)) e(epoch) WHERE size > 0),
queue AS (
  SELECT *, least(size, packet * quantum) - (packet - 1) * quantum AS words,
         (start + source_size * (epoch - 1) + least(size, packet * quantum)) / target AS finish FROM packets),
cut AS (
  SELECT id, greatest(0, least(words, (SELECT floor(sum(target) + 1e-6) FROM targets)
             - (sum(words) OVER (ORDER BY finish, source NULLS LAST, place, doc_id, size, id, epoch, packet
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words))) AS taken
  FROM queue),
taken AS (SELECT id, sum(taken) AS taken FROM cut GROUP BY id)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (id)
"""
