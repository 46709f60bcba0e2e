"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.components import components
from tidepool.llm.shared import Scratch, join_sized, map_text
from tidepool.llm.shingles import mix, shingle_sets

#: Two collections of SIDE sub-sketches, each of ROWS minhashes; every pair of sub-sketches is a
#: table, so SIDE * SIDE tables of 2 * ROWS minhashes cost 2 * SIDE * ROWS minhashes. At a
#: similarity of 0.8 a pair meets in some table with probability 0.9994.
SIDE, ROWS = 8, 2
#: Bins of the one-permutation signature that screens pairs before sets are compared; a power of two.
BINS = 512
#: Deviations below the threshold at which the screen drops a pair.
SLACK = 4.0
#: Members of a bucket that meet in one piece of work.
BLOCK = 512

_rng = np.random.default_rng(71)
_FACTORS = (_rng.integers(1, 1 << 62, 2 * SIDE * ROWS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def sketch(values: np.ndarray, sizes: np.ndarray) -> dict[str, object]:
    """Set hashes, sub-sketch keys and signatures of shingle sets (ascending within a text)."""
    n = len(sizes)
    full = np.flatnonzero(sizes > 0)
    first = (np.cumsum(sizes) - sizes)[full]
    keys = np.zeros((2 * SIDE, n), np.int64)
    hashes = np.zeros((2, n), np.uint64)
    signature = np.zeros((n, BINS), np.uint8)
    if len(full):
        with np.errstate(over="ignore"):
            for i in range(2):
                hashes[i, full] = np.add.reduceat(mix(values + np.uint64(i + 1)), first)
            for s in range(2 * SIDE):
                key = np.full(len(full), s + 1, np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(values * _FACTORS[s * ROWS + r], first))
                keys[s, full] = key.view(np.int64)
        text = np.repeat(np.arange(n), sizes)
        spot = text * BINS + (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        least = np.ones(len(spot), bool)
        least[1:] = spot[1:] != spot[:-1]
        # The least value of a bin, as a byte from 1 to 255; 0 is an empty bin.
        signature.ravel()[spot[least]] = ((values[least] >> np.uint64(20)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    bounds = np.arange(n + 1, dtype=np.int32)
    lists = lambda k: pa.ListArray.from_arrays(pa.array(bounds * SIDE), pa.array(np.ascontiguousarray(k.T).ravel()))
    return {
        "n_shingles": sizes.astype(np.int64),
        "h1": hashes[0].view(np.int64),
        "h2": hashes[1].view(np.int64),
        "left": lists(keys[:SIDE]),
        "right": lists(keys[SIDE:]),
        "signature": pa.array([r.tobytes() for r in signature], pa.binary()),
    }


def likely(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int, slack: float) -> np.ndarray:
    """Pairs that may reach the threshold, by their set sizes m, n and the signature bins that agree.

    The bins in use are a sample without replacement of the union, so for sets that are not
    much larger than the signature the deviation is small.
    """
    t = percent / 100
    used = ((a | b) != 0).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    union = np.maximum((m + n) / (1 + t), used)
    rest = (union - used) / np.maximum(union - 1, 1)
    fits = 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
    if slack == float("inf"):
        return fits
    return fits & (same >= t * used - slack * np.sqrt(t * (1 - t) * np.maximum(used, 1) * rest) - 1)


def _rows(column: pa.Array, width: int, kind: type) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _screen(pairs: DataFrame, signatures: DataFrame, percent: int, slack: float) -> DataFrame:
    """The pairs (a, b) whose signatures allow the threshold."""
    for side in "ab":
        own = [F.col(c).alias(f"{c[0]}{side}") for c in ("signature", "n_shingles")]
        pairs = pairs.join(signatures.select(F.col("rep").alias(side), *own), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = (_rows(t.column(i), BINS, np.uint8) for i in (2, 3))
            ok = likely(a, b, t.column(4).to_numpy(), t.column(5).to_numpy(), percent, slack)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(ok)), t.column(1).filter(pa.array(ok))], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; an id's texts are all tried."""
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    wanted = join_sized(docs, ids, ["id"], "left_semi").dropDuplicates(["id", "text"])

    def make():
        def f(data, offsets):
            values, sizes = shingle_sets(data, offsets, words)
            ends = np.cumsum(sizes) * 8
            raw = values.tobytes()
            return {"shingles": pa.array([raw[e - 8 * s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())}

        return f

    sets = scratch.keep(map_text(wanted, ["id"], "text", "id long, shingles binary", make), f"{name}-sets")
    joined = pairs
    for side in "ab":
        joined = joined.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"s{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(ok)), t.column(1).filter(pa.array(ok))], ["a", "b"])

    found = scratch.keep(joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), name)
    scratch.drop(f"{name}-ids", f"{name}-sets")
    return found


def bucket_pairs(rows: pa.Table, percent: int, slack: float) -> pa.Table:
    """Pairs of different components within each bucket block, where they first meet, if likely."""
    if isinstance(rows, pa.RecordBatch):
        rows = pa.Table.from_batches([rows])
    rep, comp, side, many = (rows.column(c).to_numpy() for c in ("rep", "component", "side", "n_shingles"))
    spot = rows.column("block").to_numpy()
    table = rows.column("table").to_numpy()
    subs = _rows(rows.column("subs"), 2 * SIDE, np.int32)
    signature = _rows(rows.column("signature"), BINS, np.uint8)
    order = np.lexsort((rep, spot))
    cut = np.flatnonzero(np.diff(spot[order], prepend=spot[order[0]] - 1 if len(order) else 0))
    size = np.diff(np.append(cut, len(order)))
    found = [np.zeros((0, 2), np.int64)]
    for n in np.unique(size):
        if n < 2:
            continue
        i, j = np.triu_indices(int(n), 1)
        starts = cut[size == n]
        step = max(1, 40_000 // len(i))
        for at in range(0, len(starts), step):
            base = starts[at : at + step, None]
            a, b = order[(base + i).ravel()], order[(base + j).ravel()]
            # A block of two parts pairs across them; a part paired with itself has side 0 only.
            fits = (comp[a] != comp[b]) & ((side[a] != side[b]) | (side[a] == 2))
            a, b = a[fits], b[fits]
            for lo in range(0, len(a), 10_000):
                x, y = a[lo : lo + 10_000], b[lo : lo + 10_000]
                same = subs[x] == subs[y]
                first = same[:, :SIDE].argmax(1) * SIDE + same[:, SIDE:].argmax(1)
                ok = first == table[x]
                x, y = x[ok], y[ok]
                ok = likely(signature[x], signature[y], many[x], many[y], percent, slack)
                found.append(np.column_stack([rep[x[ok]], rep[y[ok]]]))
    pairs = np.concatenate(found)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, slack: float | None = SLACK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document; linked where 100 * common >= percent * all.

    Texts are lower-cased in A-Z and cut at blanks; a document's set is its distinct shingles
    of ``words`` words, or its whole sequence if shorter. Null, empty and blank texts have
    empty sets and stand alone. Equal sets are one representative, the smallest id. Then:

    1. a bucket's members are paired with its smallest id, screened and confirmed;
    2. in buckets that still hold several components, members of different ones are paired
       in blocks, each pair in the first bucket it shares, screened by signature, confirmed.

    So no link between candidates is lost and copies are never expanded into all pairs. The
    confirmation compares full sets of 64-bit shingle hashes, of whole texts however long.
    Repeated rows and rows of one id with different texts are one document, which links as
    any of its texts does. A row without id can be nobody's copy and nobody's original: its
    component is null and it is kept. Ties of sets go to the smaller id; no rows give no
    rows; other columns, whatever their names, are not read. ``slack`` is in deviations: the
    screen by signatures drops pairs that far below the threshold, and None screens by set
    sizes alone, so that every candidate pair is confirmed on full sets.
    """
    scratch = Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    slack = float("inf") if slack is None else slack

    def make():
        return lambda data, offsets: sketch(*shingle_sets(data, offsets, words))

    keys = "left array<long>, right array<long>"
    sketches = scratch.keep(
        map_text(docs, ["id"], "text", f"id long, n_shingles long, h1 long, h2 long, {keys}, signature binary", make), "sketches"
    )
    real = sketches.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    some = [F.any_value(c).alias(c) for c in ("left", "right", "signature")]
    reps = real.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("rep"), *some)
    reps = scratch.keep(reps, "reps")

    # Tables: every pair of a left and a right sub-sketch.
    tables = F.flatten(
        F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.struct(
            F.xxhash64(x, y, i, j).alias("key"), (i * SIDE + j).alias("table")
        )))
    )
    rows = reps.select("rep", F.explode(tables).alias("t")).select("rep", "t.key", "t.table")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where(F.col("n") > 1)
    shared = scratch.keep(shared, "shared")
    buckets = scratch.keep(join_sized(rows, shared, ["key"]).select("key", "table", "rep", "leader", "n"), "buckets")

    stars = buckets.where(F.col("rep") != F.col("leader")).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    stars = scratch.keep(_screen(stars, reps, percent, slack), "stars")
    first = components(_confirm(stars, docs, words, percent, scratch, "star"), scratch, "first")
    scratch.drop("shared", "stars", "star")

    placed = buckets.join(first.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_keys = scratch.keep(open_keys.where(F.col("lo") < F.col("hi")).select("key"), "open")
    low = lambda c: F.transform(c, lambda x: F.hex(x.bitwiseAND(0xFFFFFFFF)))
    subs = F.unhex(F.array_join(F.transform(F.concat(low("left"), low("right")), lambda x: F.lpad(x, 8, "0")), ""))
    payload = reps.select("rep", "n_shingles", subs.alias("subs"), "signature")
    open_rows = join_sized(placed.drop("leader"), open_keys, ["key"]).join(payload, "rep")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    # Part i meets part j >= i: side 2 where a part meets itself, else 0 and 1.
    meet = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(
            F.xxhash64("key", F.least(F.col("own"), j), F.greatest(F.col("own"), j)).alias("block"),
            F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1).alias("side"),
        ),
    )
    spots = open_rows.withColumn("parts", parts).withColumn("own", own).withColumn("m", F.explode(meet))
    groups = max(1, buckets.count() // 3000)
    spots = spots.select(
        F.pmod("m.block", F.lit(groups)).alias("work"), "m.block", "m.side", "table", "rep", "component", "n_shingles", "subs", "signature"
    )
    crossing = spots.groupBy("work").applyInArrow(lambda t: bucket_pairs(t, percent, slack), "a long, b long")
    crossing = scratch.keep(crossing, "crossing")
    scratch.drop("buckets", "open")
    more = _confirm(crossing, docs, words, percent, scratch, "cross")
    star = first.select(F.col("id").alias("a"), F.col("component").alias("b"))
    edges = star.unionByName(more)
    # Ids of several texts, of which there should be none, tie the representatives of these.
    several = real.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where(F.col("lo") != F.col("hi")).select("id")
    if not several.isEmpty():
        ties = real.join(several, "id").join(reps.select("h1", "h2", "rep"), ["h1", "h2"])
        edges = edges.unionByName(ties.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    named = scratch.keep(components(edges, scratch, "all"), "named")
    scratch.drop("crossing", "cross", "first", "all")

    member = sketches.select("id", "n_shingles", "h1", "h2").join(
        reps.select("h1", "h2", "rep").join(named.withColumnRenamed("id", "rep"), "rep", "left"), ["h1", "h2"], "left"
    )
    found: Column = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return member.select(F.col("id").alias(id_col), "n_shingles", found.alias("component_id"), F.coalesce(found == F.col("id"), F.lit(True)).alias("kept"))


#: DuckDB SQL for near_duplicates with four words: all pairs that share a shingle, then reach.
NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON d.doc_id = a LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""
