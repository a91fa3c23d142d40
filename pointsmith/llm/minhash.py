"""Near-duplicates by order min-hash, verified by banded alignment.

A text's shingles are five consecutive words (white-space separated, A-Z lower-cased; a shorter text is one shingle),
each labelled with its occurrence number, so that all are different. A sketch takes the four shingles least under one
hash function, in text order; a text has 32 sketches. Texts that agree in a sketch share a bucket. Two long texts of
similarity 0.8 agree in a given sketch with a chance of about 0.41, so in fewer than three with one of 1.2e-5; texts of
under `SHORT` shingles, whose chances are worse, need to agree in one only.

Similarity is that of an alignment: the longest common subsequence of labelled shingles within a band as wide as 0.8
allows, over the shingles of both less those in common. Links are pairs of 0.8 or more; classes their components.

Scale: exact copies are folded first, by 128-bit hashes, with map-side aggregates; from then on a text is a row number.
Each text is first held against one hub only, the smallest text of the bucket that it shares most buckets with, so
this round makes one pair a text however large a group of copies is. Links make components, and only buckets that
still hold several components go on: small ones with all pairs across components, large ones with one more hub a text.
What is then open in large buckets is compared in blocks of bounded rows and shingles, block against block, as arrays;
only links that join components come out. Nothing is capped or dropped. Pairs must agree in sketches before texts are read; those are picked by a bitmap of fixed size and
an exact join.

Defined results: a class id is the smallest id in its class (null if none of its rows has one); rows with a null id
take part like others; texts without words, null and empty ones alike, are copies of each other only if they are
equal (null counts as empty); different texts that share an id are told apart; repeated rows are copies; other columns
play no part; empty tables give empty results. A very long text is sketched in parts of bounded memory.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from pointsmith.session import cut, ship

from . import textblocks as tb
from .common import id_text, map_arrow, release, small_batches
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 32
LEAST = 4
#: Sketches that two texts must agree in before they are read: AGREE, or one if both have fewer than SHORT shingles.
AGREE = 3
SHORT = 50
BLOCK_SHINGLES = 400_000
BLOCK_ROWS = 2048
SMALL = 16
BITMAP_BITS = 1 << 23
#: Shingles times hash functions that are held at a time.
CELLS = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = tb.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingles(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The labelled shingles of each text, in text order."""
    block = tb.Block(column)
    block.data = _LOWER[block.data]
    starts, ends, rows, bounds = tb.words(block, tb.WHITE)
    hashes = tb.word_hashes(block.data, starts, ends)
    grams, first = tb.gram_hashes(hashes, rows, size)
    own = rows[first]
    labelled = tb.mix(grams + tb.occurrences(grams, own).astype(np.uint64) * tb.STEP)
    cuts = np.searchsorted(own, np.arange(len(block) + 1))
    out = []
    for r in range(len(block)):
        got = labelled[cuts[r] : cuts[r + 1]]
        if not len(got) and (n := bounds[r + 1] - bounds[r]):
            got = np.zeros(1, np.uint64)
            for h in hashes[bounds[r] : bounds[r] + n]:
                got = (got + h) * tb.STEP
            got = tb.mix(got + np.uint64(n))
        out.append(got)
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """One key for each sketch; none for a text without words."""
    if not len(own):
        return np.zeros(0, np.int64)
    k = min(LEAST, len(own))
    key = np.zeros(len(_ODD), np.uint64)
    step = max(1, CELLS // len(own))
    for lo in range(0, len(_ODD), step):
        values = own[:, None] * _ODD[None, lo : lo + step]
        least = np.argpartition(values, k - 1, axis=0)[:k] if len(own) > k else np.tile(np.arange(k)[:, None], (1, values.shape[1]))
        for row in own[np.sort(least, axis=0)]:
            key[lo : lo + step] = (key[lo : lo + step] + row) * tb.STEP
    return tb.mix(key + np.arange(len(_ODD), dtype=np.uint64)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Banded alignment: the longest common subsequence within the band that `least` allows, over the union."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)
    band = max(n, m) - int(np.ceil(need - 1e-9))
    # Labelled shingles are unique, so common subsequences are increasing runs of positions.
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(ia - ib) <= band
    if near.sum() < need - 1e-9:
        return 0.0
    order = np.argsort(ia[near])
    tails: list[int] = []
    for p in ib[near][order].tolist():
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails) / (n + m - len(tails))


def text_keys(text: Column) -> list[Column]:
    """128 bits of a text, as two columns k1 and k2; null counts as empty."""
    full = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(full).alias("k1"), F.xxhash64(F.lit(1), F.length(full), full).alias("k2")]


def _sketches(rows: DataFrame) -> DataFrame:
    """(row, id, k1, k2, n, keys) of every row, no text."""

    def run(batches):
        for batch in batches:
            for lo, hi in tb.slices(batch.column(4)):
                found = shingles(batch.column(4).slice(lo, hi - lo))
                keys = [sketch(x) for x in found]
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                columns = [batch.column(c).slice(lo, hi - lo) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in found], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["row", "id", "k1", "k2", "n", "keys"])

    shown = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), *text_keys(F.col("text")), "text")
    return map_arrow(shown, run, f"row long, id {rows.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n int, keys array<long>")


def _verified(batches):
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        for lo, hi in tb.slices(a, tb.BLOCK_BYTES // 4):
            left, right = (shingles(x.slice(lo, hi - lo)) for x in (a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([similarity(x, y) for x, y in zip(left, right)], pa.float64())], ["a", "b", "similarity"])


def _texts(rows: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of some nodes. Rows that cannot be among them go before the shuffle, by a bitmap of BITMAP_BITS bits."""
    wanted = reps.select("node", "id", "k1", "k2").join(nodes, "node", "left_semi")
    bit = F.pmod(F.col("k1"), F.lit(BITMAP_BITS))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    marked = rows.select("doc_id", "text", *text_keys(F.col("text"))).withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6))
    picked = marked.join(F.broadcast(words), "word").where(F.expr("bit_get(bits, cast(bit % 64 as int)) = 1")).select("doc_id", "k1", "k2", "text")
    # The id is part of the join, so that of many copies of a text only the representative's is shuffled to its place.
    on = (picked["k1"] == wanted["k1"]) & (picked["k2"] == wanted["k2"]) & picked["doc_id"].eqNullSafe(wanted["id"])
    return picked.join(wanted, on).groupBy("node").agg(F.first("text").alias("text"))


def _near(least: float) -> Column:
    """Whether a pair with keys ka and kb, lengths na and nb, may be similar."""
    long = F.greatest("na", "nb")
    return (F.least("na", "nb") >= least * long) & (F.size(F.array_intersect("ka", "kb")) >= F.when(long < SHORT, 1).otherwise(AGREE))


def verify(pairs: DataFrame, reps: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) of nodes -> links (a, b, similarity) of at least `least`."""
    spark = rows.sparkSession
    sides = [reps.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("keys").alias(f"k{s}")) for s in ("a", "b")]
    if pairs.isEmpty():
        return pairs.select("a", "b", F.lit(0.0).alias("similarity"))
    close = cut(spark, pairs.join(sides[0], "a").join(sides[1], "b").where(_near(least)).select("a", "b"))
    texts = cut(spark, _texts(rows, reps, close.selectExpr("a AS node").union(close.selectExpr("b AS node")).distinct()))
    both = close.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return map_arrow(both, _verified, "a long, b long, similarity double").where(F.col("similarity") >= least)


def _to_hubs(shared: DataFrame) -> DataFrame:
    """One pair a text: with the hub that most of its buckets have. shared: (node, hub)."""
    best = shared.where("node <> hub").groupBy("node").agg(F.mode("hub", True).alias("hub"))
    return best.selectExpr("least(hub, node) AS a", "greatest(hub, node) AS b").distinct()


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows (row, id, k1, k2), and one row a different text: (k1, k2, node, id, n_copies, class).

    id is the smallest id of the text's rows, class a number that the texts of a class share.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    all_rows = cut(spark, _sketches(rows))
    copies = cut(spark, all_rows.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n_copies")))
    # One row for each text; joined by unique numbers, so a text with very many copies is no hot key.
    reps = cut(spark, all_rows.withColumnRenamed("row", "node").join(copies.select("node"), "node", "left_semi").select("node", "id", "k1", "k2", "n", "keys"))
    members = reps.select("node", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where("size > 1")
    shared = cut(spark, members.join(sizes, "key").select("key", "node", "size", "hub"))
    links = cut(spark, verify(cut(spark, _to_hubs(shared)), reps, rows, least).select("a", "b"))
    classes = components(links)
    for turn in (1, 2):
        labelled = shared.join(classes, "node", "left").select("key", "node", "size", F.coalesce("class", "node").alias("class"))
        # Open buckets: several components are left in them.
        open_ = labelled.groupBy("key").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.min_by("node", F.xxhash64("node", "key")).alias("hub"), F.min_by("class", F.xxhash64("node", "key")).alias("hub_class")).where("c0 <> c1").select("key", "hub", "hub_class")
        left = cut(spark, labelled.join(open_, "key"))
        large = left.where(F.col("size") > SMALL)
        if turn == 1:
            more = _across(left.where(F.col("size") <= SMALL).select("key", "node", "class")).union(_to_hubs(large.where("class <> hub_class").select("node", "hub")))
            found = verify(cut(spark, more.distinct().join(links, ["a", "b"], "left_anti")), reps, rows, least)
        elif large.isEmpty():
            break
        else:
            found = _within_dense(large.select("key", "node", "class"), reps, rows, least)
        new = cut(spark, found.select("a", "b"))
        if not new.isEmpty():
            classes = components(classes.select(F.col("node").alias("a"), F.col("class").alias("b")).union(new))
    texts = copies.join(classes.select("node", "class"), "node", "left").select("k1", "k2", "node", F.col("least_id").alias("id"), "n_copies", F.coalesce("class", "node").alias("class"))
    return all_rows.select("row", "id", "k1", "k2"), cut(spark, texts)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_copies) of every row: the smallest id of its class, and exact copies of its text."""
    rows, texts = text_classes(docs, id_col, text_col, least)
    named = texts.join(texts.groupBy("class").agg(F.min("id").alias("class_id")), "class").select("k1", "k2", "class_id", "n_copies")
    return rows.join(named, ["k1", "k2"]).select(F.col("id").alias("doc_id"), "class_id", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, one of each class of near-duplicates: that of the smallest id (null ids last).

    Rows are told apart by id and text; of rows that repeat both, one stays.
    """
    rows, texts = text_classes(docs, id_col, text_col, least)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    chosen = texts.groupBy("class").agg(F.min(F.struct(order.alias("order"), "k1", "k2")).alias("x")).select(F.col("x.order.id").alias("__id"), F.col("x.k1").alias("__k1"), F.col("x.k2").alias("__k2"))
    same = lambda left, id_, k1, k2: (left[k1] == chosen["__k1"]) & (left[k2] == chosen["__k2"]) & left[id_].eqNullSafe(chosen["__id"])
    shown = docs.withColumns(dict(zip(("__k1", "__k2"), text_keys(F.col(f"`{text_col}`")))))
    shown = shown.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("__k1").alias("__t1"), F.col("__k2").alias("__t2"), F.col(f"`{id_col}`").alias("__own"))
    kept = shown.join(chosen, same(shown, "__own", "__t1", "__t2"), "left_semi")
    repeats = rows.join(chosen, same(rows, "id", "k1", "k2"), "left_semi").groupBy("id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates(["__own", "__t1", "__t2"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def _within_dense(members: DataFrame, reps: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b, similarity) that join components within large buckets; members: (key, node, class).

    A bucket's members are dealt into blocks of about BLOCK_SHINGLES shingles and BLOCK_ROWS rows, and each pair of
    blocks is one task's. Sketches and shingles are compared as arrays of 32-bit hashes, each pair in the first bucket
    that it shares; what seems similar and joins components, no more pairs than texts, is then verified like all others.
    """
    spark = rows.sparkSession

    def packed(batches):
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                found = shingles(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in found], pa.binary())], ["node", "shingles"])

    own = map_arrow(_texts(rows, reps, members.select("node").distinct()), packed, "node long, shingles binary")
    short = reps.select("node", "n", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("keys"))
    sized = members.join(short.select("node", "n"), "node")
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = cut(spark, own.join(short.select("node", "keys"), "node"))
    full = dealt.join(whole, "node").select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "class", "keys", "shingles")

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        nodes, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        texts = [np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()]
        lengths = np.array([len(x) for x in texts])
        mine = int(np.flatnonzero(keys[0] == np.int32(table.column("key")[0].as_py() >> 32))[0])
        _, root = np.unique(table.column("class").to_numpy(), return_inverse=True)
        out = []
        for i in range(len(nodes) - 1):
            long = np.maximum(lengths[i + 1 :], lengths[i])
            ok = (root[i + 1 :] != root[i]) & (np.minimum(lengths[i + 1 :], lengths[i]) >= least * long)
            if not same:
                ok &= block[i + 1 :] != block[i]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            agree = keys[i + 1 + at] == keys[i]
            good = (agree.argmax(axis=1) == mine) & (agree.sum(axis=1) >= np.where(long[at] < SHORT, 1, AGREE))
            for j in (at[good] + i + 1).tolist():
                if root[i] != root[j] and similarity(texts[i], texts[j], least) >= least:
                    root[root == root[j]] = root[i]
                    out.append((nodes[i], nodes[j]))
        release()
        return pa.table([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    ship(spark)
    small_batches(spark)
    found = full.groupBy("key", "lo", "hi").applyInArrow(settle, "a long, b long").distinct()
    return verify(cut(spark, found), reps, rows, least)


def _across(members: DataFrame) -> DataFrame:
    """Pairs (a < b) of a small bucket's members in different components."""
    other = members.select("key", F.col("node").alias("b"), F.col("class").alias("class_b"))
    return members.withColumnRenamed("node", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.col("class") != F.col("class_b"))).select("a", "b").distinct()
