"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scans the training texts.

Normalised words: A-Z lower-cased, then maximal runs of digits, a-z and non-ASCII characters. A window is 13
consecutive words of an item; an item of fewer words, but not none, is one window. The hash set holds one 64-bit
hash per window with its items; a hit of a hash is verified by comparing the words. The benchmark is broadcast
only below a checked bound; above it a bitmap of window hashes, of fixed size, is, and the windows that it lets through
are joined with those of the benchmark by their words.

Defined results: null, empty or wordless texts have no words, no hits and are not contaminated; repeated rows each
get their own result; an empty benchmark contaminates nothing; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointsmith.session import cut

from . import textblocks as tb
from .common import MAX_BROADCAST_BYTES, id_text, map_arrow

WINDOW = 13
#: Bytes that are not part of a word, after lower-casing A-Z.
NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_SEPARATORS = tb.separators(NOT_WORD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SCHEMA = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_spans array<struct<start:int,end:int>>"


def _lowered(column: pa.Array) -> tb.Block:
    block = tb.Block(column)
    block.data = _LOWER[block.data]
    return block


def _grams(block: tb.Block, sizes: list[int]):
    """The block's words, then (k, hashes, first words) for each k."""
    starts, ends, rows, bounds = tb.words(block, _SEPARATORS)
    hashes = tb.word_hashes(block.data, starts, ends)
    return starts, ends, rows, bounds, [(k, *tb.gram_hashes(hashes, rows, k)) for k in sizes]


def _window_key(block: tb.Block, starts: np.ndarray, ends: np.ndarray, first: int, k: int) -> bytes:
    return b" ".join(block.data[starts[j] : ends[j]].tobytes() for j in range(first, first + k))


def benchmark_windows(items: pa.Table, window: int = WINDOW) -> dict[bytes, tuple[int, int, list[str]]]:
    """Each window's words -> (hash, number of words, ids of the items that have it)."""
    found: dict[bytes, tuple[int, int, set]] = {}
    column = items.column("text").combine_chunks()
    ids = items.column("item_id").to_pylist()
    for lo, hi in tb.slices(column):
        block = _lowered(column.slice(lo, hi - lo))
        starts, ends, rows, bounds, _ = _grams(block, [])
        hashes = tb.word_hashes(block.data, starts, ends)
        counts = np.diff(bounds)
        for k in sorted({min(window, int(c)) for c in counts if c}):
            got, first = tb.gram_hashes(hashes, rows, k)
            for h, f in zip(got.tolist(), first.tolist()):
                r = rows[f]
                if counts[r] == k or k == window:
                    key = _window_key(block, starts, ends, f, k)
                    found.setdefault(key, (h, k, set()))[2].add(str(ids[lo + r]))
    return {key: (h, k, sorted(own)) for key, (h, k, own) in found.items()}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _verdict(n_words: int, hits: list[tuple[int, int, list[str]]]) -> tuple:
    """n_hit, items and merged spans in words, from verified (first word, k, items)."""
    merged = _merge([(f, f + k) for f, k, _ in hits])
    n_hit = sum(e - s for s, e in merged)
    items = sorted({x for _, _, own in hits for x in own})
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n_hit, items, digest, n_hit > 0 and 20 * n_hit >= n_words, merged


class Scanner:
    """The hash sets of one benchmark, by window size. windows: words -> (hash, number of words, items)."""

    def __init__(self, windows: dict[bytes, tuple[int, int, list[str]]]):
        self.windows = windows
        self.sizes = sorted({k for _, k, _ in windows.values()})
        self.sets = {k: np.unique(np.array([h for h, j, _ in windows.values() if j == k], np.uint64)) for k in self.sizes}

    def verdicts(self, texts: pa.Array) -> list[tuple]:
        """n_words, n_hit, n_items, items_sha256, contaminated, items and hit spans of each whole text."""
        out = []
        for lo, hi in tb.slices(texts):
            block = _lowered(texts.slice(lo, hi - lo))
            starts, ends, rows, bounds, grams = _grams(block, self.sizes)
            hits = defaultdict(list)
            for k, hashes, first in grams:
                own = self.sets[k]
                at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
                for f in first[own[at] == hashes].tolist():
                    if (known := self.windows.get(_window_key(block, starts, ends, f, k))) is not None:
                        hits[int(rows[f])].append((f, k, known[2]))
            for r in range(len(block)):
                n = int(bounds[r + 1] - bounds[r])
                n_hit, items, digest, bad, merged = _verdict(n, hits.get(r, []))
                out.append((n, n_hit, len(items), digest, bad, items, [{"start": int(s - bounds[r]), "end": int(e - bounds[r])} for s, e in merged]))
        return out


def _batch(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans"])


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("item_id is not null and text is not null")


def _shared(items: DataFrame, window: int, max_broadcast_bytes: int):
    """A broadcast of the items' scanner, or None beyond the bound.

    A window of w bytes takes about 13 w bytes in the hash set, so the benchmark's bytes are held against a
    sixteenth of the bound.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0)).alias("b")).first()["b"]
    if size * 16 > max_broadcast_bytes:
        return None
    return items.sparkSession.sparkContext.broadcast(Scanner(benchmark_windows(items.toArrow(), window)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, items, and the hit spans in words."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    items = _items(benchmark, item_col, item_text_col)
    if (shared := _shared(items, window, max_broadcast_bytes)) is None:
        return _by_hash(rows, items, kind, window)

    def run(batches):
        for batch in batches:
            yield _batch(batch.column(0), shared.value.verdicts(batch.column(1)))

    return map_arrow(rows, run, SCHEMA.format(id=kind))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated: judged and kept in one pass.

    Beyond the broadcast bound the verdicts of contaminated texts, few, are joined back by a hash of the text.
    """
    items = _items(benchmark, item_col, item_text_col)
    if (shared := _shared(items, window, max_broadcast_bytes)) is None:
        key = [F.xxhash64(F.lit(k), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) for k in (0, 1)]
        rows = docs.select(F.array(*key).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        bad = _by_hash(rows, items, "array<bigint>", window).where("contaminated").select(F.col("doc_id").alias("__key")).distinct()
        return docs.withColumn("__key", F.array(*key)).join(bad, "__key", "left_anti").select(*docs.columns)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            judged = shared.value.verdicts(batch.column(at).cast(pa.string()))
            yield batch.filter(pa.array([not x[4] for x in judged], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


#: Bits of the bitmap that stands for a benchmark beyond the broadcast bound: 32 MB, whatever the benchmark.
BITMAP_BITS = 1 << 28


def _emit_items(window: int):
    """Rows of the items' windows, with their hashes' places in the bitmap."""

    def run(batches):
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1), tb.BLOCK_BYTES // 8):
                found = benchmark_windows(pa.table({"item_id": batch.column(0).slice(lo, hi - lo), "text": batch.column(1).slice(lo, hi - lo)}), window)
                flat = [(h % BITMAP_BITS, k, key, i) for key, (h, k, own) in found.items() for i in own]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], kind) for c, kind in enumerate(kinds)], ["bit", "k", "key", "item_id"])

    return run


def _emit_hits(shared, sizes: list[int]):
    """(doc_id, h1, h2, n_words, hits): each document's windows that the bitmap may hold, with where they begin."""

    def run(batches):
        bits = shared.value
        for batch in batches:
            for lo, hi in tb.slices(batch.column(3), tb.BLOCK_BYTES // 4):
                block = _lowered(batch.column(3).slice(lo, hi - lo))
                starts, ends, rows, bounds, grams = _grams(block, sizes)
                found = [defaultdict(list) for _ in range(len(block))]
                for k, hashes, first in grams:
                    at = hashes % np.uint64(BITMAP_BITS)
                    may = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                    for f in first[may == 1].tolist():
                        found[rows[f]][k, _window_key(block, starts, ends, f, k)].append(int(f - bounds[rows[f]]))
                hits = [[{"k": k, "key": w, "firsts": at} for (k, w), at in own.items()] for own in found]
                kind = pa.list_(pa.struct([("k", pa.int32()), ("key", pa.binary()), ("firsts", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(3)), pa.array(np.diff(bounds), pa.int64()), pa.array(hits, kind)], ["doc_id", "h1", "h2", "n_words", "hits"])

    return run


def _judged(batches):
    for batch in batches:
        out = []
        for n, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            n_hit, items, digest, bad, merged = _verdict(n, [(f, x["k"], x["items"]) for x in hits or [] for f in x["firsts"]])
            out.append((n, n_hit, len(items), digest, bad, items, [{"start": s, "end": e} for s, e in merged]))
        yield _batch(batch.column(0), out)


def _by_hash(rows: DataFrame, items: DataFrame, kind: str, window: int) -> DataFrame:
    """For benchmarks beyond the bound: a broadcast bitmap of window hashes, and an exact join of what it lets through.

    The bitmap has a fixed size; a fuller one lets more windows through to the join, and loses none. A document's
    occurrences of a window are one row; no text is shuffled. Rows are told apart by 128 bits of their content, so repeated rows, which
    have the same verdict, need no other identity.
    """
    spark = rows.sparkSession
    windows = cut(spark, map_arrow(items, _emit_items(window), "bit long, k int, key binary, item_id string").groupBy("k", "key").agg(F.min("bit").alias("bit"), F.array_sort(F.collect_set("item_id")).alias("items")))
    sizes = [r["k"] for r in windows.select("k").distinct().collect()]  # at most `window` values
    words = windows.groupBy(F.expr("bit div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 as int)))").cast("int").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    bitmap[words.column("byte").to_numpy()] = words.column("bits").to_numpy().astype(np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)
    text = F.coalesce("text", F.lit(""))
    keyed = rows.select("doc_id", F.xxhash64("doc_id", text).alias("h1"), F.xxhash64(F.lit(1), text, "doc_id").alias("h2"), "text")
    found = cut(spark, map_arrow(keyed, _emit_hits(shared, sizes), f"doc_id {kind}, h1 long, h2 long, n_words long, hits array<struct<k:int,key:binary,firsts:array<int>>>"))
    hits = found.where(F.size("hits") > 0).select("h1", "h2", F.inline("hits")).join(windows.drop("bit"), ["k", "key"]).groupBy("h1", "h2").agg(F.collect_set(F.struct("k", "firsts", "items")).alias("hits"))
    return map_arrow(found.drop("hits").join(hits, ["h1", "h2"], "left").select("doc_id", "n_words", "hits"), _judged, SCHEMA.format(id=kind))
