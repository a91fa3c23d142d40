"""Exact line dedup over all documents; only DataFrame functions, no Python on the executors.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased. Keys of at least `min_chars` code
points found in at least `min_docs` documents lose their lines in every document but the one with the largest id.

How: one pass over the texts writes (128-bit key hash, document, position) to the shared folder. Those rows are range
partitioned by hash and sorted by document and position, so each task streams past the keys and sees the surviving
occurrence first. What comes back is no text but a keep bitmap per document: 64-bit words up to the last one with a
dropped line (bit 1: keep; lines beyond are kept). Keys with a large share of all rows, found by a frequent-items
sketch, are dealt over all partitions; their document count and survivor come from a map-side aggregate and are
broadcast: a key needs over 1/(4P) of the rows to count as such, so there are fewer than 4P of them.

Defined results: null or empty texts are one empty line; rows with a null id neither count as a document nor lose
lines; repeated rows lose the same lines; rows that share an id but not the text count as one document, and each gets
its own bitmap; empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointsmith.session import cut

MIN_CHARS = 20
MIN_DOCS = 3
#: White space that is stripped, and the letters that are lower-cased.
WHITE = " \t\n\x0b\x0c\r"
#: Groups of tasks that merge their sketches of frequent keys.
MERGERS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _row_hash(text: F.Column) -> F.Column:
    return F.xxhash64(text)


def _key(line: F.Column) -> F.Column:
    """Only A-Z change: lower() is the same thing, and faster, on lines that are all ASCII."""
    bare = F.trim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, row, pos) of every line whose key is long enough."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), _row_hash(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= min_chars).select("id", "row", "pos", _key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "row", "pos")


def _heavy(rows: DataFrame, parts: int, min_docs: int) -> DataFrame | None:
    """Keys that hold over 1/(4 parts) of all rows: (h1, h2, survivor, enough), or None if there are none.

    The sketches of MERGERS groups of tasks are merged within each group, then their items are summed, so no task
    reads all sketches. Each tracks 64 items a partition, so it counts to within a fraction of the threshold.
    """
    spark = rows.sparkSession
    most = min(4 * parts, 250_000)
    some = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {most}, {min(64 * parts, 1_000_000)})").alias("top"))
    some = cut(spark, some)
    total = some.agg(F.sum("n").alias("n")).first()["n"] or 0
    chosen = some.select(F.inline("top")).groupBy("item").agg(F.sum("count").alias("n")).where((F.col("n") * 4 * parts > total) & (F.col("n") > 1000)).select(F.col("item").alias("h1"))
    chosen = cut(spark, chosen)
    if chosen.isEmpty():
        return None
    # Partial sums leave the map side: one row for each key and document there, then one for each key.
    each = rows.join(F.broadcast(chosen), "h1", "left_semi").select("h1", "h2", "id").distinct()
    return cut(spark, each.groupBy("h1", "h2").agg(F.max("id").alias("survivor"), (F.count(F.lit(1)) >= min_docs).alias("enough")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, row, pos) of every line that goes."""
    spark = docs.sparkSession
    rows = cut(spark, line_rows(docs, id_col, text_col, min_chars))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = _heavy(rows, parts, min_docs)
    if heavy is None:
        dealt = rows.withColumns({"survivor": F.lit(None).cast(rows.schema["id"].dataType), "enough": F.lit(None).cast("boolean"), "salt": F.lit(0)})
    else:
        dealt = rows.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("salt", F.when(F.col("enough").isNull(), 0).otherwise(F.pmod(F.hash("id"), F.lit(4 * parts))))
    key = ["h1", "h2", "salt"]
    # The range partitioning serves both windows: no further exchange.
    ordered = dealt.repartitionByRange(parts, *key).sortWithinPartitions(*key, F.col("id").desc(), "pos")
    ranked = ordered.withColumn("nth", F.dense_rank().over(Window.partitionBy(*key).orderBy(F.col("id").desc()))).withColumn("n", F.max("nth").over(Window.partitionBy(*key)))
    goes = F.when(F.col("enough").isNull(), (F.col("n") >= min_docs) & (F.col("nth") > 1)).otherwise(F.col("enough") & (F.col("id") < F.col("survivor")))
    return ranked.where(goes).select("id", "row", "pos")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, row, n_dropped, keep): a bitmap for each document that loses lines; the others keep all."""
    words = dropped_lines(docs, id_col, text_col, min_chars, min_docs).distinct().groupBy("id", "row", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.count(F.lit(1)).alias("k"), F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    found = words.groupBy("id", "row").agg(F.sum("k").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    return found.select("id", "row", "n_dropped", F.expr("transform(sequence(0, array_max(map_keys(bits))), w -> ~coalesce(bits[w], 0L))").alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the text of what is kept and the columns `__n_lines` and `__n_dropped`."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    shown = docs.withColumn("__row", _row_hash(text))
    maps = bitmaps.select(F.col("id").alias("__id"), F.col("row").alias("__row2"), F.col("n_dropped").alias("__n_dropped"), F.col("keep").alias("__keep"))
    both = shown.join(maps, (F.col(f"`{id_col}`") == F.col("__id")) & (F.col("__row") == F.col("__row2")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: _kept(i)), "\n")
    new = F.when(F.col("__keep").isNull(), F.col(f"`{text_col}`").cast("string")).otherwise(kept)
    return both.withColumns({"__n_lines": F.size(lines).cast("long"), "__n_dropped": F.coalesce("__n_dropped", F.lit(0)).cast("long"), text_col: new}).drop("__row", "__id", "__row2", "__keep")


def _kept(i: F.Column) -> F.Column:
    word = F.get(F.col("__keep"), F.floor(i / 64).cast("int"))
    return F.coalesce(F.call_function("bit_get", word, (i % 64).cast("int")) == 1, F.lit(True))
