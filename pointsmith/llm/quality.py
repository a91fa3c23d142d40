"""Quality by nearest-neighbour voting: exact blocked cosine products with labelled latent-semantic vectors.

Terms are lexical: the words of a text as they are written, its subwords (runs of four bytes, over word ends too), and
words used again (the occurrence numbers of its words, by powers of two, and repeats of one of the three words before).
They are hashed to 4096 columns, weighted by log frequency and inverse document frequency, and projected on the leading
singular vectors of the labelled sample. Every document is held against every labelled vector (a block of documents
times one matrix); the `neighbours` nearest vote with their labels, weighted by a power of similarity.

Fitted on a bounded sample of labelled rows outside the held-out fold (`rows_per_class`, and the bytes and letters of
`labelled.sample`), on the driver. The broadcast model has 4096 x 64 + rows x 64 floats: at most about 3 MB, whatever
the corpus. `keep_good` judges and keeps in one pass over whole rows: nothing is shuffled.

Defined results: null, empty and wordless texts have the zero vector and get the share of label 1 among the sample;
without any labels every score is 0.5; ids with several labels count with the largest; rows with a null id are scored,
outside the held-out fold; repeated rows each get their own result; texts are taken whole; other columns, whatever
their names, play no part; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import id_text, map_arrow
from .labelled import remainder, sample

COLUMNS = 4096
DIMENSIONS = 64
SUBWORD = 4
ROWS_PER_CLASS = {0: 2500, 1: 3500}
NEIGHBOURS = 25
FOLDS, HELD_OUT = 3, 1
POWER_STEPS = 3
#: Rows whose terms are dense at a time.
ROWS_AT_ONCE = 64


def term_counts(block: tb.Block) -> np.ndarray:
    """Rows x COLUMNS: how often each hashed term occurs."""
    n, data = len(block), block.data
    cells = []

    def add(codes: np.ndarray, rows: np.ndarray, salt: int) -> None:
        cells.append(rows * COLUMNS + (tb.mix(codes + tb.SALTS[salt]) >> np.uint64(52)).astype(np.int64))

    starts, ends, rows, _ = tb.words(block, tb.WHITE)
    if len(starts):
        hashes = tb.word_hashes(data, starts, ends)
        add(hashes, rows, 1)
        add(np.log2(tb.occurrences(hashes, rows) + 1).astype(np.uint64), rows, 3)
        for back in (1, 2, 3):
            again = (hashes[back:] == hashes[:-back]) & (rows[back:] == rows[:-back])
            add(np.full(int(again.sum()), back, np.uint64), rows[back:][again], 4)
        if (size := len(data) - SUBWORD + 1) > 0:
            row = np.repeat(np.arange(n), np.diff(block.offsets))
            code = np.zeros(size, np.uint64)
            for j in range(SUBWORD):
                code = (code << np.uint64(8)) | data[j : size + j]
            inside = row[:size] == row[SUBWORD - 1 :]
            add(code[inside], row[:size][inside], 2)
    flat = np.concatenate(cells) if cells else np.zeros(0, np.int64)
    return np.bincount(flat, minlength=n * COLUMNS).reshape(n, COLUMNS).astype(np.float32)


def _parts(column: pa.Array):
    """The column's counts, ROWS_AT_ONCE rows or one block of text at a time."""
    for lo, hi in tb.slices(column, tb.BLOCK_BYTES // 2):
        for at in range(lo, hi, ROWS_AT_ONCE):
            yield term_counts(tb.Block(column.slice(at, min(ROWS_AT_ONCE, hi - at))))


class Model:
    def __init__(self, rate: float):
        self.rate, self.labels = rate, np.zeros(0, np.float32)
        self.weights = self.axes = self.vectors = None

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """Rows of unit length, in place."""
        counts *= 1000 / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        np.log1p(counts, out=counts)
        counts *= self.weights
        counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
        return counts

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return np.where(norm > 1e-6, z / np.maximum(norm, 1e-12), 0).astype(np.float32)

    def vote(self, z: np.ndarray, neighbours: int, block: int = 512) -> np.ndarray:
        """Exact: every row of z against every labelled vector, a block of rows at a time."""
        out = np.full(len(z), self.rate)
        k = min(neighbours, len(self.labels))
        for lo in range(0, len(z), block):
            near = z[lo : lo + block] @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(float) ** 8
            total = weight.sum(axis=1)
            out[lo : lo + block] = np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-300), self.rate)
        return out

    def scores(self, texts: pa.Array, neighbours: int) -> np.ndarray:
        """The score of each whole text."""
        if self.vectors is None:
            return np.full(len(texts), self.rate)
        z = [self.latent(self.weighted(counts)) for counts in _parts(texts)]
        return self.vote(np.vstack(z), neighbours) if z else np.zeros(0)


def fit(table: pa.Table, dimensions: int = DIMENSIONS) -> Model:
    labels = (np.array(table.column("label").to_pylist(), int) > 0).astype(np.float32) if table.num_rows else np.zeros(0, np.float32)
    model = Model(float(labels.mean()) if len(labels) else 0.5)
    if len(labels) < 2:
        return model
    # Rows are kept by their non-zero terms and made dense some at a time, so the driver holds no large matrix.
    kept, documents = [], np.zeros(COLUMNS)
    for counts in _parts(table.column("text").combine_chunks()):
        documents += np.count_nonzero(counts, axis=0)
        at = np.nonzero(counts)
        kept.append((len(counts), at[0].astype(np.int16), at[1].astype(np.int16), counts[at]))
    model.weights = (np.log((1 + len(labels)) / (1 + documents)) + 1).astype(np.float32)

    def rows():
        for n, r, c, v in kept:
            x = np.zeros((n, COLUMNS), np.float32)
            x[r, c] = v
            yield model.weighted(x)

    # Leading singular vectors by subspace iteration, a block of rows at a time.
    width = min(dimensions + 16, len(labels), COLUMNS)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((COLUMNS, width)).astype(np.float32))[0]
    for _ in range(POWER_STEPS):
        q = np.linalg.qr(sum(x.T @ (x @ q) for x in rows()))[0]
    shown = np.vstack([x @ q for x in rows()])
    _, _, right = np.linalg.svd(shown, full_matrices=False)
    model.axes = (q @ right.T)[:, :dimensions].astype(np.float32)
    model.labels, model.vectors = labels, np.vstack([model.latent(x) for x in rows()])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    rows = id_text(docs, id_col, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1), neighbours), pa.float64())], ["doc_id", "score"])

    scored = map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more: judged and kept in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            yield batch.filter(pa.array(shared.value.scores(texts, neighbours) >= 0.5))

    return map_arrow(docs, run, docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows_per_class: dict[int, int] | None = None, folds: int = FOLDS, held_out: int = HELD_OUT) -> pa.Table:
    return sample(docs, labels, label_col, rows_per_class or ROWS_PER_CLASS, folds, held_out)


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows_per_class: dict[int, int] | None = None, neighbours: int = NEIGHBOURS, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Fit on labels outside the held-out fold, then score every document."""
    model = fit(training_rows(docs, labels, label_col, rows_per_class, folds, held_out))
    return score(docs, model, neighbours=neighbours, folds=folds, held_out=held_out)
