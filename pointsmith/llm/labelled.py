"""Bounded, repeatable samples of labelled documents to fit a classifier on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: Bounds on what is fitted on (scoring takes whole texts of any length): letters of a row, and bytes in all.
MAX_TRAIN_CHARS = 20_000
MAX_TRAIN_BYTES = 24 << 20


def remainder(id_col: str, folds: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_class: dict[int, int], folds: int, held_out: int, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", max_chars: int = MAX_TRAIN_CHARS, max_bytes: int = MAX_TRAIN_BYTES) -> pa.Table:
    """(doc_id, label, text) of at most rows_per_class[c] rows of each class c outside the held-out fold, chosen by a hash of the id.

    Rows of over `max_chars` letters are passed over before rows are counted; beyond `max_bytes` in all, rows with the
    largest hashes go. Ids with several labels count with the largest, ids with several texts with the largest text;
    null ids, labels and texts are passed over. The texts are read twice: for their lengths, and for the chosen rows.
    """
    known = labels.select(F.col(f"`{label_id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).where(remainder("doc_id", folds) != held_out)
    texts = id_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & (F.char_length("text") <= max_chars))
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("size")).groupBy("doc_id").agg(F.max("size").alias("size")).join(known, "doc_id")
    order = F.xxhash64("doc_id")
    found = []
    for c, most in rows_per_class.items():
        found += sizes.where(F.col("label") == c).select("doc_id", "label", "size", order.alias("h")).orderBy("h", "doc_id").limit(most).collect()
    chosen, total = [], 0
    for r in sorted(found, key=lambda r: (r["h"], r["doc_id"])):
        total += r["size"]
        if total <= max_bytes or not chosen:
            chosen.append((r["doc_id"], r["label"]))
    ids = docs.sparkSession.createDataFrame(chosen, known.schema)
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).toArrow().sort_by([("doc_id", "ascending")])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights, the last one for the constant, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty @ w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
