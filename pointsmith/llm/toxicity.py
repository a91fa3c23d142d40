"""Toxicity by compression distance: zstandard with a dictionary of ordinary text, and with one of toxic text besides.

A window is one word (letters only, lower case; pieces of at most 40 letters) in a fixed frame of ordinary text, so
that the compressor looks for it in its dictionary. It is compressed twice: against a dictionary trained on ordinary
text, and against that one followed by a dictionary trained on what toxic texts hold and ordinary ones don't. A toxic
window gets short in the second only. The pair of lengths, with the window's own, is calibrated on rows that trained
neither dictionary: how much oftener toxic texts hold such a window. A text's score is a logistic of its strongest
windows, fitted on a third set of rows, so 0.5 is the calibrated threshold.

Fitted on a bounded sample of labelled rows outside the held-out fold (`toxic_rows`, `ordinary_rows`), on the driver;
every whole text is scored on the executors with a broadcast model of under a megabyte.

Defined results: null, empty and wordless texts get the score of a text without any telling window; without labels of
both classes every score is the share of toxic labels (0 without any); repeated rows each get their own result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import id_text, map_arrow, worker_state
from .labelled import fit_logistic, logistic, remainder, sample

TOXIC_ROWS = 6000
ORDINARY_ROWS = 8000
FOLDS, HELD_OUT = 5, 0
PIECE = 40
CACHE_WORDS = 500_000
ORDINARY_BYTES, TOXIC_BYTES = 65536, 12288
_WORDS = re.compile(r"[^\W\d_]+").findall


def windows(text: str) -> set[str]:
    """The distinct windows of a whole text."""
    found = set(_WORDS(text.lower()))
    return {p for w in found for p in ([w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w), PIECE)])}


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; of too few samples, their end."""
    total = sum(map(len, samples))
    if total and len(samples) > 10:
        try:
            return zstandard.train_dictionary(size, samples * max(1, math.ceil(10 * size / total))).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:] or b" " * 64


class Lengths:
    """Window -> (own bytes, compressed with ordinary text, compressed with toxic text as well)."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.frame = ordinary[-96:]
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(ordinary + toxic)

    @staticmethod
    def _compressor(content: bytes):
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=16, chain_log=16, search_log=6, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def __call__(self, window: str) -> tuple[int, int, int]:
        own = f" {window} ".encode()
        data = own + self.frame
        return min(len(own), 24), len(self.ordinary.compress(data)), len(self.toxic.compress(data))


class Model:
    def __init__(self, rate: float):
        self.rate, self.key = rate, uuid.uuid4().hex
        self.ordinary = self.toxic = b""
        self.cells: dict[tuple[int, int, int], float] = {}
        self.weights: np.ndarray | None = None

    def scorer(self):
        lengths, cells = Lengths(self.ordinary, self.toxic), self.cells
        known: dict[str, float] = {}

        def features(text: str) -> list[float]:
            found = []
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in windows(text):
                if (v := known.get(w)) is None:
                    v = known[w] = cells.get(lengths(w), 0.0)
                if v > 0:
                    found.append(v)
            found.sort(reverse=True)
            top = (found + [0.0, 0.0, 0.0])[:3]
            return [*top, math.log1p(sum(v for v in found if v > 1)), max(0.0, top[0] - 3)]

        return features


def fit(table: pa.Table) -> Model:
    texts, labels = table.column("text").to_pylist(), np.array(table.column("label").to_pylist(), int)
    y = (labels > 0).astype(int)
    model = Model(float(y.mean()) if len(y) else 0.0)
    if min(y.sum(), (1 - y).sum()) < 6:
        return model
    part = np.zeros(len(y), int)
    for c in (0, 1):  # half trains dictionaries, a quarter calibrates windows, a quarter texts
        part[y == c] = np.array([0, 1, 0, 2])[np.arange((y == c).sum()) % 4]
    rows = [[(texts[i], y[i]) for i in np.flatnonzero(part == k)] for k in range(3)]
    seen = (Counter(), Counter())
    n = Counter(int(c) for _, c in rows[0])
    for t, c in rows[0]:
        seen[c].update(windows(t))
    odds = lambda w: math.log((seen[1][w] + 0.5) / (n[1] + 1)) - math.log((seen[0][w] + 0.5) / (n[0] + 1))
    telling = {w for w, k in seen[1].items() if k >= min(4, 1 + n[1] // 100) and odds(w) > 2}
    toxic = [(" " + " ".join(w for w in _WORDS(t.lower()) if w in telling) + " ").encode() for t, c in rows[0] if c]
    ordinary = []
    for t, c in rows[0]:
        w = _WORDS(t.lower()) if not c else []
        ordinary += [(" " + " ".join(w[i : i + 40]) + " ").encode() for i in range(0, len(w), 40)]
    model.ordinary, model.toxic = _dictionary(ordinary, ORDINARY_BYTES), _dictionary([x for x in toxic if len(x) > 8], TOXIC_BYTES)
    lengths, known = Lengths(model.ordinary, model.toxic), {}
    counts = (Counter(), Counter())
    for t, c in rows[1]:
        for w in (found := windows(t)):
            if w not in known:
                known[w] = lengths(w)
        counts[c].update({known[w] for w in found})
    m = Counter(int(c) for _, c in rows[1])
    model.cells = {k: v for k in {*counts[0], *counts[1]} if abs(v := math.log((counts[1][k] + 0.5) / (m[1] + 1)) - math.log((counts[0][k] + 0.5) / (m[0] + 1))) > 0.1}
    features = model.scorer()
    model.weights = fit_logistic(np.array([features(t) for t, _ in rows[2]]), np.array([c for _, c in rows[2]], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    rows = id_text(docs, id_col, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        features = None
        if own.weights is not None:  # a worker keeps the lengths it knows for one model at a time
            features = worker_state(("toxicity", own.key), own.scorer)
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                if features is None:
                    got = np.full(len(texts), own.rate)
                else:
                    got = logistic(np.array([features(t or "") for t in texts]), own.weights)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(got, pa.float64())], ["doc_id", "score"])

    scored = map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Fit on labels outside the held-out fold, then score every document."""
    model = fit(sample(docs, labels, label_col, {1: toxic_rows, 0: ordinary_rows}, folds, held_out))
    return score(docs, model, folds=folds, held_out=held_out)
