"""Text functions: the search tokenizer, chunking, composite text, a deterministic embedder for tests."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from pointsmith.session import ship


def tokenize(text: Column) -> Column:
    """Lower case, split at white space and ASCII punctuation, trim what is no letter or number, drop one-byte tokens."""
    parts = F.split(F.lower(text), r"[\p{IsWhite_Space}\p{Punct}]+")
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""))
    return F.filter(trimmed, lambda x: F.octet_length(x) > 1)


def composite_text(fields: list[str]) -> Column:
    """`field: value` of the non-blank string fields, joined by `. `."""
    parts = [F.when(F.trim(F.col(f)) != "", F.concat(F.lit(f"{f}: "), F.col(f))) for f in fields]
    return F.concat_ws(". ", *parts)


def chunks_of(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Pieces of about `size` characters that end at a paragraph, else a sentence, past their half; `overlap` is shared.

    A text of at most `size` characters is its own only piece. A last piece that ends less than `overlap` before a full
    window's end is followed by one more, the shared part alone, as each window starts `overlap` before the end of the
    one before. Blank pieces are left out.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    out, at = [], 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            for mark, keep in (("\n\n", 0), (". ", 1)):
                cut = text.rfind(mark, at, stop)
                if cut > at + size // 2:
                    stop = cut + keep
                    break
        if piece := text[at:stop].strip():
            out.append(piece)
        at = max(stop - overlap, at + 1)
    return out


def chunk_text(df: DataFrame, text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """df's rows once for each chunk, with chunk_index and chunk. The cut depends on the last one, hence a vectorised UDF."""

    @F.pandas_udf("array<string>")
    def cut(s):
        return s.map(lambda t: chunks_of(t or "", size, overlap))

    return df.select("*", F.posexplode(cut(F.col(text_col))).alias("chunk_index", "chunk"))


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """A deterministic unit vector of a text's words; zero for a text without any."""
    v = np.zeros(dim)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(df: DataFrame, text_col: str = "text", embedder=None, dim: int = 64, batch: int = 100, out: str = "vector") -> DataFrame:
    """df with a vector of each text. embedder: list of texts -> list of vectors, called with at most `batch`; blank texts get zeros."""
    ship(df.sparkSession)
    call = embedder or (lambda texts: [hash_embedding(t, dim) for t in texts])
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            todo = [i for i, t in enumerate(texts) if t.strip()]
            vectors = [[0.0] * dim for _ in texts]
            for lo in range(0, len(todo), batch):
                part = todo[lo : lo + batch]
                for i, v in zip(part, call([texts[i] for i in part])):
                    vectors[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, schema)


def rag_context(hits: DataFrame, text_col: str, top: int = 3) -> DataFrame:
    """One row, `context`: the texts of the best `top` hits, parted by rules."""
    best = hits.orderBy(F.desc("score"), "id").limit(top)
    return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", F.col(text_col).alias("t")))), lambda z: z["t"]), "\n\n---\n\n").alias("context"))
