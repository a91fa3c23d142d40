"""Token counts by a map-side lookup in two tiers; no pre-token is shuffled.

The piece vocabulary has no piece in which a space follows another character, so no merge crosses the place before a
run of spaces: a text's count is the sum over its pre-tokens (a run of spaces and what follows it up to the next).
First tier: a table of the corpus's most frequent pre-tokens and their lengths in tokens, found by a frequent-items
sketch over all texts (one sketch per task leaves the map side), bounded by entries and letters, and broadcast.
Second tier: each worker keeps what it has encoded, within a bound, and hands misses to the library in one batch.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts are never cut, however long; repeated rows
each get their own result; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import id_text, map_arrow, tokenizer_path, worker_state

VOCABULARY = "piece_bpe_32k.model"
FREQUENT = 8192
MAX_LETTERS = 64
MERGERS = 64
#: What a worker keeps of what it has encoded, in bytes (about 120 an entry and its letters).
CACHE_BYTES = 48 << 20
LIMIT = 4096
#: Fixed value: the character that stands for a space in the pieces.
SPACE_MARK = "▁"


class Pieces:
    """The library's processor, and the lengths that a worker knows."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else tokenizer_path(vocabulary))
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size()))):
            raise ValueError("a piece holds a space after another character: counts of pre-tokens would not add up")
        self.known: dict[str, int] = {}
        self.weight = 0


def _pieces(vocabulary: str) -> Pieces:
    return worker_state(("pieces", vocabulary), lambda: Pieces(vocabulary))


def lengths(sp, pretokens: list[str]) -> list[int]:
    """Tokens of each pre-token. The library puts a space before each text, so one is taken off first."""
    one = len(sp.encode("a ", num_threads=1)) - len(sp.encode("a", num_threads=1))
    return [len(ids) if p != " " else one for p, ids in zip(pretokens, sp.encode([p[1:] for p in pretokens], num_threads=1))]


_PRETOKENS = re.compile(" +[^ ]*").findall


def pretokens(text: str) -> list[str]:
    return _PRETOKENS(" " + text.replace(SPACE_MARK, " ")) if text else []


def frequent_table(docs: DataFrame, sp, frequent: int) -> dict[str, int]:
    """The most frequent pre-tokens with one space before them -> tokens; at most `frequent` of at most MAX_LETTERS."""
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).where(F.char_length("w").between(1, MAX_LETTERS))
    # One sketch for each of MERGERS groups of tasks, then a plain sum over their items: no task reads all sketches.
    some = words.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("m")).agg(F.expr(f"approx_top_k(w, {frequent}, {2 * frequent})").alias("top"))
    top = some.select(F.inline("top")).groupBy("item").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "item").limit(frequent).collect()
    found = [" " + x["item"] for x in top if SPACE_MARK not in x["item"]]
    return dict(zip(found, lengths(sp, found))) if found else {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    rows = id_text(docs, id_col, text_col)
    table = rows.sparkSession.sparkContext.broadcast(frequent_table(rows, Pieces(vocabulary).sp, frequent))

    def run(batches):
        own_pieces = _pieces(vocabulary)
        sp, known = own_pieces.sp, own_pieces.known
        first = table.value
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                column = batch.column(1).slice(lo, hi - lo)
                found = [pretokens(t or "") for t in column.to_pylist()]
                if own_pieces.weight > CACHE_BYTES:
                    known.clear()
                    own_pieces.weight = 0
                new = list({w for own in found for w in own if w not in first and w not in known})
                long = {}
                for w, n in zip(new, lengths(sp, new) if new else []):
                    if len(w) <= MAX_LETTERS:
                        known[w] = n
                        own_pieces.weight += 120 + 2 * len(w)
                    else:
                        long[w] = n
                both = {**known, **first, **long} if long else None
                counts = []
                for own in found:
                    if both is not None:
                        counts.append(sum(map(both.__getitem__, own)))
                    else:
                        counts.append(sum([first[w] if w in first else known[w] for w in own]))
                sizes = pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
