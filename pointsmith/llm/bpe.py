"""Byte-level BPE by corpus-level merge replay, and its inverse.

A block of texts is split into pre-tokens by the pattern; the distinct ones that are neither tokens themselves nor
known to the worker form a small corpus. An inverted index maps the token that a pair would make to the positions of
that pair; the merges are applied to the whole corpus in rank order, each updating only the neighbours it touches. If
a merge makes a pair of a lower rank than its own, that one comes first, so each word gets the ids that merging it
alone, lowest rank and leftmost first, would give. What a worker knows is bounded in bytes.

The vocabulary's path is a parameter and read on the worker. No shuffle; every text is encoded whole.

Defined results: null and empty texts have no tokens; repeated rows each get their own result; texts are never cut;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textblocks as tb
from .common import id_text, map_arrow, tokenizer_path, worker_state

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: What a worker keeps of what it has encoded, in bytes as estimated by _weight; longer pre-tokens are not kept.
CACHE_BYTES = 112 << 20
CACHE_WORD_LETTERS = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Replay:
    """The merges of one vocabulary, applied to sets of words at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: What a token makes with the one after it, and with the one before it: each way to cut a token into two.
        none: dict[int, int] = {}
        self.with_next = [none] * (max(self.bytes_of) + 1)
        self.with_last = self.with_next.copy()
        for t, r in ranks.items():
            for k in range(1, len(t)):
                if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None:
                    for made, one, other in ((self.with_next, x, y), (self.with_last, y, x)):
                        if made[one] is none:
                            made[one] = {}
                        made[one][other] = r
        single = self.single.tolist()
        self.made_of_bytes = np.array([[self.with_next[x].get(y, -1) for y in single] for x in single])

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out = [[self.ranks[w]] if w in self.ranks else [] for w in words]
        rest = [k for k, ids in enumerate(out) if not ids and words[k]]
        if rest:
            lengths = np.array([len(words[k]) for k in rest])
            ids, bounds = self._replay(np.frombuffer(b"".join([words[k] for k in rest]), np.uint8), np.cumsum(lengths) - lengths)
            for k, lo, hi in zip(rest, bounds, bounds[1:]):
                out[k] = ids[lo:hi]
        return out

    def _replay(self, data: np.ndarray, firsts: np.ndarray) -> tuple[list[int], list[int]]:
        """The ids of words that stand one after another in data, and where each word's ids begin (one more than words)."""
        size = len(data)
        lasts = np.append(firsts[1:], size) - 1
        link = np.arange(-1, size + 1)
        before, after = link[:size].copy(), link[2:].copy()
        before[firsts] = after[lasts] = -1
        pairs = np.full(size, -1)
        pairs[:-1] = self.made_of_bytes[data[:-1], data[1:]]
        pairs[lasts] = -1
        # Arrays, not lists: places are taken in no order, and four bytes each stay near the processor.
        # makes: what a place's token and the next one make; -1 where nothing, or a merge has taken the place.
        token, before, after, makes = (array("i", x.astype(np.int32).tobytes()) for x in (self.single[data], before, after, pairs))
        found = np.flatnonzero(pairs >= 0)
        found = found[np.argsort(pairs[found], kind="stable")]
        made, cuts = np.unique(pairs[found], return_index=True)
        in_order: list[int] = found.tolist()
        where: list[list[int] | None] = [None] * len(self.with_next)
        for r, lo, hi in zip(made.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(in_order)]):
            where[r] = in_order[lo:hi]
        r = -1
        while (r := r + 1) < len(where):
            if (places := where[r]) is None:
                continue
            where[r] = None
            places.sort()
            with_next, with_last = self.with_next[r], self.with_last[r]
            for k, i in enumerate(places):
                if makes[i] != r:
                    continue  # a merge has taken one of the two
                j = after[i]
                after[i] = n = after[j]
                token[i], token[j], makes[i], makes[j] = r, -1, -1, -1
                lowest = r
                if n >= 0:
                    before[n] = i
                    if (s := with_next.get(token[n])) is not None:
                        makes[i] = s
                        if (known := where[s]) is None:
                            where[s] = [i]
                        else:
                            known.append(i)
                        if s < r:
                            lowest = s
                if (p := before[i]) >= 0:
                    if (s := with_last.get(token[p])) is not None:
                        makes[p] = s
                        if (known := where[s]) is None:
                            where[s] = [p]
                        else:
                            known.append(p)
                        if s < lowest:
                            lowest = s
                    else:
                        makes[p] = -1
                if lowest < r:
                    where[r] = (where[r] or []) + places[k + 1 :]
                    r = lowest - 1
                    break
        tokens = np.frombuffer(token, np.int32)
        left = tokens >= 0
        return tokens[left].tolist(), [*(np.cumsum(left) - left)[firsts].tolist(), int(left.sum())]


#: What is kept of a pre-token: its ids joined by commas (or "" in an encoder without them), its ids (or none), its bytes.
Entry = tuple[str, tuple[int, ...], bytes]


class Encoder:
    """A worker's vocabulary and what it has encoded so far.

    shown: the ids are kept as text, else as numbers. What is known is kept in two halves: when the newer one is full,
    it becomes the older one, and of that before only the pre-tokens stay that have come up again since.
    """

    def __init__(self, path: str, pattern: str, shown: bool = False):
        self.replay = Replay(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.shown = shown
        self.forms = [str(i) if shown else i for i in range(len(self.replay.with_next))]
        self.known: dict[str, Entry] = {}
        self.older: dict[str, Entry] = {}
        self.weight = 0

    def _entry(self, ids: list[int]) -> Entry:
        forms, bytes_of = self.forms, self.replay.bytes_of
        own = [forms[i] for i in ids]
        return ",".join(own) if self.shown else "", () if self.shown else tuple(own), b"".join([bytes_of[i] for i in ids])

    def _weight(self, word: str, entry: Entry) -> int:
        return 330 + 3 * len(word) + len(entry[0]) + 8 * len(entry[1])

    def block(self, texts: list[str]) -> list[list[Entry]]:
        """The entries of each text's pre-tokens."""
        found = [self.find(t) for t in texts]
        if self.weight > CACHE_BYTES // 2:
            self.older, self.known, self.weight = self.known, {}, 0
        known, older = self.known, self.older
        new, long = [], {}
        for w in set().union(*found).difference(known):
            if (e := older.get(w)) is None:
                new.append(w)
            else:
                known[w] = e
                self.weight += self._weight(w, e)
        for w, ids in zip(new, self.replay.encode([w.encode() for w in new])):
            e = self._entry(ids)
            if len(w) <= CACHE_WORD_LETTERS:
                known[w] = e
                self.weight += self._weight(w, e)
            else:
                long[w] = e
        if not long:
            return [[known[w] for w in words] for words in found]
        return [[known[w] if w in known else long[w] for w in words] for words in found]


def _encoder(vocabulary: str, pattern: str | None, shown: bool = False) -> Encoder:
    def build():
        import public_tokenizers

        return Encoder(vocabulary if "/" in vocabulary else tokenizer_path(vocabulary), pattern or public_tokenizers.PATTERN, shown)

    return worker_state(("bpe", vocabulary, pattern, shown), build)


def _run(vocabulary: str, pattern: str | None, row, schema: pa.Schema, shown: bool = False):
    def run(batches):
        encoder = _encoder(vocabulary, pattern, shown)
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                out = [row(x) for x in encoder.block(texts)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(zip(*out), schema))], ["doc_id", *schema.names])

    return run


def _digest(entries: list) -> tuple:
    shown = ",".join([e[0] for e in entries])
    decoded = hashlib.sha256(b"".join([e[2] for e in entries])).hexdigest()
    return (shown.count(",") + 1 if shown else 0), hashlib.sha256(shown.encode()).hexdigest(), decoded


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None, decoded_size: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): the whole text's ids. vocabulary: a public tokenizer's file name, or a path on the workers.

    decoded_size adds n_bytes, the bytes that the ids decode to.
    """
    rows = id_text(docs, id_col, text_col)
    schema = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), *([("n_bytes", pa.int64())] if decoded_size else [])])

    def row(entries):
        ids = [i for e in entries for i in e[1]]
        return (len(ids), ids, *([sum([len(e[2]) for e in entries])] if decoded_size else []))

    return map_arrow(rows, _run(vocabulary, pattern, row, schema), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>" + ", n_bytes long" * decoded_size)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode on the worker and return digests of both."""
    rows = id_text(docs, id_col, text_col)
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return map_arrow(rows, _run(vocabulary, pattern, _digest, schema, shown=True), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, bytes): the bytes of each row's ids; null ids give no bytes."""
    rows = encoded.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids")

    def run(batches):
        bytes_of = _encoder(vocabulary, None).replay.bytes_of
        for batch in batches:
            out = [b"".join(map(bytes_of.__getitem__, ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")
