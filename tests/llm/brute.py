"""Plain single-process versions of the corpus operators, straight from their contracts."""

import base64
import hashlib
import re
from collections import Counter
from functools import lru_cache

WHITE = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def line_dedup(docs):
    """{doc_id: kept text}, and the number of lines of each before."""
    key = lambda x: x.strip(WHITE).translate(ASCII_LOWER)
    owners = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                owners.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(owners.get(key(x), ())) < 3 or max(owners[key(x)]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def digits(x):
    return re.sub("[^0-9]", "", x)


def pii(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def quality_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    grams = Counter(tuple(w[j : j + 3]) for j in range(n - 2))
    hit = {p for j in range(n - 2) if grams[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if x.strip(WHITE):
            dup += x in seen
            seen.add(x)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


@lru_cache(5000)
def shingles(text):
    w = text.translate(ASCII_LOWER).split()  # texts of the tests hold ASCII white space only
    grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)] or ([tuple(w)] if w else [])
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def aligned(a, b):
    """Longest common subsequence of labelled shingles over the union, by the plain table."""
    a, b = shingles(a), shingles(b)
    if not set(a) & set(b):
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def classes(docs):
    """{doc_id: smallest id of its class}."""
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, t) in enumerate(docs):
        for j, u in docs[:n]:
            if find(i) != find(j) and (t == u or aligned(t or "", u or "") >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in docs}


def contamination(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    w, hit, found = find(text), set(), set()
    for i, t in items:
        own = find(t)
        k = min(13, len(own))
        for j in range(len(own) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == own[j : j + k]:
                    hit |= set(range(p, p + k))
                    found.add(str(i))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)


def secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def bpe():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces():
    import public_tokenizers as P
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
