import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointsmith.llm import bpe, components, decontaminate, line_dedup, minhash, pii, quality, quality_rules, secrets, token_counts, toxicity
from pointsmith.llm import queries as q
from tests.llm import brute
from tests.oracle import connection, same

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LINE = "This Line is shared by many documents"
TEXTS = [
    prose(80, 1),
    prose(80, 1),
    prose(80, 1).replace(" ", " x ", 1),
    f"{LINE}\n{prose(60, 2)}\n  {LINE.upper()}\t",
    f"{prose(9, 3)}\n{LINE.lower()}",
    f"{LINE}\nÉ{LINE}",
    f"é{LINE}\n{LINE}\n{LINE}",
    None,
    "",
    " \n\t\n",
    "mail a@b.c_d@e.fg or +1 (918) 555-3922, 10.0.0.255 256.1.1.1 4111 1111 1111 1111",
    'password: "hunter2x" api_KEY=zzzzzz token = "' + "ab" * 20 + '" AKIA' + "A1" * 10 + " K=ſecret=abcdefg",
    "# * a | b <c> $5 & 100% ### the the the the the the",
    prose(30000, 5),
    "x" * 70000,
    "0" * 40000 + "-",
    "日本語🙂 mixed ▁text  with   spaces\n\n\n  'll we've 'tis end ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", -1, "clash", 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept string, score double").repartition(3)


def got(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def full():
    return [(i, t or "") for i, t in enumerate(TEXTS)]


def test_line_dedup(docs):
    out = got(line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs)))
    for i, (text, n, gone) in brute.line_dedup(list(enumerate(TEXTS))).items():
        assert ((out[i]["text"] or ""), out[i]["__n_lines"], out[i]["__n_dropped"]) == (text, n, gone)
        assert out[i]["kept"] == "clash"


def test_line_dedup_heavy_key_and_repeated_rows(spark):
    rows = [(i, f"{LINE}\nown line number {i} of this document\n{LINE}") for i in range(3000)] + [(7, f"{LINE}\nown line number 7 of this document\n{LINE}"), (None, LINE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = line_dedup.apply_bitmaps(df, line_dedup.line_dedup(df))
    counts = {tuple(r) for r in out.select("doc_id", "__n_dropped").collect()}
    assert counts == {(i, 0 if i == 2999 else 2) for i in range(3000)} | {(None, 0)} and out.count() == 3002
    plan = line_dedup.dropped_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan


def test_pii(docs):
    for i, row in got(pii.find_pii(docs)).items():
        assert [(x["kind"], x["s"], x["e"]) for x in row["base"]] == brute.pii(TEXTS[i] or "")


def test_pii_finds_unseen_in_context(spark):
    rows = [(i, f"some words then contact +1 (555) 555-{1000 + i} and more") for i in range(40)] + [(99, "some words then contact 5550-1234-99 and more"), (100, "some words and year 12345678 here")]
    out = got(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(x["s"], x["e"]) for x in out[99]["found"]] == [(24, 36)] and out[100]["found"] == []


def test_quality_counts(docs):
    for i, row in got(quality_rules.quality_rules(docs).drop("distance")).items():
        want = brute.quality_counts(TEXTS[i] or "")
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (row["base_failed"] and row["kept"])


def test_quality_rules_reject_outliers(spark):
    rows = [(i, prose(100 + i % 50, i), "en", "a") for i in range(400)] + [(1000 + i, " ".join(w + "###" for w in prose(100, i).split()), "en", "a") for i in range(20)]
    out = got(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert all(out[i]["kept"] for i in range(400)) and not any(out[1000 + i]["kept"] for i in range(20))


SCHEMA = "doc_id long, text string, lang string, source string"


def test_quality_rules_reject_each_kind(spark):
    """Junk in one statistic alone: words' length, 12% symbols, repeated short lines, repeated windows."""

    def lines(seed):
        w = prose(104, seed).split()
        return "\n".join([" ".join(w[:30])] + [x for word in w[30:] for x in (word, "abcd", "efghi")])

    def windows(seed):
        w = prose(100, seed).split()
        return " ".join(w[:56] + w[56:78] * 2)

    def symbols(seed):
        text = prose(100, seed)
        return text + " " + "#" * round(0.13 * len(text.replace(" ", "")))

    junk = [lambda s: " ".join(w * 2 for w in prose(100, s).split()), symbols, lines, windows]
    rows = [(i, prose(100 + i % 50, i), "en", "a") for i in range(400)] + [(1000 * k + i, make(5000 + i), "en", "a") for k, make in enumerate(junk, 1) for i in range(8)]
    out = got(quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)))
    assert sum(out[i]["kept"] for i in range(400)) >= 396
    for k in range(1, 5):
        assert not any(out[1000 * k + i]["base_failed"] or out[1000 * k + i]["kept"] for i in range(8)), k


def test_quality_rules_follow_each_groups_spread(spark):
    """Two groups with one centre: what is far out in the narrow one is regular in the wide one."""
    r = random.Random(5)

    def text(length, n=100):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(max(1, round(r.gauss(length, 1))))) for _ in range(n))

    narrow = [(i, text(6), "en", "narrow") for i in range(200)] + [(1000 + i, text(8), "en", "narrow") for i in range(5)]
    wide = [(2000 + i, text(r.gauss(6, 1)), "en", "wide") for i in range(200)] + [(3000 + i, text(8), "en", "wide") for i in range(5)]
    out = got(quality_rules.quality_rules(spark.createDataFrame(narrow + wide, SCHEMA)))
    assert not any(out[1000 + i]["kept"] for i in range(5)) and all(out[3000 + i]["kept"] for i in range(5))


def test_chi_square():
    assert quality_rules.chi_square(0.95, 4) == pytest.approx(9.4877, abs=1e-3) and quality_rules.chi_square(0.5, 1) == pytest.approx(0.4549, abs=1e-3)


def near_fixture():
    base = prose(200, 77)
    rows = [(i, t) for i, t in full() if t is None or len(t) < 5000]
    for k in range(90):  # a group of near copies, each with other edits
        w = base.split()
        r = random.Random(k)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((1000 + k, " ".join(w)))
    shared = prose(60, 78)
    rows += [(2000 + k, prose(70, 500 + k) + " " + shared) for k in range(30)]  # a passage in common is no copy
    return rows


def test_near_duplicates(spark):
    rows = near_fixture()
    out = got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {i: r["class_id"] for i, r in out.items()} == brute.classes(rows)
    assert out[0]["n_copies"] == 2


def test_near_duplicates_large_buckets(spark, monkeypatch):
    """Blocks against blocks give what all pairs give."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    rows = near_fixture()[15:]
    out = got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {i: r["class_id"] for i, r in out.items()} == brute.classes(rows)


def test_alignment_is_the_longest_common_subsequence():
    r = random.Random(3)
    for k in range(200):
        a = prose(r.randint(1, 40), k).split()
        b = list(a)
        for _ in range(r.randint(0, 3)):
            b[r.randrange(len(b))] = r.choice(WORDS)
        a, b = " ".join(a), " ".join(b)
        x, y = minhash.shingles(pa.array([a, b]))
        s = minhash.similarity(x, y)
        want = brute.aligned(a, b)
        assert s == pytest.approx(want) if want >= 0.8 else s < 0.8


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3)] + [(200, x) for x in range(201, 240)]
    out = {r["node"]: r["class"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 240)}


ITEMS = [(1, prose(40, 1000)), (22, "one two three"), (3, None), (4, "..."), (5, prose(14, 1001)), (6, "One, TWO three")]


@pytest.mark.parametrize("bound", [1 << 26, 1])
def test_decontaminate(spark, bound):
    texts = [(0, "a " + prose(40, 1000)), (1, " ".join(prose(40, 1000).split()[5:19])), (2, "x one TWO; three y " * 3), (3, None), (4, ""), (5, prose(500, 9) + " " + prose(14, 1001).upper()), (6, " ".join(prose(40, 1000).split()[:12])), (2, "x one TWO; three y " * 3), (7, prose(20000, 4))]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, items int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.decontaminate(df, bench, max_broadcast_bytes=bound).collect()
    assert len(rows) == len(texts)
    want = {i: brute.contamination(t, ITEMS) for i, t in texts}
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[r["doc_id"]]
    assert decontaminate.decontaminate(df, bench.where("false"), max_broadcast_bytes=bound).where("contaminated").count() == 0


def test_secrets(docs):
    kinds = ("assign", "access", "hex", "literal")
    for i, row in got(secrets.scan_secrets(docs)).items():
        base = brute.secrets(TEXTS[i] or "")
        assert row["base_sha256"] == brute.sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base))
        assert set(f"{kinds[k]}:{s}:{e}" for s, k, e in base) <= set(row["spans"].split(","))


def test_secrets_follow_assignments():
    spans = lambda t: [t[s:e] for s, k, e in secrets.secret_spans(t)[1] if k == 3]
    assert spans('x = "q9X!kd82Lm#0pQz"\ndb_pwd = x') == ["q9X!kd82Lm#0pQz"]
    assert spans('credentials: "q9X!kd82Lm" + "0pQz77aV"') == ["q9X!kd82Lm", "0pQz77aV"]
    assert spans('title = "an ordinary sentence"\ncolour = "q9X!kd82Lm#0pQz"') == []
    assert spans('password = "aaaaaaaaaaaa') == []


def test_bpe(docs):
    library = brute.bpe()
    out = got(bpe.encode_digests(docs))
    ids = got(bpe.encode(docs, decoded_size=True))
    back = got(bpe.decode(bpe.encode(docs)))
    for i, t in full():
        want = library.encode_ordinary(t)
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(want), brute.sha(",".join(map(str, want))), brute.sha(t))
        assert ids[i]["ids"] == want and bytes(back[i]["bytes"]) == t.encode() and ids[i]["n_bytes"] == len(t.encode())


def test_bpe_any_word():
    library, r = brute.bpe(), random.Random(8)
    words = ["".join(r.choice("abtheinr éß日🙂'01 \n") for _ in range(r.randint(1, 30))) for _ in range(2000)]
    from pointsmith.llm.common import tokenizer_path
    import public_tokenizers

    own = bpe.Encoder(tokenizer_path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    assert [[i for e in x for i in e[1]] for x in own.block(words)] == [library.encode_ordinary(w) for w in words]


def test_replay_takes_lower_ranks_first():
    """A vocabulary in which a merge makes a pair of a lower rank than its own."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"abcabc": 258, b"ca": 259}
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    words = ["abc", "abcabc", "abcbc", "bcabca", "cabcab", "aabbccabc"]
    assert bpe.Replay(ranks).encode([w.encode() for w in words]) == [library.encode_ordinary(w) for w in words]


def test_bpe_encodes_recurring_words_once(monkeypatch):
    """A worker that can't keep all pre-tokens keeps those that come up again, in both forms, with the library's ids."""
    import public_tokenizers
    from pointsmith.llm.common import tokenizer_path

    library, r = brute.bpe(), random.Random(12)
    common = ["".join(r.choice("bcdfgéß日'01") for _ in range(r.randint(5, 12))) for _ in range(40)]
    blocks = [[" ".join([*common, *("".join(r.choice("kqvwxyzö") for _ in range(9)) for _ in range(100))])] for _ in range(30)]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 200_000)
    for shown in ((), (True,)):
        own = bpe.Encoder(tokenizer_path(bpe.VOCABULARY), public_tokenizers.PATTERN, *shown)
        asked = Counter()
        encode = own.replay.encode
        monkeypatch.setattr(own.replay, "encode", lambda words: asked.update(words) or encode(words))
        for texts in blocks:
            want = library.encode_ordinary(texts[0])
            entries = own.block(texts)[0]
            if shown:
                assert ",".join(e[0] for e in entries) == ",".join(map(str, want))
            else:
                assert [i for e in entries for i in e[1]] == want
            assert b"".join(e[2] for e in entries) == texts[0].encode()
        assert max(asked.values()) == 1 and len(own.known) + len(own.older) < len(asked) / 2


def test_token_counts(docs):
    library = brute.pieces()
    for i, row in got(token_counts.count_tokens(docs, frequent=64)).items():
        t = TEXTS[i] or ""
        n = len(library.encode(t))
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(t.encode()), n, n > 4096)


def labelled(spark, n=700):
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 5 == 0, i % 3 == 0
        w = prose(60, i).split()
        if toxic:
            for k, x in enumerate(("grumblefoot", "snarkwort", "vilegrub")):
                w.insert(7 * k + 3, x)
        text = " ".join(w)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("run, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_on_held_out_rows(spark, run, label):
    docs, labels = labelled(spark)
    out = run(docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, " ")], docs.schema)), labels)
    held = out.where("held_out").join(labels, "doc_id")
    right = held.where(F.col("predicted") == F.col(label)).count() / held.count()
    assert right >= 0.95 and held.count() > 50
    assert out.where("score < 0 or score > 1 or score is null").count() == 0 and out.count() == 703
    fold = out.select("doc_id", "held_out", (F.crc32(F.col("doc_id").cast("string")) % (5 if label == "toxic" else 3) == (0 if label == "toxic" else 1)).alias("want"))
    assert fold.where("held_out <> want").count() == 0


def test_toxicity_trains_on_whole_ordinary_texts(monkeypatch):
    given = []
    train = toxicity._dictionary
    monkeypatch.setattr(toxicity, "_dictionary", lambda samples, size: given.append(samples) or train(samples, size))
    texts = [prose(900, i) + " lastword" for i in range(40)] + [prose(40, 100 + i) + " vile nasty" for i in range(40)]
    toxicity.fit(pa.table({"text": texts, "label": [0] * 40 + [1] * 40}))
    assert sum(b"lastword" in x for x in given[0]) == 20


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_classifiers_without_labels(spark, docs, run):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(docs.select("doc_id", "text"), none).count() == len(TEXTS)


def test_blocked_votes_are_exact():
    r = np.random.default_rng(0)
    model = quality.Model(0.5)
    model.vectors = r.standard_normal((300, 16)).astype(np.float32)
    model.labels = (r.random(300) > 0.5).astype(np.float32)
    z = r.standard_normal((50, 16)).astype(np.float32)
    near = z @ model.vectors.T
    for i, s in enumerate(model.vote(z, 25, block=7)):
        top = np.sort(near[i])[-25:]
        own = [(near[i, j], model.labels[j]) for j in range(300) if near[i, j] >= top[0]]
        w = np.array([max(x, 0) ** 8 for x, _ in own])
        assert s == pytest.approx((w * [y for _, y in own]).sum() / w.sum(), rel=1e-4)


EMPTY = [
    lambda d, s: line_dedup.apply_bitmaps(d, line_dedup.line_dedup(d)),
    lambda d, s: pii.find_pii(d),
    lambda d, s: quality_rules.quality_rules(d),
    lambda d, s: minhash.near_duplicates(d),
    lambda d, s: token_counts.count_tokens(d),
    lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([], "item_id long, text string")),
    lambda d, s: secrets.scan_secrets(d),
    lambda d, s: bpe.encode(d),
]


@pytest.mark.parametrize("op", EMPTY)
def test_empty_tables(spark, docs, op):
    assert op(docs.where("false"), spark).count() == 0


@pytest.mark.parametrize("op", EMPTY[1:])
def test_null_ids_and_repeated_rows(spark, op):
    rows = [(None, "some text of no document", "en", "s"), (1, "a text", None, None), (1, "a text", None, None), (None, None, None, None)]
    assert op(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark).count() == 4


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_matches_oracle(spark, data, name):
    same(q.queries()[name](spark, data), connection(data), q.oracle_sql()[name])


def test_native_operators_run_no_python(spark, docs):
    for df in (line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs)), pii.find_pii(docs), quality_rules.quality_rules(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_scans_of_one_pass_do_not_shuffle(spark, docs):
    for df in (secrets.scan_secrets(docs), bpe.encode(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "").replace("REPARTITION_BY_NUM", "")


def test_pipeline_against_brute_force(spark, data):
    """Every stage's rows against plain versions on the same input; the classifier's own verdicts are taken as given."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = [f for _, f in cp.STAGES]
    table = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    good = stages[0](spark, docs, data).cache()
    verdicts = {r["doc_id"]: r["predicted"] for r in quality.quality(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    rows = [(i, t) for i, t in table(docs) if verdicts[i]]
    assert table(good) == rows
    lines = stages[1](spark, good, data).cache()
    rows = sorted((i, t) for i, (t, _, _) in brute.line_dedup(rows).items())
    assert table(lines) == rows and lines.columns == docs.columns
    first = stages[2](spark, lines, data).cache()
    short = [(i, t) for i, t in rows if len(t) < 3000]  # the plain table of long texts takes too long
    own = brute.classes(short)
    kept = {i for i, _ in table(first)}
    assert {i for i, c in own.items() if i == c} >= kept & set(own) and len(own) > 100
    assert {i for i, c in own.items() if i == c} == kept & set(own)
    clean = stages[3](spark, first, data).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in table(first) if not brute.contamination(t, items)[-1]]
    assert table(clean) == rows
    library = brute.bpe()
    final = got(stages[4](spark, clean, data))
    assert {i: r["ids"] for i, r in final.items()} == {i: library.encode_ordinary(t) for i, t in rows}


def test_pipeline_judges_rows_without_an_id(spark, data):
    """Different rows with no id or with one id all stay; copies, contaminated and bad ones go."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    texts = [(None, prose(80, 901)), (None, prose(80, 902)), (None, prose(80, 902)), (None, prose(80, 903)), (5, prose(80, 903)), (7, prose(80, 904)), (7, prose(80, 905))]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts + [(None, item)]], schema)
    order = lambda rows: sorted(rows, key=str)
    first = [(r["doc_id"], r["text"]) for r in cp.dedup_documents(spark, rows, data).collect()]
    want = [texts[k] for k in (0, 1, 4, 5, 6)]
    assert order(first) == order([*want, (None, item)])
    clean = [(r["doc_id"], r["text"]) for r in cp.drop_contaminated(spark, rows, data).collect()]
    assert order(clean) == order(texts)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bad = quality.quality(docs, spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 0").select("doc_id")
    nameless = docs.join(bad, "doc_id", "left_semi").limit(5).withColumn("doc_id", F.lit(None).cast("long")).select(*docs.columns)
    assert nameless.count() == 5
    assert cp.quality_filter(spark, docs.union(nameless), data).where("doc_id is null").count() == 0


def test_secrets_planted_cases():
    """Each syntax's literal is found; ordinary assignments, prose and comparisons are left alone."""
    key = "kJ8#mZ2$qW9xT4@vB"
    planted = [
        f'db_pwd = "{key}"', f"auth_key: {key}", f'{{"client_secret_key": "{key}"}}', f"passphrase => '{key}'", f"export DB_PWD={key}", f"pwd := `{key}`",
        f"<credentials>{key}</credentials>", f'credential = """{key}\n{key}"""', f"private_key: |\n  {key}\n  {key}\nnext: 1", f'pwd = a\na = "{key}"', f"pwd = $a\nb = 2\nexport a={key}",
        f'a = "{key}"\nb = a\naccess_key = b', 'credential = "kJ8#mZ2" + "$qW9!xx"', 'passphrase = "correct horse battery staple"', f'{"x" * 300}_pwd = "{key}"', f'pwd = "ab\\"{key}"',
    ]
    found = lambda t: [t[s:e] for s, k, e in secrets.secret_spans(t)[1] if k == 3]
    assert [t for t in planted if not found(t)] == []
    clean = ["colour = 'kJ8#mZ2$qW9!'", "password: must be at least eight characters long", "The key: understanding of everything", "if x == 'kJ8#mZ2$qW9!':", "see https://host/path?a=b", "pwd = getpass(prompt)", "salt = 'aaaaaaaaaaaa'", "", "==::=>"]
    assert [(t, found(t)) for t in clean if found(t)] == []


@pytest.mark.parametrize("text", ["foo_" * 50000 + "pwd = ", "a = b\n" * 30000, "".join(f"a{i} = a{i + 1}\n" for i in range(10000)), "k: |\n" + "  x\n" * 30000, 'k: "\n' * 30000, "<a >" * 20000, "k: '''\n" * 10000])
def test_secrets_take_time_in_proportion(text):
    import time

    began = time.process_time()
    secrets.secret_spans(text)
    assert time.process_time() - began < 5


def test_estimates_are_fixed_points_of_the_c_step(spark):
    """Brute force: the half of each group's rows nearest by the estimate gives the estimate again."""
    r = np.random.default_rng(9)
    n = quality_rules._N
    rows = []
    for g, size in (("a", 600), ("b", 60), ("c", 6)):
        mix = r.normal(size=(n, n)) * 0.05
        x = r.normal(size=(size, n)) @ mix + r.normal(size=n)
        x[: size // 5] += 3.0  # a fifth is far out and must not matter
        rows += [(g, "s", *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "g_lang string, g_source string, " + ", ".join(f"{c} double" for c in quality_rules._NAMES))
    pool = quality_rules.Pool(df)
    found = {e["g_lang"]: e for e in quality_rules.mcd(df).collect()}
    assert set(found) == {"a", "b", "c"}
    for g, e in found.items():
        x = np.array([v[2:] for v in rows if v[0] == g])
        m = np.array([e[f"m{i}"] for i in range(n)])
        low = np.zeros((n, n))
        for (i, j), x_ in zip(quality_rules._PAIRS, e["l"]):
            low[i, j] = x_
        inverse = np.zeros((n, n))
        for (i, j), x_ in zip(quality_rules._PAIRS, e["v"]):
            inverse[i, j] = x_
        assert np.allclose(low @ inverse, np.eye(n))
        d = (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0)
        half = x[d <= np.sort(d)[int(np.ceil(0.5 * len(d))) - 1]]
        share = len(x) / (len(x) + quality_rules.PRIOR)
        cov = share * np.cov(half.T, bias=True) + (1 - share) * np.diag(np.square(pool.unit))
        centre = share * half.mean(axis=0) + (1 - share) * np.array(pool.middle)
        assert np.allclose(centre, m, atol=0.02) and abs(np.linalg.slogdet(cov)[1] - e["logdet"]) < 0.05
        if g == "a":
            assert np.abs(m - np.median(x[120:], axis=0)).max() < 0.1


def test_pii_needs_more_than_seeds_by_chance(spark):
    """Function words before numbers are no pattern, nor are words that mostly stand without an instance."""
    rows = [(i, f"{prose(20, i)} of the +1 (555) 555-{1000 + i} of the {prose(3, i)} of the hill of the sea") for i in range(40)] + [(99, "some of the 12345678 here")]
    assert all(not r["found"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_pii_counts_few_uses_of_common_words(spark, monkeypatch):
    """Common words before numbers leave the graph by some texts' uses; what is found is the same for any share of texts."""
    common = " ".join(f"of the hill{k}" for k in range(10))
    rows = [(i, f"{prose(5, i)} {common}" + (f" of the +1 (555) 555-{1000 + i} end" if i < 60 else "")) for i in range(1500)]
    rows += [(2000 + i, f"{prose(5, i)} then contact +1 (555) 777-{1000 + i} and more") for i in range(40)] + [(9000, "then contact 5550-1234-99 and more"), (9001, "some of the 12345678 here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    counted, uses = [], pii._uses

    def watched(*args):
        out = uses(*args)
        counted.append(out.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(pii, "_uses", watched)
    by_id = lambda: {r["doc_id"]: [(x["s"], x["e"]) for x in r["found"]] for r in pii.find_pii(docs).collect()}
    found = by_id()
    assert 0 < sum(counted) < 1500
    assert found[9000] == [(13, 25)] and found[9001] == []
    for share in (1, 10**9):
        monkeypatch.setattr(pii, "FIRST_SHARE", share)
        assert by_id() == found
    docs.unpersist()


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_classifiers_on_odd_tables(spark, run):
    """Clashing columns, null ids, repeated rows, very long texts, an empty table."""
    docs, labels = labelled(spark, 120)
    odd = spark.createDataFrame([(None, "a b"), (5, "same"), (5, "same"), (900, prose(20000, 3))], docs.schema)
    both = docs.union(odd).withColumns({"score": F.lit("x"), "label": F.lit(3), "held_out": F.lit(None).cast("string"), "size": F.lit(1)})
    out = run(both, labels.withColumn("text", F.lit("other")))
    assert out.count() == 124 and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.where("doc_id is null and held_out").count() == 0
    assert out.where("doc_id = 5").select("score").distinct().count() <= 2
    assert run(docs.where("false"), labels).count() == 0


def test_quality_keeps_rows_whole(spark):
    docs, labels = labelled(spark, 120)
    wide = docs.withColumns({"n": F.col("doc_id") * 2, "score": F.lit("x")})
    model = quality.fit(quality.training_rows(docs, labels))
    want = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    kept = quality.keep_good(wide, model)
    assert kept.schema == wide.schema and {r["doc_id"] for r in kept.collect()} == want and all(r["n"] == 2 * r["doc_id"] for r in kept.collect())


def test_sample_is_bounded_in_bytes(spark):
    from pointsmith.llm.labelled import sample

    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)] + [(500, None), (501, "y" * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, 1), (501, 1)], "doc_id long, quality int")
    got_ = sample(docs, labels, "quality", {0: 50, 1: 50}, 3, 1, max_bytes=3000)
    assert 1 <= got_.num_rows <= 30 and sample(docs, labels, "quality", {0: 10, 1: 10}, 3, 1).num_rows == 20
    assert max(len(t) for t in got_.column("text").to_pylist()) == 100


def test_keep_clean_beyond_the_broadcast_bound(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(None, prose(40, 1000)), (1, prose(90, 12)), (1, prose(40, 1000)), (2, None), (None, prose(50, 13))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, items string")
    for bound in (1 << 26, 1):
        kept = decontaminate.keep_clean(df, bench, max_broadcast_bytes=bound)
        assert kept.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((rows[k] for k in (1, 3, 4)), key=str)


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    from pointsmith.llm import textblocks as tb

    texts = pa.array([prose(3000, 1), "z" * 5000 + " " + prose(50, 2), None, ""])
    block = tb.Block(texts)
    starts, ends, _, _ = tb.words(block, tb.WHITE)
    whole = tb.word_hashes(block.data, starts, ends)
    monkeypatch.setattr(tb, "CHUNK_BYTES", 64)
    assert (tb.word_hashes(block.data, starts, ends) == whole).all()


def test_sketches_of_long_texts_in_parts(monkeypatch):
    own = minhash.shingles(pa.array([prose(3000, 4)]))[0]
    whole = minhash.sketch(own)
    monkeypatch.setattr(minhash, "CELLS", 1)
    assert (minhash.sketch(own) == whole).all()


def test_different_texts_of_one_id_are_told_apart(spark):
    rows = [(1, prose(60, 1)), (1, prose(60, 2)), (2, prose(60, 2)), (None, prose(60, 2)), (None, None), (3, "")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["class_id"], r["n_copies"]) for r in out.collect()), key=str) == sorted([(1, 1, 1), (1, 1, 3), (2, 1, 3), (None, 1, 3), (None, 3, 2), (3, 3, 2)], key=str)
