r"""Personal data: base patterns, and contextual extraction bootstrapped from them; only DataFrame functions.

Base entities (e-mail, IP, card, phone) are the seeds. An instance is a run of tokens with four digits or more in all, or
a token with an `@`; its lexical patterns are the two words before it, the word before with the word after, and all
three. Patterns and instances form a graph. They are scored in turns: an instance by the best of its patterns (seeds: 1),
a pattern by the share of its instances' scores among its uses. Uses where its words stand without an instance between
them count against it in full, found by a pass over all texts; instances that nothing speaks for yet count a quarter, so
a pattern may introduce as many of them as known ones. What is found counts as a seed in the next turn. Turns go on
until no score moves. Trusted patterns have several different seeds or found instances and a high score in each of two
halves of the texts, dealt by a hash, so that each half is held out from the other. What else they introduce is given as
kind `context`, unseen identifiers. Base spans stay; the found ones are added.

The texts are read once, and once more for the uses of patterns that may be trusted, if there are any; spans and
instances (positions, pattern and instance hashes, no text) are written to the shared folder. Edges are aggregated
before they are joined; patterns of fewer than MIN_INSTANCES different instances can't be trusted and leave the graph
first. So do those that can't be trusted by their uses in one of FIRST_SHARE texts alone: a score is at most the
instances' share among instances and uses, and more texts only add uses. All uses are counted of the rest, which have
not many times as many as they have instances; no score of theirs depends on the patterns that left. Regular expressions use possessive quantifiers and start only where a match can, so they run in linear time on
very long texts and do not recurse; context words are looked for in the CONTEXT_LETTERS letters beside an instance.

Defined results: null and empty texts have no spans; failing base matches are dropped without retries; a found
sequence that meets a base span is not given; repeated rows each get their own result, and count as one in the graph;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from pointsmith.session import cut

from .exprs import let

#: The base patterns (leftmost, non-overlapping), written so that they match the same spans in linear time.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Whole chains of 16 to 19 digits only: shorter and longer chains fail as a whole.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"

#: An instance: a token with an at sign, or tokens with four digits or more in all.
INSTANCE = r"(?<!\S)(?:[^\s@]++@[^\s@]++(?!@)|[^\s0-9]*+(?:[0-9][^\s0-9]*+(?:\x20(?=[(+]?[0-9])[(+]?+)?+){4,}+)"
CONTEXT_LETTERS = 96
#: Different instances of a trusted pattern in each half of the texts, and its least score there.
MIN_INSTANCES = 3
MIN_SCORE = 0.8
#: How much an instance that nothing speaks for yet counts against its patterns.
UNKNOWN = 0.25
MAX_TURNS = 20
#: Uses are counted in one of so many texts first.
FIRST_SHARE = 64
SETTLED = 1e-3
#: Patterns whose uses are counted with one broadcast of their words; beyond it they are joined.
MAX_WORDS = 50_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    def doubled(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 1, F.when(n > 4, n * 2 - 9).otherwise(n * 2)).otherwise(n)

    digits = F.split(F.reverse(_digits(match)), "")
    return F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        # At most 255: with leading zeros gone, at most three digits.
        return F.forall(F.split(match, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.char_length(q) <= 3) & (F.lpad(q, 3, "0") <= "255")))
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.char_length(_digits(match)).between(8, 15)
    return F.lit(True)


def _positions(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<s,e,m>>: where each match lies, in code points, from the pieces between them."""

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    empty = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")

    def walk(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        both = F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("piece"), m.alias("m")))
        return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"]))

    return let(matches, walk)


def base_spans(text: Column) -> Column:
    """array<struct<kind,s,e>>: the base spans by kind as listed, then start."""
    quick = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    none = F.expr("cast(array() as array<string>)")
    parts = []
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if kind in quick:
            matches = F.when(quick[kind], matches).otherwise(none)
        parts.append(_valid_spans(kind, _positions(text, matches, pattern)))
    return F.concat(*parts)


def _valid_spans(kind: str, found: Column) -> Column:
    valid = F.filter(found, lambda x: _valid(kind, x["m"]))
    return F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def _contexts(text: Column) -> Column:
    """array<struct<s,e,l,m,r>>: where each instance lies, with the text beside it up to the next one."""

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["n"]
        end = start + F.char_length(x["m"])
        body = F.regexp_replace(x["m"], r"[^\p{L}\p{N})]++$", "")
        found = F.struct(start.alias("s"), (start + F.char_length(body)).alias("e"), x["l"].alias("l"), body.alias("m"), F.concat(F.substr(x["m"], F.char_length(body) + 1), x["r"]).alias("r"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(found)).alias("out"))

    empty = F.expr("cast(array() as array<struct<s:int,e:int,l:string,m:string,r:string>>)")

    def walk(found: Column) -> Column:
        def all_pieces(pieces: Column) -> Column:
            left = F.transform(F.slice(pieces, F.lit(1), F.size(found)), lambda p: F.struct(F.char_length(p).alias("n"), F.right(p, F.lit(CONTEXT_LETTERS)).alias("l")))
            right = F.transform(F.slice(pieces, F.lit(2), F.size(found)), lambda p: F.left(p, F.lit(CONTEXT_LETTERS)))
            both = F.zip_with(F.zip_with(left, found, lambda p, m: F.struct(p["n"].alias("n"), p["l"].alias("l"), m.alias("m"))), right, lambda x, r: F.struct(x["n"].alias("n"), x["l"].alias("l"), x["m"].alias("m"), r.alias("r")))
            return F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])

        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, INSTANCE, -1), all_pieces))

    return let(F.regexp_extract_all(text, F.lit(INSTANCE), F.lit(0)), walk)


def _plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "[0-9]", "9"))


def _pattern(a: Column, b: Column, c: Column) -> Column:
    """The hash of a pattern: two words before, and one after; empty where it has none."""
    return F.xxhash64(a, b, c)


def _three(a: Column, b: Column, c: Column) -> Column:
    """The patterns of two words before and one after: those of two words at least."""
    none = F.lit("")
    found = F.array(F.when((a != "") & (b != ""), _pattern(a, b, none)), F.when((b != "") & (c != ""), _pattern(none, b, c)), F.when((a != "") & (b != "") & (c != ""), _pattern(a, b, c)))
    return F.filter(found, lambda x: x.isNotNull())


def instances(text: Column) -> Column:
    """array<struct<s,e,patterns,body>>: the instances, by hashes of their patterns and of themselves."""
    before = r"(?:(?<!\S)(\S++)\s++)?+(?<!\S)(\S++)\s++$"

    def parts(x: Column) -> Column:
        word = lambda side, pattern, k: _plain(F.regexp_extract(side, pattern, k))
        patterns = _three(word(x["l"], before, 1), word(x["l"], before, 2), word(x["r"], r"^\S*+\s++(\S++)", 1))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), patterns.alias("patterns"), F.xxhash64(x["m"]).alias("body"))

    return F.transform(_contexts(text), parts)


def _meets(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, half, base, found) with the base spans and instances of every text, written once."""
    full = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    half = F.pmod(F.xxhash64(full), F.lit(2)).cast("int")
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), half.alias("half"), base_spans(full).alias("base"), instances(full).alias("found"))
    return cut(docs.sparkSession, read)


def _uses(docs: DataFrame, patterns: DataFrame, text_col: str, share: int = 1) -> DataFrame:
    """(pattern, half, uses): how often the words of each pattern stand together, with an instance between or not.

    share: looks at one of so many texts, of both halves. Words are looked at as rows only where a pattern's hash can be
    theirs; counts leave the map side.
    """
    full = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    half = F.pmod(F.xxhash64(full), F.lit(2)).cast("int")
    if share > 1:
        docs = docs.where(F.pmod(F.xxhash64(full), F.lit(2 * share)) < 2)
    words = F.filter(F.split(full, r"\s+"), lambda w: w != "")

    def places(w: Column) -> Column:
        at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        # Before an instance the words' use is the instance's own.
        return F.flatten(F.transform(w, lambda x, i: F.when(F.rlike(at(i + 1), F.lit("@|(?:9[^9]*+){4}")), F.array().cast("array<bigint>")).otherwise(_three(at(i - 1), x, at(i + 1)))))

    shown = docs.select(half.alias("half"), F.explode(let(F.transform(words, _plain), places)).alias("pattern"))
    few = patterns.count() <= MAX_WORDS
    return shown.join(F.broadcast(patterns) if few else patterns, "pattern").groupBy("pattern", "half").agg(F.count(F.lit(1)).alias("uses"))


def trusted_patterns(extracted: DataFrame, docs: DataFrame, text_col: str = "text", min_instances: int = MIN_INSTANCES, min_score: float = MIN_SCORE, max_turns: int = MAX_TURNS) -> DataFrame:
    """(pattern, score): the lexical patterns whose instances are personal data."""
    spark = extracted.sparkSession
    one = extracted.select("half", "base", F.explode("found").alias("x")).select("half", _meets(F.col("x"), F.col("base")).cast("int").alias("seed"), "x.body", F.explode("x.patterns").alias("pattern"))
    # Edges of the graph, pre-aggregated: an instance that repeats with a pattern counts once in each half.
    edges = one.groupBy("pattern", "half", "body").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    edges = cut(spark, edges)
    # Patterns with too few different instances in a half can't be trusted, so they leave the graph first.
    able = edges.groupBy("pattern", "half").agg(F.count(F.lit(1)).alias("bodies")).where(F.col("bodies") >= min_instances).groupBy("pattern").agg(F.count(F.lit(1)).alias("halves")).where("halves = 2").select("pattern")
    able = cut(spark, able)
    nothing = able.select("pattern", F.lit(0.0).alias("score")).where("false")
    if able.isEmpty():
        return nothing
    edges = cut(spark, edges.join(able, "pattern", "left_semi"))
    # Where the words stand with no instance between them is against the pattern, as are instances that score low.
    between = edges.groupBy("pattern", "half").agg(F.sum("n").alias("n"))
    # Common words show in a few texts that they can't be trusted: were all instances known, these uses were too many.
    seen = between.join(_uses(docs, able, text_col, FIRST_SHARE), ["pattern", "half"], "left")
    able = cut(spark, seen.groupBy("pattern").agg(F.min(F.col("n") / (F.col("n") + F.coalesce("uses", F.lit(0)))).alias("most")).where(F.col("most") >= min_score).select("pattern"))
    if able.isEmpty():
        return nothing
    edges = edges.join(able, "pattern", "left_semi")
    between = between.join(able, "pattern", "left_semi")
    uses = cut(spark, between.join(_uses(docs, able, text_col), ["pattern", "half"], "left").select("pattern", "half", F.coalesce("uses", F.lit(0)).alias("free")))
    scores = cut(spark, edges.groupBy("pattern").agg(F.lit(0.0).alias("score")))
    for _ in range(max_turns):
        held = edges.join(scores, "pattern")
        worth = held.groupBy("body").agg(F.max(F.greatest(F.col("seed").cast("double"), F.when(F.col("score") >= min_score, F.col("score")).otherwise(0.0))).alias("worth"))
        sums = edges.join(worth, "body").groupBy("pattern", "half").agg(F.sum("worth").alias("good"), F.count(F.lit(1)).alias("bodies"), F.sum(F.col("n") * F.col("worth")).alias("hits"), F.sum("n").alias("n"))
        by_half = sums.join(uses, ["pattern", "half"]).select("pattern", F.when(F.col("good") >= min_instances, F.col("hits") / (F.col("hits") + UNKNOWN * (F.col("n") - F.col("hits")) + F.col("free"))).otherwise(0.0).alias("score"))
        # The lesser of both halves: what one half suggests, the other has to bear out.
        new = cut(spark, by_half.groupBy("pattern").agg(F.min("score").alias("score")))
        moved = new.join(scores.withColumnRenamed("score", "old"), "pattern").agg(F.max(F.abs(F.col("score") - F.col("old"))).alias("m")).first()["m"]
        scores = new
        if moved is None or moved < SETTLED:
            break
    return scores.where(F.col("score") >= min_score)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_instances: int = MIN_INSTANCES, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, base, found): base spans, and the spans that trusted patterns add; each array<struct<kind,s,e>>."""
    spark = docs.sparkSession
    extracted = extract(docs, id_col, text_col)
    patterns = cut(spark, trusted_patterns(extracted, docs, text_col, min_instances, min_score))
    nothing = F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")
    if patterns.isEmpty():
        return extracted.select("doc_id", "base", nothing.alias("found"))
    unseen = extracted.select("row", F.explode(F.filter("found", lambda x: ~_meets(x, F.col("base")))).alias("x")).select("row", "x.s", "x.e", F.explode("x.patterns").alias("pattern"))
    added = unseen.join(patterns, "pattern", "left_semi").groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.lit(CONTEXT).alias("kind"), "s", "e"))).alias("more"))
    return extracted.join(added, "row", "left").select("doc_id", "base", F.coalesce("more", nothing).alias("found"))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
