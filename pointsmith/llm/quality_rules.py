"""Quality rules as robust multivariate outliers; only DataFrame functions, no Python on the executors.

Each text gives counts (words, their characters and kinds, symbols, capitals, marks, repeated lines, words in repeated
3-word windows). Texts that fail the base rule (fewer than 50 words, or over half of them in repeated windows) go. The
rest are judged within their language and source by a minimum covariance determinant estimate of seven transformed
statistics: texts whose Mahalanobis distance lies beyond the 99.99% quantile of its chi-square distribution go.

The estimate: from several starts (medians and median deviations, and hashed quarters of the texts), C-steps keep the
half nearest to the centre and estimate again from it. After two steps each group goes on with the start of the least
determinant, until no group's determinant falls any more. Estimates are regularised: a share of `PRIOR / (n + PRIOR)`
of a group's centre and covariance comes from the medians and median deviations of all texts, at every size of group
alike, so that small groups have usable estimates and large ones their own. The half's covariance is scaled so that the
median distance is that of a chi-square distribution.

A statistic with the same value in at least half of a group's texts (in prose: symbols, repeated lines and windows,
mostly zero) has no variance in the half. There the centre is that value and the deviation a fixed one, UNITS, without
covariances. Shares of short texts are drawn to what is usual by pseudo-counts, as they vary more.

The texts are read once; their counts, a few numbers a text, are written to the shared folder. Each C-step is a pair of
map-side aggregates. The estimates (some 50 numbers a group) are broadcast when the groups' number is within a checked
bound, else joined.

Defined results: null texts have no words; null languages and sources count as empty strings; texts that fail the base
rule take no part in the estimates; variances have floors of numerical size only; repeated rows
each get their own result; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from pointsmith.session import cut

from .exprs import let, total

#: White space, the characters that count as symbols, capitals, and marks.
WORD_GAP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = ".,;:!?"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Transformed statistics, each with its deviation in groups where half of the texts or more have one value. Each is
#: small enough to reject by itself at the cut-off of 5.4: symbols from 6.7%, repeated lines from 50%, words in
#: repeated windows from 42%.
UNITS = {"length": 0.05, "symbols": 0.048, "lines": 0.13, "repeats": 0.12, "upper": 0.05, "marks": 0.05, "types": 0.05}
#: Pseudo-words that draw short texts' shares to what is usual, with their characters, capitals and marks.
PSEUDO_WORDS, PSEUDO_CHARS, PSEUDO_UPPER, PSEUDO_MARKS = 100, 550, 20, 20
#: Deviations up to here count as none, and pivots of the covariance are at least so large.
TINY = 1e-6
STARTS = 3
STEPS = 20
#: The least fall of a log determinant that counts.
SETTLED = 0.01
#: Texts that the estimate of all texts counts for in each group's.
PRIOR = 20
#: Share of regular texts that the cut-off lets through.
KEEP = 0.9999
MAX_GROUPS = 100_000


def _repeat_words(hashes: Column) -> Column:
    """Words in 3-word windows found twice or more, the first included."""

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))))

    def twice(sorted_windows: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(sorted_windows, j)["g"] == x["g"], F.lit(False))
            return F.when(same(i - 1) | same(i + 1), x["p"])

        return F.filter(F.transform(sorted_windows, mark), lambda p: p.isNotNull())

    def windows(h: Column) -> Column:
        first = F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))
        return F.sort_array(F.transform(first, lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("g"), i.alias("p"))))

    return let(windows(hashes), lambda s: let(F.sort_array(twice(s)), covered))


def text_counts(text: Column) -> Column:
    """Structs w (n_words, word_chars, n_repeat_words, n_types), l (n_lines, n_dup_lines), and s, u, p: symbols, A-Z and marks."""
    full = F.coalesce(text.cast("string"), F.lit(""))

    def counts(words: Column) -> Column:
        hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(_repeat_words(h).alias("r"), F.size(F.array_distinct(h)).cast("long").alias("t")))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), hashed.alias("h"))

    def lines(own: Column) -> Column:
        return F.struct(F.size(own).cast("long").alias("n_lines"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"))

    of_words = let(F.filter(F.split(full, WORD_GAP), lambda w: w != ""), counts)
    of_lines = let(F.filter(F.split(full, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != ""), lines)
    symbols = (F.char_length(full) - F.char_length(F.regexp_replace(full, SYMBOLS + "+", ""))).cast("long")
    upper, marks = ((F.char_length(full) - F.char_length(F.translate(full, c, ""))).cast("long") for c in (UPPER, MARKS))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("s"), upper.alias("u"), marks.alias("p"))


def chi_square(p: float, k: int) -> float:
    """The quantile of a chi-square distribution with k degrees of freedom; 1 for none."""
    if not k:
        return 1.0

    def below(x: float) -> float:  # the regularised lower incomplete gamma function, by its series
        term = total_ = 1 / (k / 2)
        n = k / 2
        while term > total_ * 1e-15:
            n += 1
            term *= x / 2 / n
            total_ += term
        return total_ * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))

    lo, hi = 1e-12, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return lo


def _statistics() -> dict[str, Column]:
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    more, wide = n + PSEUDO_WORDS, F.col("word_chars") + PSEUDO_CHARS
    return {
        "length": F.log(wide / more),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / F.greatest(n, F.lit(1))),
        "upper": F.sqrt((F.col("n_upper") + PSEUDO_UPPER) / wide),
        "marks": F.sqrt((F.col("n_marks") + PSEUDO_MARKS) / wide),
        "types": F.log((F.col("n_types") + PSEUDO_WORDS) / more) / F.log(more),
    }


_NAMES = list(UNITS)
_N = len(_NAMES)
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]
_GROUP = ["g_lang", "g_source"]
_KEY = [*_GROUP, "start"]
_FIXED = [f"f{i}" for i in range(_N)]
_MIDDLE = [f"m{i}" for i in range(_N)]


# Expressions over the statistics are SQL text: the same few long ones serve every step.
def _place(i: int | str, j: int | str) -> str:
    """Where the entry (i, j) of a lower triangle lies in its array of rows."""
    return f"cast({i} * ({i} + 1) / 2 + {j} as int)"


def _triangle(step: str) -> str:
    """An array built entry by entry: step is SQL over acc, the entries so far, and e, the entry's place t, row i and column j."""
    places = ", ".join(f"named_struct('t', {t}, 'i', {i}, 'j', {j})" for t, (i, j) in enumerate(_PAIRS))
    return f"aggregate(array({places}), cast(array() as array<double>), (acc, e) -> concat(acc, array({step})))"


def _sum_over(first: str, n: str, term: str) -> str:
    """The sum of a term over n places k from `first`, none if n is 0."""
    return f"aggregate(slice(array({', '.join(map(str, range(_N)))}), {first} + 1, {n}), 0D, (a, k) -> a + {term})"


#: Cholesky's factor of the covariance c. A floor under the pivots keeps it real where statistics depend on each other.
_REST = f"(get(c, e.t) - {_sum_over('0', 'e.j', f'get(acc, {_place("e.i", "k")}) * get(acc, {_place("e.j", "k")})')})"
_FACTOR = _triangle(f"CASE WHEN e.i = e.j THEN sqrt(greatest({_REST}, {TINY**2}D)) ELSE {_REST} / get(acc, {_place('e.j', 'e.j')}) END")
#: The inverse of the factor l, so that a distance is a sum of products.
_INVERSE = _triangle(f"((CASE WHEN e.i = e.j THEN 1D ELSE 0D END) - {_sum_over('e.j', 'e.i - e.j', f'get(l, {_place("e.i", "k")}) * get(acc, {_place("k", "e.j")})')}) / get(l, {_place('e.i', 'e.i')})")
_LOGDET = " + ".join(f"2 * ln(l[{t}])" for t, (i, j) in enumerate(_PAIRS) if i == j)


def _with_factor(estimate: DataFrame) -> DataFrame:
    """The estimate with its covariance's factor l, the factor's inverse v (as rows), and the log of the determinant."""
    own = [*_KEY, "n", *_FIXED, *_MIDDLE]
    return estimate.selectExpr(*own, f"{_FACTOR} AS l").selectExpr(*own, "l", f"{_INVERSE} AS v", f"{_LOGDET} AS logdet")


class Pool:
    """Medians and median deviations of all texts: what estimates are drawn to."""

    def __init__(self, rows: DataFrame):
        m = rows.agg(*(F.percentile_approx(n, 0.5, 1000).alias(n) for n in _NAMES)).first()
        self.middle = [m[n] or 0.0 for n in _NAMES]
        s = rows.agg(*((F.percentile_approx(F.abs(F.col(n) - F.lit(c)), 0.5, 1000) * 1.4826).alias(n) for n, c in zip(_NAMES, self.middle))).first()
        self.unit = [s[n] if (s[n] or 0.0) > TINY else UNITS[n] for n in _NAMES]

    def drawn(self, sums: DataFrame) -> DataFrame:
        """(key, n, fixed, m, c: an array of the covariances) of a group's own estimate -> the regularised one."""
        share = f"(n / (n + {PRIOR}D))"
        middle = [f"CASE WHEN f{i} THEN m{i} ELSE {share} * m{i} + (1 - {share}) * {self.middle[i]!r}D END AS m{i}" for i in range(_N)]

        def entry(t: int, i: int, j: int) -> str:
            fixed, prior = (repr(float(UNITS[_NAMES[i]] ** 2)), repr(float(self.unit[i] ** 2))) if i == j else ("0.0", "0.0")
            return f"CASE WHEN f{i} OR f{j} THEN {fixed}D ELSE {share} * coalesce(c[{t}], 0D) + (1 - {share}) * {prior}D END"

        return _with_factor(sums.selectExpr(*_KEY, "n", *_FIXED, *middle, f"array({', '.join(entry(t, i, j) for t, (i, j) in enumerate(_PAIRS))}) AS c"))


_COVARIANCES = f"array({', '.join(f'covar_pop({_NAMES[i]}, {_NAMES[j]})' for i, j in _PAIRS)})"
_FIRSTS = "struct(first(n) AS n, " + ", ".join(f"first({f}) AS {f}" for f in _FIXED) + ", " + ", ".join(f"CASE WHEN first(f{i}) THEN first(m{i}) ELSE avg({x}) END AS m{i}" for i, x in enumerate(_NAMES)) + ")"


def _estimate(rows: DataFrame, pool: Pool) -> DataFrame:
    """The regularised estimate of each key's rows; rows carry n and the fixed statistics' flags and centres."""
    return pool.drawn(rows.groupBy(*_KEY).agg(F.expr(_FIRSTS).alias("x"), F.expr(_COVARIANCES).alias("c")).select(*_KEY, "x.*", "c"))


#: The squared Mahalanobis distance in one part a statistic.
_SQUARES = [f"pow({' + '.join(f'v[{i * (i + 1) // 2 + j}] * ({_NAMES[j]} - m{j})' for j in range(i + 1))}, 2)" for i in range(_N)]
_SQUARE = " + ".join(_SQUARES)
#: The fitted statistics' part of it, and how many they are.
_FITTED = " + ".join(f"CASE WHEN f{i} THEN 0D ELSE {x} END" for i, x in enumerate(_SQUARES))
_N_FITTED = " + ".join(f"CASE WHEN f{i} THEN 0 ELSE 1 END" for i in range(_N))
#: The distance with the scale, which holds for the fitted statistics only.
_SCALED = " + ".join(f"CASE WHEN f{i} THEN {x} ELSE {x} / scale END" for i, x in enumerate(_SQUARES))


def _join(rows: DataFrame, groups: DataFrame, small: bool, on: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(groups) if small else groups, on, how)


def _starts(rows: DataFrame, pool: Pool, small: bool) -> DataFrame:
    """Estimates to start from: 0 from medians and median deviations, the others from hashed quarters of the texts."""
    medians = ", ".join(f"percentile_approx({x}, 0.5, 1000) AS m{i}" for i, x in enumerate(_NAMES))
    middle = rows.groupBy(*_GROUP).agg(F.expr(f"struct(count(1) AS n, {medians})").alias("x")).select(*_GROUP, "x.*")
    firsts = ", ".join(f"first({c}) AS {c}" for c in ("n", *_MIDDLE))
    spreads = ", ".join(f"percentile_approx(abs({x} - m{i}), 0.5, 1000) * 1.4826 AS s{i}" for i, x in enumerate(_NAMES))
    spread = _join(rows, middle, small, _GROUP).groupBy(*_GROUP).agg(F.expr(f"struct({firsts}, {spreads})").alias("x")).select(*_GROUP, "x.*")
    flagged = cut(rows.sparkSession, spread.selectExpr("*", *(f"s{i} <= {TINY}D AS f{i}" for i in range(_N))))
    spreads = ", ".join(f"pow(s{i}, 2)" if i == j else "0D" for i, j in _PAIRS)
    first = pool.drawn(flagged.selectExpr(*_GROUP, "0 AS start", "n", *_FIXED, *_MIDDLE, f"array({spreads}) AS c"))
    part = F.pmod(F.xxhash64(*_NAMES), F.lit(4)).cast("int")
    quarters = _join(rows, flagged.select(*_GROUP, "n", *_FIXED, *_MIDDLE), small, _GROUP).withColumn("start", part + 1).where(F.col("start") < STARTS)
    return first.union(_estimate(quarters, pool))


def mcd(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """rows (with the statistics and group columns) -> one estimate a group: n, centre, Cholesky factor, logdet, scale."""
    spark = rows.sparkSession
    small = rows.select(*_GROUP).distinct().count() <= MAX_GROUPS
    pool = Pool(rows)
    now = cut(spark, _starts(rows, pool, small))
    for step in range(steps):
        on = _GROUP
        far = _join(rows, now, small, on).withColumn("d", F.expr(_SQUARE)).select(*_KEY, "n", *_NAMES, *_FIXED, *_MIDDLE, "d", "logdet")
        half = cut(spark, far.groupBy(*_KEY).agg(F.percentile_approx("d", 0.5, 1000).alias("h"), F.first("logdet").alias("before")))
        nearest = _join(far, half.drop("before"), small, _KEY).where(F.col("d") <= F.col("h"))
        new = cut(spark, _estimate(nearest, pool))
        if step == 1:  # each group goes on with the start of its least determinant
            best = new.groupBy(*_GROUP).agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
            new = cut(spark, new.join(F.broadcast(best) if small else best, _KEY, "left_semi"))
        fallen = new.join(half, _KEY).agg(F.max(F.col("before") - F.col("logdet")).alias("by")).first()["by"]
        now = new
        if step > 1 and (fallen is None or fallen < SETTLED):
            break
    # The half's covariance is too small; the median distance of the fitted statistics says by how much.
    median = F.get(F.array(*(F.lit(chi_square(0.5, k)) for k in range(_N + 1))), F.first(F.expr(_N_FITTED)))
    scale = _join(rows, now, small, _GROUP).withColumn("d", F.expr(_FITTED)).groupBy(*_GROUP).agg((F.percentile_approx("d", 0.5, 1000) / median).alias("s"), F.first("n").alias("k"))
    # Drawn to one as the covariance is drawn to that of all texts.
    scale = scale.select(*_GROUP, F.greatest((F.col("s") * F.col("k") + PRIOR) / (F.col("k") + PRIOR), F.lit(TINY)).alias("scale"))
    return cut(spark, _join(now.drop("start"), scale, small, _GROUP))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: float = KEEP) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every text."""
    spark = docs.sparkSession
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("g_lang"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("g_source"), text_counts(F.col(f"`{text_col}`")).alias("c"))
    counts = cut(spark, read.select("doc_id", *_GROUP, "c.w.n_words", "c.w.word_chars", F.col("c.s").alias("n_symbols"), F.col("c.u").alias("n_upper"), F.col("c.p").alias("n_marks"), F.coalesce("c.w.h.t", F.lit(0)).alias("n_types"), "c.l.n_lines", "c.l.n_dup_lines", F.coalesce("c.w.h.r", F.lit(0)).cast("long").alias("n_repeat_words")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    marked = counts.withColumns({"base_failed": failed, **_statistics()})
    estimates = mcd(marked.where(~F.col("base_failed")).select(*_GROUP, *_NAMES))
    small = estimates.count() <= MAX_GROUPS
    judged = _join(marked, estimates, small, _GROUP, "left").withColumn("distance", F.sqrt(F.expr(_SCALED)))
    inside = F.coalesce(F.col("distance") <= math.sqrt(chi_square(keep, _N)), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "distance")
