"""Quality rules whose cutoffs carry a guarantee on labelled holdouts. DataFrame operations only.

Base facts of a text are counted; a few of them are ratios with a rule each: reject at or above a cutoff. For each
stratum (language) and rule a fixed grid of cutoffs is tested on labelled rows: with n good rows, of which the cutoff
rejects k, the exact binomial test of "the rule falsely rejects more than ``risk`` of good rows" has p-value
P(Bin(n, risk) <= k). Cutoffs of a rule are tested in a fixed sequence from the highest down, each at ``level`` / (strata
times rules), until one fails; as lower cutoffs reject no fewer rows their p-values only grow, so those certified are the
ones with p <= that level, and the lowest is used. A fixed sequence needs no correction for its length, Bonferroni corrects
over strata and rules. So with chance 1 - ``level`` at least, no stratum loses more than
``risk`` of its good rows to a rule in use, and rules times ``risk`` to all of them. A stratum with too few labelled
rows gets no cutoff and so loses nothing.

Defined results: a null text has no words, lines or symbols, and the base rule rejects it; a null language is a stratum
of its own; rows with a null id are judged and never calibrated on; an id with several labels is good if all of them
say so; repeated rows are judged one by one; empty label tables certify nothing; other columns are ignored.
Windows of words are compared by a 64-bit hash within one text, where a chance collision is below 1e-10.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, few_texts, materialize, small

#: Separators of words, as characters.
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Each rule's numerator and denominator among the counted facts.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}
#: Cutoffs in thousandths.
GRID = (50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more."""

    def covered(places: Column) -> Column:
        """Each place, in order, adds as many words as its window reaches beyond the one before."""
        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")), lambda a: a["n"])

    def twice(s: Column) -> Column:
        """Places whose hash a neighbour in the order of hashes shares."""
        same = lambda i, j: F.get(s, i)["h"] == F.coalesce(F.get(s, j)["h"], F.bitwise_not(F.get(s, i)["h"]))
        repeated = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(repeated, lambda j: F.get(s, j)["i"]))

    def count(h: Column) -> Column:
        # Most texts repeat no window and stop at the comparison of sizes.
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(_let(ordered, lambda s: covered(twice(s))))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(hashes, count))


def facts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the counted facts in place of the text."""
    keep = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    length = lambda c: F.length(c).cast("long")
    trimmed = F.btrim(t, F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("again")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    solid = length(F.regexp_replace(t, GAP, "")).alias("word_chars")
    marks = (length(t) - length(F.regexp_replace(t, SYMBOLS, ""))).alias("n_symbols")
    capitals = length(F.regexp_replace(t, "[^A-Z]+", "")).alias("n_capitals")
    d = docs.select(*keep, of_words.alias("_w"), of_lines.alias("_l"), solid, marks, capitals)
    return d.select(*keep, "word_chars", "n_symbols", "n_capitals", F.col("_w.n").alias("n_words"), F.col("_l.n").alias("n_lines"), F.col("_l.again").alias("n_dup_lines"), F.col("_w.again").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _hit(rule: str, cutoff: Column) -> Column:
    above, below = RULES[rule]
    return F.coalesce((F.col(below) > 0) & (F.col(above) * 1000 >= cutoff * F.col(below)), F.lit(False))


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), term by term in logarithms; 1 where k is above the mean, as no small level is met there."""
    odds = F.lit(risk / (1 - risk))
    first = n * F.log1p(F.lit(-risk))
    step = lambda a, j: F.struct((a["t"] + F.log((n - j + 1) / j * odds)).alias("t"), (a["p"] + F.exp(a["t"] + F.log((n - j + 1) / j * odds))).alias("p"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * risk, F.lit(1.0)).otherwise(F.aggregate(terms, F.struct(first.alias("t"), F.exp(first).alias("p")), step, lambda a: a["p"]))


def cutoffs(known: DataFrame, *, risk: float = 0.005, level: float = 0.05) -> DataFrame:
    """From the facts of labelled rows (``stratum``, ``good``), a row for each stratum with a certified cutoff: stratum
    and a column for each rule (null: none)."""
    good = known.where(F.col("good") & ~base_failed())
    sums = [F.sum(_hit(r, F.lit(c)).cast("long")).alias(f"{r}_{c}") for r in RULES for c in GRID]
    n = good.groupBy("stratum").agg(F.count("*").alias("n"), *sums)
    tests = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r in RULES for c in GRID])).alias("x")
    t = n.select("stratum", "n", tests).select("stratum", "n", "x.*")
    strata = good.select("stratum").distinct().count()
    p = binomial_tail(F.col("n"), F.col("k"), risk)
    sure = t.where(p <= level / (max(1, strata) * len(RULES)))
    return sure.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", risk: float = 0.005, level: float = 0.05) -> DataFrame:
    """doc_id, the base facts, base_failed, failed_rule (the first rule that rejects it, null if none) and kept, a row
    for each row of ``docs``. All labelled rows calibrate the cutoffs."""
    rows = few_texts(docs).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(stratum)), F.lit("")).alias("stratum"))
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y is not null")
    n = lab.count()
    # Bad rows play no part in the cutoffs.
    lab = lab.groupBy("doc_id").agg((F.min("y") == 1).alias("good")).where("good")
    known = materialize(facts(rows.join(small(lab, n), "doc_id")), "facts", n)
    # A certified stratum takes over a thousand good rows, so there are few.
    cut = cutoffs(known, risk=risk, level=level)
    d = facts(rows).join(F.broadcast(cut), "stratum", "left")
    failed = F.coalesce(*[F.when(_hit(r, F.col(f"cut_{r}")), F.lit(r)) for r in RULES])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return d.select(*names, base_failed().alias("base_failed"), failed.alias("failed_rule")).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


#: The same in DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS stratum FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), windows AS (
  SELECT r, i, array_to_string(list_slice(words, i, i + 7), ' ') AS x
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1
), rep AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r
), f AS (
  SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals
  FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM f
), lab AS (
  SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), good AS (
  SELECT b.* FROM b JOIN lab USING (doc_id) WHERE good AND NOT base_failed
), grid AS (
  SELECT rule, cutoff FROM (VALUES ('symbols'), ('dup_lines'), ('repeats'), ('capitals')) x(rule),
    (VALUES (50), (100), (150), (200), (250), (300), (400), (500), (600), (700), (800), (900)) y(cutoff)
), tests AS (
  SELECT stratum, rule, cutoff, count(*) AS n, sum(CASE rule
    WHEN 'symbols' THEN word_chars > 0 AND n_symbols * 1000 >= cutoff * word_chars
    WHEN 'dup_lines' THEN n_lines > 0 AND n_dup_lines * 1000 >= cutoff * n_lines
    WHEN 'repeats' THEN n_words > 0 AND n_repeat_words * 1000 >= cutoff * n_words
    ELSE word_chars > 0 AND n_capitals * 1000 >= cutoff * word_chars END::INT)::BIGINT AS k
  FROM good, grid GROUP BY ALL
), p AS (
  SELECT *, CASE WHEN k > n * 0.005 THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.005) + (n - j) * ln(0.995)))) END AS p FROM tests
), cut AS (
  SELECT stratum, min(cutoff) FILTER (WHERE rule = 'symbols') AS cut_symbols, min(cutoff) FILTER (WHERE rule = 'dup_lines') AS cut_dup_lines,
    min(cutoff) FILTER (WHERE rule = 'repeats') AS cut_repeats, min(cutoff) FILTER (WHERE rule = 'capitals') AS cut_capitals
  FROM p WHERE p <= 0.05 / ((SELECT count(DISTINCT stratum) FROM tests) * 4) GROUP BY stratum
), j AS (
  SELECT b.*, CASE WHEN word_chars > 0 AND n_symbols * 1000 >= cut_symbols * word_chars THEN 'symbols'
    WHEN n_lines > 0 AND n_dup_lines * 1000 >= cut_dup_lines * n_lines THEN 'dup_lines'
    WHEN n_words > 0 AND n_repeat_words * 1000 >= cut_repeats * n_words THEN 'repeats'
    WHEN word_chars > 0 AND n_capitals * 1000 >= cut_capitals * word_chars THEN 'capitals' END AS failed_rule
  FROM b LEFT JOIN cut USING (stratum)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule,
  NOT base_failed AND failed_rule IS NULL AS kept FROM j
"""
