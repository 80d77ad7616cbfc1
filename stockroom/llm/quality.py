"""Quality rules whose cutoffs are certified on labelled holdouts.

Base rules: too few words, or more than half of the words inside repeated
three-word windows.  Beyond them, every rule compares one integer measure of a
text with a cutoff.  The rules of a stratum are certified together, along declared
paths: one path per non-empty set of rules, whose steps tighten the set's cutoffs by
turns, from the most lenient on.  A step rejects a document if any of its rules does.
For each stratum and path the steps are tested in order (fixed-sequence testing): a
step is certified while the exact binomial tail shows, at level DELTA divided by the
number of strata times paths (Bonferroni), that it rejects at most RISK of the
stratum's good documents.  Testing stops at the first step that fails.  So with
probability 1 - DELTA or more, the rules of every stratum reject together at most RISK
of its good documents, whichever certified step is used: the one with the largest
surplus of bad over good labelled rejections (ties: the fewest rules, then the most
lenient).  With no surplus, or too few labels, nothing is rejected in the stratum.

A trial is a distinct text of the stratum, so copies of a labelled text count once; a
text whose labels contradict one another is not used.  Near copies count apart.

All columns are Spark expressions over whole texts; labels are joined to a
narrow table of measures, and only counts per (stratum, path, step) remain.

Defined results: a null text has no words and fails the base rules; a null
stratum is a stratum of its own; a document with contradicting labels is not
used, repeated label rows count once; without labels nothing is rejected beyond
the base rules; an empty table gives an empty table; input columns named like an
output column are replaced by it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.llm.common import SPACE, drop_clashes, few, let, words
from stockroom.session import ensure_checkpoint_dir

MIN_WORDS = 50
RISK = 0.02
DELTA = 0.1
BROADCAST_STRATA = 100_000
# Rule -> (measure in whole units per 1000 words or per 100 word characters, the
# cutoffs from lenient to strict).  A document is rejected above the cutoff.
RULES = {
    "symbols": ("1000 * n_symbols div n_words", (2000, 1500, 1000, 750, 500, 400, 300, 200, 150, 100)),
    "repeats": ("1000 * n_repeat_words div n_words", (490, 460, 430, 400, 350, 300, 250, 200)),
    "lines": ("1000 * n_dup_lines div n_words", (500, 400, 300, 200, 150, 100, 80, 60, 40, 20)),
    "length": ("100 * word_chars div n_words", (1600, 1400, 1200, 1100, 1000, 900, 850, 800, 750, 700)),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUT = (*MEASURES, "base_failed", "kept")


def repeat_words(w: Column) -> Column:
    """Words of array ``w`` that lie in a three-word window found at least twice.

    Windows are compared by a 64-bit hash.  Texts without a repeated window are
    told apart by a hash set; the others sort (hash, place) pairs."""
    windows = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"]))
                     | (F.get(p, i + 1)["h"] == x["h"])),
            lambda x: x["i"])))

    def covered(at: Column) -> Column:
        # each window adds three words, less those it shares with the window before
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                           lambda acc, i: F.struct(
                               i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n")),
                           lambda acc: acc["n"])

    return F.coalesce(let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(places(h)))), F.lit(0).cast("long"))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                        lambda x: F.xxhash64(x))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input columns plus the measures and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    df = docs.withColumn("_m", found)
    return (df.withColumn("n_words", F.col("_m.n_words"))
            .withColumn("word_chars", F.col("_m.word_chars"))
            .withColumn("n_symbols", F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"))
            .withColumn("n_dup_lines", dup_lines(body))
            .withColumn("n_repeat_words", F.col("_m.n_repeat_words"))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
            .drop("_m"))


def tail(n: Column, k: Column, p: float) -> Column:
    """P[Binomial(n, p) <= k] for k < n*p, by the exact sum.

    Goes up from 0 to k with the log of the newest term and the sum so far in
    units of it, so nothing underflows."""
    start = F.struct((n * F.log(F.lit(1 - p))).alias("log_term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        ratio = (n - i + 1) * F.lit(p) / (i * F.lit(1 - p))
        return F.struct((acc["log_term"] + F.log(ratio)).alias("log_term"),
                        (acc["sum"] / ratio + 1.0).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step, lambda acc: F.exp(acc["log_term"]) * acc["sum"])


def paths(rules: dict = RULES) -> list[list[tuple[str, int]]]:
    """The paths: per set of rules its steps in order, each a rule and its next cutoff."""
    sets = [c for n in range(1, len(rules) + 1) for c in combinations(rules, n)]
    return [[(r, t) for t in range(max(len(rules[r][1]) for r in chosen)) for r in chosen if t < len(rules[r][1])]
            for chosen in sets]


def step_numbers(rules: dict) -> Column:
    """Literal [path][rule][cutoff] -> step of the path; no cutoffs for a rule not on it."""
    def at(path: list, rule: str) -> Column:
        return F.array(*[F.lit(i) for i, (r, _) in enumerate(path) if r == rule]).cast("array<int>")

    return F.array(*[F.array(*[at(path, r) for r in rules]) for path in paths(rules)])


def first_step(values: list[Column], rules: dict) -> Column:
    """Array over the paths: the first step that rejects a row (null: none does)."""
    def within(value: Column, cutoffs: tuple) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: ~F.coalesce(value > c, F.lit(False))))

    # cutoffs are strict to the right: the first that rejects follows those that do not
    reached = [within(v, cutoffs) for v, (_, cutoffs) in zip(values, rules.values(), strict=True)]
    return F.transform(step_numbers(rules), lambda path: F.array_min(F.array(*[
        F.get(F.get(path, i), t) for i, t in enumerate(reached)])))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id",
                      stratum: str = "lang", rules: dict = RULES, risk: float = RISK,
                      delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) of every rule that rejects something in a stratum.

    A step number of each path comes from the rules alone (2^rules - 1 paths), so the
    counts are at most strata x paths x steps rows.  ``measured`` has the measures and ``text_hash`` (see ``narrow_measures``)."""
    ensure_checkpoint_dir(measured.sparkSession)
    said = (labels.where("quality is not null").groupBy(key)
            .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
            .where("quality = _most").drop("_most"))
    # equal texts have equal measures, so any of a text's rows stands for all
    trials = (measured.where(~F.col("base_failed")).join(said, key)
              .groupBy(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), "text_hash")
              .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"),
                   *[F.min(m).alias(m) for m in MEASURES])
              .where("quality = _most"))
    steps = first_step([F.expr(m) for m, _ in rules.values()], rules)
    counts = (trials.select("stratum", "quality", F.posexplode(steps).alias("path", "step"))
              .groupBy("stratum", "path", "step")
              .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                   F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")).checkpoint())
    tests = counts.select("stratum").distinct().count() * len(paths(rules))
    # sums from the lenient end, at every step of the path
    lengths = F.array(*[F.lit(len(path)) for path in paths(rules)])
    per = (counts.groupBy("stratum", "path")
           .agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("step", "good", "bad")).alias("h"))
           .withColumn("step", F.explode(F.sequence(F.lit(0), F.get(lengths, F.col("path")) - 1))))
    rejected = lambda c: F.aggregate(
        F.filter("h", lambda x: x["step"] <= F.col("step")),
        F.lit(0).cast("long"), lambda acc, x: acc + x[c])
    sums = per.withColumn("good", rejected("good")).withColumn("bad", rejected("bad"))
    passed = F.when(F.col("good") >= F.col("n_good") * F.lit(risk), F.lit(False)).otherwise(
        tail(F.col("n_good"), F.col("good"), risk) <= F.lit(delta) / F.lit(max(tests, 1)))
    sequence = Window.partitionBy("stratum", "path").orderBy("step")
    best = Window.partitionBy("stratum").orderBy(F.desc("surplus"), "path", "step")
    chosen = (sums.withColumn("passed", passed)
              .withColumn("certified", F.min("passed").over(sequence))
              .where("certified").withColumn("surplus", F.col("bad") - F.col("good"))
              .withColumn("_place", F.row_number().over(best)).where("_place = 1 and surplus > 0"))
    # how far the chosen step has tightened each rule
    limits = [F.struct(F.lit(r).alias("rule"), F.get(
        F.array(*[F.lit(c) for c in cutoffs]),
        F.size(F.filter(F.get(F.get(step_numbers(rules), F.col("path")), F.lit(i)), lambda t: t <= F.col("step"))) - 1
    ).alias("cutoff")) for i, (r, (_, cutoffs)) in enumerate(rules.items())]
    return (chosen.select("stratum", F.explode(F.array(*limits)).alias("x"))
            .where("x.cutoff is not null").select("stratum", "x.rule", "x.cutoff"))


def with_verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang",
                 rules: dict = RULES) -> DataFrame:
    """``kept``: false if the base rules or a certified cutoff reject the row."""
    ensure_checkpoint_dir(measured.sparkSession)
    per_stratum = cutoffs.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in rules])
    over = reduce(lambda a, b: a | b, [F.coalesce(F.expr(m) > F.col(f"_{r}"), F.lit(False))
                                       for r, (m, _) in rules.items()])
    # one row per stratum that has a certified cutoff: broadcast up to BROADCAST_STRATA
    limits, _ = few(per_stratum.withColumnRenamed("stratum", "_stratum").checkpoint(), BROADCAST_STRATA)
    return (measured.withColumn("_stratum", F.coalesce(F.col(stratum), F.lit("")))
            .join(limits, "_stratum", "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.when(F.col("n_words") > 0, over).otherwise(False))
            .drop("_stratum", *[f"_{r}" for r in rules]))


def plain(docs: DataFrame) -> DataFrame:
    return drop_clashes(docs, *OUTPUT) if {c.lower() for c in docs.columns} & set(OUTPUT) else docs


def narrow_measures(docs: DataFrame, key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """Measures of every row without its text, written once for both later uses."""
    ensure_checkpoint_dir(docs.sparkSession)
    return (with_measures(plain(docs).select(key, stratum, "text"))
            .withColumn("text_hash", F.xxhash64("text")).drop("text").checkpoint())


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row."""
    measured = narrow_measures(docs)
    return with_verdict(measured, certified_cutoffs(measured, labels)).select("doc_id", *OUTPUT)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns.

    Cutoffs come from the narrow measures; the rows themselves are measured in
    the pass that writes them, so texts are never shuffled."""
    cutoffs = certified_cutoffs(narrow_measures(docs), labels)
    named = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*named).alias("_row"), F.col("text"), F.col("lang"))
    return with_verdict(with_measures(whole), cutoffs).where("kept").select("_row.*")


# The same measures by unnesting, the same tests with the log-gamma function.
_VALUES = " UNION ALL ".join(
    f"SELECT stratum, text, quality, '{r}' AS rule, {m.replace(' div ', ' // ')} AS value FROM trials"
    for r, (m, _) in RULES.items())
_ABLE = _VALUES.replace("stratum, text, quality,", "doc_id, stratum,").replace("FROM trials", "FROM able")
_STEPS = ", ".join(f"({p}, {i}, '{r}', {RULES[r][1][t]})" for p, path in enumerate(paths()) for i, (r, t) in enumerate(path))
SQL = f"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, unnest(range(0, len(w) - 2)) AS p, unnest(list_transform(range(1, len(w) - 1),
         lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM split WHERE len(w) >= 3),
often AS (SELECT doc_id, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM often, range(0, 3) t(k) GROUP BY doc_id),
measures AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures),
able AS (SELECT * FROM judged WHERE NOT base_failed),
said AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL
         GROUP BY doc_id HAVING min(quality) = max(quality)),
trials AS (
  SELECT stratum, text, min(quality) AS quality, min(n_words) AS n_words, min(word_chars) AS word_chars,
         min(n_symbols) AS n_symbols, min(n_dup_lines) AS n_dup_lines, min(n_repeat_words) AS n_repeat_words
  FROM able JOIN said USING (doc_id) JOIN split USING (doc_id, stratum)
  GROUP BY stratum, text HAVING min(quality) = max(quality)),
vals AS ({_VALUES}),
steps(path, step, rule, cutoff) AS (VALUES {_STEPS}),
firsts AS (
  SELECT stratum, text, quality, path, min(CASE WHEN value > cutoff THEN step END) AS first
  FROM vals JOIN steps USING (rule) GROUP BY ALL),
counts AS (
  SELECT stratum, path, step, sum((quality = 1)::INT)::BIGINT AS n_good,
         sum((quality = 1 AND coalesce(first <= step, false))::INT)::BIGINT AS good,
         sum((quality = 0 AND coalesce(first <= step, false))::INT)::BIGINT AS bad
  FROM firsts JOIN (SELECT path, step FROM steps) USING (path) GROUP BY ALL),
tests AS (
  SELECT *, good < n_good * {RISK} AND list_sum(list_transform(range(0, good + 1), lambda i:
           exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
               + i * ln({RISK}) + (n_good - i) * ln(1 - {RISK}))))
         <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM counts) * {len(paths())}) AS passed
  FROM (SELECT * FROM counts WHERE n_good > 0)),
best AS (
  SELECT stratum, path, step FROM (
    SELECT *, min(passed::INT) OVER (PARTITION BY stratum, path ORDER BY step) AS certified FROM tests)
  WHERE certified = 1 AND bad > good
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad - good DESC, path, step) = 1),
limits AS (
  SELECT b.stratum, s.rule, min(s.cutoff) AS cutoff FROM best b JOIN steps s ON s.path = b.path AND s.step <= b.step
  GROUP BY ALL),
able_values AS ({_ABLE}),
rejected AS (SELECT DISTINCT doc_id FROM able_values JOIN limits USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM judged
"""
