"""Quality rules, toxicity, Jaccard join, line dedup and decontamination on small tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import decontam, jaccard, lines, quality, toxicity
from stockroom.llm.common import components, simhash
from tests.llm.util import WORD, documents, edited, empty, labels, prose, rows

# --- helpers ----------------------------------------------------------------------


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 2), (9, 9), (None, 1), (20, 10), (30, 20)] + [(100 + i, 101 + i) for i in range(50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in found.items() if k < 100} == {1: 1, 2: 1, 3: 1, 10: 10, 20: 10, 30: 10}
    assert {v for k, v in found.items() if k >= 100} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_simhash(hashes):
    out = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in hashes) > len(hashes))
    return out - 2**64 if out >= 2**63 else out


def test_simhash(spark):
    r = random.Random(5)
    given = [[r.randrange(-2**63, 2**63) for _ in range(n)] for n in (0, 1, 2, 5, 62, 63, 64, 65, 400, 16_383, 16_390)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(given)], "i int, h array<long>")
    for row in df.select("i", simhash(F.col("h")).alias("s")).collect():
        assert row.s == slow_simhash(given[row.i])


# --- quality ----------------------------------------------------------------------


def slow_measures(text):
    w = WORD.findall(text or "")
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered))


def test_measures_match_brute_force(spark):
    texts = [t for _, t, *_ in rows()] + ["a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "##$ é|<> b", "a b a b a", "\n\n",
                                          "a b c d a b c d", "p q r s p q r z r s p q"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.with_measures(docs).collect():
        want = slow_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


@pytest.mark.parametrize("n,k,p", [(10, 0, .05), (200, 1, .02), (1000, 7, .01), (5000, 90, .02), (100_000, 1900, .02)])
def test_binomial_tail_is_exact(spark, n, k, p):
    got = spark.range(1).select(quality.tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                              + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-6)


def labelled(spark, n=1500):
    """Good prose, and bad prose full of symbols, in one stratum; too few in another."""
    r = random.Random(3)
    found = []
    for i in range(n):
        bad = i % 5 == 0
        text = " ".join(f"w{r.randrange(900)}{'###' if bad else ''}" for _ in range(60))
        found.append((i, text, "en" if i < n - 40 else "xx", "s", 1, 0 if bad else 1))
    df = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    return df.drop("quality"), df.select("doc_id", "quality", F.lit(0).alias("toxic"))


def test_certified_cutoffs_reject_bad_and_keep_good(spark):
    docs, said = labelled(spark)
    out = quality.quality_verdicts(docs, said).join(said, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.kept == (r.quality == 1) for r in out if r.lang == "en")
    assert all(r.kept for r in out if r.lang == "xx")          # nothing can be certified on 40 rows
    kept = quality.keep_good(docs.withColumn("n_words", F.lit("own")), said)
    assert kept.columns == [*docs.columns, "n_words"] and kept.where("n_words = 'own'").count() == sum(r.kept for r in out)


def slow_tail(n, k, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                              + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def slow_limits(strata, rules, risk, delta):
    """{stratum: {rule: cutoff}} from {stratum: [(values per rule, good)]}, path by path, step by step."""
    names = list(rules)
    sets = [c for n in range(1, len(names) + 1) for c in itertools.combinations(names, n)]
    out = {}
    for stratum, trials in strata.items():
        n, best = sum(good for _, good in trials), None
        for chosen in sets:
            limits = {}
            turns = [(r, t) for t in range(20) for r in chosen if t < len(rules[r])]
            for r, t in turns:
                limits[r] = rules[r][t]
                hit = [good for values, good in trials if any(values[x] > c for x, c in limits.items())]
                if n == 0 or sum(hit) >= n * risk or slow_tail(n, sum(hit), risk) > delta / len(strata) / len(sets):
                    break
                if len(hit) - 2 * sum(hit) > (best[0] if best else 0):
                    best = (len(hit) - 2 * sum(hit), dict(limits))
        if best:
            out[stratum] = best[1]
    return out


def measured_rows(r, n_good, n_bad, stratum, start):
    """(doc_id, lang, text_hash, base_failed, the five measures, quality) with 1000 words each."""
    out = []
    for i in range(n_good + n_bad):
        good = i < n_good
        high = [r.random() < (0.004 if good else 0.4) for _ in range(4)]
        symbols, repeats, lines_, length = (r.choice([120, 260, 480, 900, 1700]) if h else 5 for h in high)
        out.append((start + i, stratum, start + i, False, 1000, 600 * 10 + length * 10, symbols, lines_, min(repeats, 480),
                    int(good)))
    return out


MEASURED = ("doc_id long, lang string, text_hash long, base_failed boolean, n_words long, word_chars long, "
            "n_symbols long, n_dup_lines long, n_repeat_words long, quality int")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cutoffs_match_brute_force(spark, seed):
    r = random.Random(seed)
    found = [x for i, (s, g, b) in enumerate([("a", 1500, 200), ("b", 500, 80), (None, 900, 0), ("c", 0, 40), ("d", 3000, 500)])
             for x in measured_rows(r, g, b, s, 10_000 * i)]
    copies = [(x[0] + 100_000, *x[1:]) for x in found[::3]] + [(x[0] + 200_000, *x[1:-1], 1 - x[-1]) for x in found[::50]]
    df = spark.createDataFrame(found + copies, MEASURED)
    got = {}
    for x in quality.certified_cutoffs(df.drop("quality"), df.select("doc_id", "quality")).collect():
        got.setdefault(x.stratum, {})[x.rule] = x.cutoff
    strata = {}
    for x in [x for i, x in enumerate(found) if i % 50]:          # every fiftieth text contradicts itself
        words_, chars, symbols, lines_, repeats = x[4:9]
        strata.setdefault(x[1] or "", []).append(({
            "symbols": 1000 * symbols // words_, "repeats": 1000 * repeats // words_,
            "lines": 1000 * lines_ // words_, "length": 100 * chars // words_}, x[-1]))
    assert got == slow_limits(strata, {k: v[1] for k, v in quality.RULES.items()}, quality.RISK, quality.DELTA)
    assert "d" in got and "c" not in got


def test_copies_are_one_trial(spark):
    """Copies of one good text add no evidence; the same number of different texts does."""
    good, bad = [prose(i, 60) for i in range(100)], [" ".join(["###" + w for w in prose(i, 60).split(" ")]) for i in range(50)]
    for more, certified in ((good[:1] * 400, 0), ([prose(1000 + i, 60) for i in range(400)], 1)):
        found = [(i, t, "en", "s", 1, q) for i, (t, q) in enumerate([(t, 1) for t in good + more] + [(t, 0) for t in bad])]
        df = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long, quality int")
        cutoffs = quality.certified_cutoffs(quality.narrow_measures(df.drop("quality")), df.select("doc_id", "quality"))
        assert cutoffs.count() == certified


def test_false_rejection_of_all_rules_together_is_limited():
    """Four rules, each with a cutoff just above its share of the risk: the chosen rules reject more
    than RISK of the good texts in at most DELTA of the drawn holdouts."""
    rules = {k: v[1][:2] for k, v in quality.RULES.items()}
    r, missed, runs = random.Random(5), 0, 60
    share = 0.0062                                   # four together: 2.46 %
    for _ in range(runs):
        trials = []
        for i in range(2600):
            good = i < 2000
            values = {k: 10**6 if r.random() < (share if good else 0.5) else 0 for k in rules}
            trials.append((values, int(good)))
        limits = slow_limits({"s": trials}, rules, quality.RISK, quality.DELTA).get("s", {})
        missed += 1 - (1 - share) ** len(limits) > quality.RISK
    assert missed <= 0.1 * runs


def test_quality_edge_tables(spark):
    out = quality.quality_verdicts(documents(spark, extra=True), labels(spark)).collect()
    assert len(out) == len(rows())
    assert Counter((r.doc_id, r.n_words) for r in out) == Counter((d, slow_measures(t)[0]) for d, t, *_ in rows())
    none = labels(spark).limit(0)
    assert all(r.kept != r.base_failed for r in quality.quality_verdicts(documents(spark), none).collect())
    assert quality.quality_verdicts(empty(spark), labels(spark)).count() == 0
    assert quality.keep_good(empty(spark), none).columns == documents(spark).columns


# --- toxicity ----------------------------------------------------------------------


def slow_segments(scores):
    """All maximal segments by their definition: the best segment, then both sides."""
    out, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j + 1)
        if best:
            out.append((best[1], best[2], round(best[0], 4)))
            todo += [(a, best[1]), (best[2], b)]
    return sorted(out)


def test_maximal_segments_match_their_definition():
    r = random.Random(9)
    for _ in range(200):
        scores = np.array([r.choice([-3, -2, -1, 1, 2, 4]) + r.random() / 100 for _ in range(r.randrange(0, 25))])
        got = [(a, b, round(s, 4)) for a, b, s in toxicity.maximal_segments(scores)]
        want = slow_segments(scores)
        # a segment keeps the surroundings that do not change its sum's order
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-3)


def test_maximal_segments_take_linear_time():
    import time
    scores = np.full(400_000, -0.4)
    scores[::10] = 1.0                                # falling left sums: no candidate ends another
    start = time.process_time()
    assert len(toxicity.maximal_segments(scores)) == 40_000 and time.process_time() - start < 10


def toxic_docs(spark, n=600):
    r, insults = random.Random(4), ["zog", "blarg", "fnurd", "quib"]
    found = []
    for i in range(n):
        words = [f"w{r.randrange(2000)}" for _ in range(80)]
        bad = i % 6 == 0
        if bad:
            at = r.randrange(60)
            for k in range(0, 10, 2):
                words[at + k] = r.choice(insults).upper() if k == 0 else r.choice(insults)
        found.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(found, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", F.lit(1).alias("quality"), "toxic")


def test_toxic_documents_are_found_on_the_held_out_third(spark):
    docs, said = toxic_docs(spark)
    out = toxicity.op4_documents(docs, said).join(said, "doc_id").where("held_out").collect()
    hits = sum(r.predicted == r.toxic for r in out)
    assert len(out) > 150 and hits / len(out) > 0.97
    model = toxicity.learn(docs, said)
    found = toxicity.toxicity(docs, model).join(said, "doc_id").where("toxic = 1").collect()
    spans = [(s.start, s.stop) for r in found for s in r.segments]
    assert len(spans) >= 0.9 * len(found) and all(b - a <= 20 for a, b in spans)


def test_toxicity_edge_tables(spark):
    out = toxicity.op4_documents(documents(spark, extra=True), labels(spark)).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, *_ in rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    one_side = labels(spark, [(9, 1, 0), (10, 1, 0)])
    assert {r.score for r in toxicity.op4_documents(documents(spark), one_side).collect()} == {0.0}
    assert toxicity.op4_documents(empty(spark), labels(spark)).count() == 0


def test_held_out_labels_are_not_learned_from(spark):
    import zlib
    docs, said = toxic_docs(spark, 300)
    held = F.udf(lambda i: zlib.crc32(str(i).encode()) % 3 == 1, "boolean")
    flipped = said.withColumn("toxic", F.when(held("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: {r.doc_id: round(r.score, 9) for r in toxicity.op4_documents(docs, x).collect()}
    assert score(said) == score(flipped)


def test_tokens_share_no_counts(spark, monkeypatch):
    import zlib
    spell, other = "zog", None
    for i in itertools.count():                       # a clean word in the toxic one's bucket of old
        if zlib.crc32(f"u{i}".encode()) % (1 << 18) == zlib.crc32(spell.encode()) % (1 << 18):
            other = f"u{i}"
            break
    r, found = random.Random(5), []
    for i in range(600):
        words = [f"w{r.randrange(2000)}" for _ in range(60)]
        words[20:26] = [spell] * 6 if i % 6 == 0 else [other] * 6
        found.append((i, " ".join(words), int(i % 6 == 0)))
    df = spark.createDataFrame(found, "doc_id long, text string, toxic int")
    run = lambda: {r.doc_id: (round(r.score, 9), r.predicted, r.n_segments)
                   for r in toxicity.op4_documents(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    got = run()
    assert all(got[i][1] == toxic for i, _, toxic in found)
    monkeypatch.setattr(toxicity, "BROADCAST_TOKENS", 0)
    assert run() == got


# --- Jaccard join --------------------------------------------------------------------


def slow_components(texts, width, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
                    else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 70)])
def test_components_match_brute_force(spark, width, percent):
    found = rows()
    sizes, roots = slow_components([t for _, t, *_ in found], width, percent)
    low = defaultdict(list)
    for (d, *_), r in zip(found, roots, strict=True):
        low[r].append(d)
    want = Counter((d, n, min((x for x in low[r] if x is not None), default=None))
                   for (d, *_), n, r in zip(found, sizes, roots, strict=True))
    out = jaccard.near_duplicates(documents(spark, extra=True), width=width, percent=percent).collect()
    assert Counter(map(tuple, out)) == want


def test_near_copies_in_a_large_group(spark):
    base = prose(8, 150, 3000)
    texts = [edited(base, i, (i % 6) / 100) for i in range(300)] + [prose(500 + i, 100, 3000) for i in range(50)]
    _, roots = slow_components(texts, 3, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, width=3, percent=90).collect()}
    assert [out[i] for i in range(len(texts))] == roots


def test_one_of_each_group_stays(spark):
    docs = documents(spark, extra=True)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    found = rows()
    sizes, roots = slow_components([t for _, t, *_ in found], 5, 80)
    groups = len({r for r, n in zip(roots, sizes, strict=True) if n})
    kept = out.select("doc_id", "text").collect()
    assert sum(bool(WORD.search(r.text or "")) for r in kept) == groups
    assert sum(not WORD.search(r.text or "") for r in kept) == sizes.count(0)
    assert 9 in {r.doc_id for r in kept} and 10 not in {r.doc_id for r in kept}
    assert jaccard.one_of_each(empty(spark)).count() == 0
    assert jaccard.op5_documents(empty(spark)).count() == 0


def test_hashed_sets_equal_word_sets():
    import pyarrow as pa
    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "b", "ab", "É", "x y", "A"]) for _ in range(r.randrange(0, 40))) for _ in range(300)]
    texts += ["", " ", "\n", "a\tb\x0bc\x0cd\re", "A B a b"]
    low = str.maketrans("AB", "ab")
    for width in (1, 2, 3, 5):
        got = [len(s) for _, sets in jaccard.shingle_sets(pa.array(texts), width) for s in sets]
        want = []
        for t in texts:
            w = WORD.findall(t.translate(low))
            want.append(len({tuple(w[i:i + width]) for i in range(len(w) - width + 1)}) if len(w) >= width else int(bool(w)))
        assert got == want


# --- line dedup -----------------------------------------------------------------------


def test_fuzzy_lines(spark):
    line = prose(11, 60, 5000)
    near = line.replace(line.split(" ")[30], line.split(" ")[30] + "q")
    other = prose(12, 60, 5000)
    found = [(1, f"{line}\nshort one\n{other}"), (2, f"{line.upper()}!\nshort one\n{near}"), (3, None), (4, ""),
             (5, f"\n{other}\n{other}\n"), (5, f"\n{other}\n{other}\n"), (None, line), (6, "漢 字 " * 5000)]
    docs = spark.createDataFrame(found, "doc_id long, text string").withColumn("n_lines", F.lit("own")).withColumn(
        "line", F.lit(1))
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "line", "text", "n_lines", "n_removed"]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect())
    mark = {x: spark.range(1).select(simhash(F.transform(lines.line_words(F.lit(x)), lambda w: F.xxhash64(w)))).first()[0]
            for x in (line, near)}
    close = bin((mark[line] ^ mark[near]) % 2**64).count("1") <= lines.RADIUS
    second = "short one" if close else f"short one\n{near}"
    assert got == Counter([
        (1, f"{line}\nshort one\n{other}", 3, 0), (2, second, 3, 1 + close), (3, None, 0, 0), (4, "", 1, 0),
        (5, "\n", 4, 2), (5, "\n", 4, 2), (None, "", 1, 1), (6, "漢 字 " * 5000, 1, 0)])
    assert lines.op7_documents(empty(spark)).count() == 0


def slow_lines(found, radius):
    """Brute force over all pairs of distinct normalised lines."""
    split = re.compile(r"[\W_]+")
    places = defaultdict(list)
    for d, t in found:
        for j, raw in enumerate((t or "").split("\n")):
            w = [x for x in split.split(raw.lower()) if x]
            if len(w) >= lines.MIN_WORDS:
                places[" ".join(w)].append((d, j))
    return places


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_lines_match_brute_force(spark):
    r = random.Random(6)
    bases = [prose(700 + i, 50, 5000) for i in range(6)]
    found = []
    for d in range(60):
        found.append((d, "\n".join(edited(r.choice(bases), 10 * d + k, r.choice([0, 0, .02, .04])) for k in range(3))))
    places = slow_lines(found, lines.RADIUS)
    texts = sorted(places)
    df = spark.createDataFrame([(i, t.split(" ")) for i, t in enumerate(texts)], "i int, w array<string>")
    marks = {x.i: x.s % 2**64 for x in df.select("i", simhash(F.transform("w", lambda w: F.xxhash64(w))).alias("s")).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (marks[a] ^ marks[b]).bit_count() <= lines.RADIUS and root(a) != root(b):
            longer = max(len(texts[a]), len(texts[b]))
            if distance(texts[a], texts[b]) <= int((1 - lines.SIMILARITY) * longer + 1e-9):
                parent[root(a)] = root(b)
    first = {}
    for i, t in enumerate(texts):
        first[root(i)] = min([first.get(root(i), (10**9, 0)), *places[t]])
    lost = Counter(p[0] for i, t in enumerate(texts) for p in places[t] if p != first[root(i)])
    docs = spark.createDataFrame(found, "doc_id long, text string")
    out = {x.doc_id: x.n_removed for x in lines.dedup_lines(docs).collect()}
    assert out == {d: lost[d] for d, _ in found} and sum(lost.values()) > 60


def alike_groups(texts):
    """Groups of distinct normalised lines by edit similarity alone."""
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        longer, shorter = max(len(texts[a]), len(texts[b])), min(len(texts[a]), len(texts[b]))
        most = int((1 - lines.SIMILARITY) * longer + 1e-9)
        if longer - shorter <= most and root(a) != root(b) and distance(texts[a], texts[b]) <= most:
            parent[root(a)] = root(b)
    return [root(i) for i in range(len(texts))]


def test_fuzzy_lines_reach_the_edit_similarity(spark):
    r = random.Random(8)

    def typo(t):
        at = r.randrange(len(t))
        return t[:at] + r.choice(["", t[at] + "k", "z"]) + t[at + 1:]

    texts = []
    for n in (5, 6, 8, 10, 12, 16, 20, 30):
        for i in range(4):
            base = prose(1000 * n + i, n, 5000)
            w = base.split(" ")
            w[n // 2] = "qx"
            most = max(1, len(base) // 20)
            variants = [base, " ".join(w)] + [base] * 2
            for _ in range(most):
                variants[2], variants[3] = typo(variants[2]), typo(variants[3])
            texts += variants
    texts += ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(40 + 50 * i)) for i in range(2)]
    texts += [t[:20] + "\u9999" + t[21:] for t in texts[-2:]]
    texts = sorted({" ".join(t.split()) for t in texts if len(t.split()) >= lines.MIN_WORDS})
    groups = alike_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {g: min(i for i in range(len(texts)) if groups[i] == g) for g in groups}
    out = {x.doc_id: x.n_removed for x in lines.dedup_lines(docs).collect()}
    assert out == {i: int(first[g] != i) for i, g in enumerate(groups)} and sum(out.values()) > 40


def test_short_and_unspaced_lines_are_deduplicated(spark):
    r = random.Random(3)
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(120))
    thai = "".join(chr(0x0E01 + r.randrange(40)) for _ in range(30))
    first = ["Read more", "OK", han, thai, "* * *", "", "Terms of service", "x"]
    second = ["read more!", "ok", han[:50] + "\u9999" + han[51:], thai[:9] + thai[10:], " * * * ", "", "Terms of servize",
              "y"]
    docs = spark.createDataFrame([(1, "\n".join(first)), (2, "\n".join(second))], "doc_id long, text string")
    out = {x.doc_id: (x.text, x.n_removed) for x in lines.dedup_lines(docs, min_words=1).collect()}
    assert out == {1: ("\n".join(first), 0), 2: ("\ny", 6)}
    assert {x.doc_id: x.n_removed for x in lines.op7_documents(docs).collect()} == {1: 0, 2: 6}


def kept_bytes(spark):
    from pathlib import Path
    from urllib.parse import urlparse
    top = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    return sum(p.stat().st_size for p in top.rglob("*") if p.is_file())


def test_fuzzy_lines_store_little_beside_the_lines(spark):
    texts = [prose(9000 + i, 60, 5000) for i in range(400)]
    texts += [edited(t, i, 0.02) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = kept_bytes(spark)
    removed = {x.doc_id for x in lines.dedup_lines(docs).where("n_removed = 1").collect()}
    # one compressed row per line and shared key: 1.4 times the texts; with a row for each role it was 3.4 times
    kept = kept_bytes(spark) - before
    assert kept < 2 * sum(map(len, texts)), kept / sum(map(len, texts))
    assert len(removed) > 350 and min(removed) >= 400


def test_fuzzy_lines_are_verified_in_passes(spark, monkeypatch):
    r = random.Random(9)
    bases = [prose(9900 + i, n, 5000) for i, n in enumerate((3, 5, 8, 20, 40))]
    found = [(d, "\n".join(edited(r.choice(bases), 10 * d + k, r.choice([0, .03])) for k in range(3))) for d in range(60)]
    docs = spark.createDataFrame(found, "doc_id long, text string")
    run = lambda: {x.doc_id: (x.n_removed, x.kept_crc32) for x in lines.op7_documents(docs).collect()}
    whole, seen = run(), []
    monkeypatch.setattr(lines, "PASS_CHARS", 1)
    real = type(docs).checkpoint
    monkeypatch.setattr(type(docs), "checkpoint", lambda self, *a: seen.append(self.columns) or real(self, *a))
    assert run() == whole
    assert seen.count(["a", "b"]) > 3, seen


def test_lines_with_a_common_shingle_alone_are_not_compared_in_full(spark, monkeypatch):
    r = random.Random(12)
    texts = []
    for i in range(40):
        word = lambda: "".join(r.choices(r.sample("abcdefghijklmnopqrstuvwxyz", 7), k=7))
        rest = [word() for _ in range(16 + i % 2)]
        texts.append(" ".join([*rest[:2], "once", "upon", "a", "time", *rest[2:]]))
    texts = sorted(texts + [t[:20] + "qq" + t[22:] for t in texts[:10]])
    groups, real, seen = alike_groups(texts), lines.verified, []
    monkeypatch.setattr(lines, "verified", lambda pairs, uniq: seen.append(pairs.count()) or real(pairs, uniq))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x.n_removed for x in lines.op7_documents(docs).collect()}
    first = {g: min(i for i in range(len(texts)) if groups[i] == g) for g in groups}
    assert out == {i: int(first[g] != i) for i, g in enumerate(groups)} and sum(out.values()) == 10
    # over a thousand pairs share the shingle and nearly a length
    assert sum(seen) < 100, seen


def test_letters_leave_every_alike_pair(spark):
    r = random.Random(13)
    letters = "etaoin shrdlu qz7é"
    found = [("", ""), ("a" * 70_000, "a" * 64_000), ("ab" * 40_000, "ab" * 36_001)]
    for n in (5, 20, 60, 200, 400):
        for _ in range(12):
            a = "".join(r.choices(letters, k=n))
            b = list(a)
            for _ in range(r.randrange(n // 10 + 3)):
                at = r.randrange(len(b))
                b[at:at + 1] = r.choice([[], [r.choice(letters)], [b[at], r.choice(letters)]])
            found.append((a, "".join(b)))
    most = lambda a, b: int((1 - lines.SIMILARITY) * max(len(a), len(b)) + 1e-9)
    near = [len(a) > 1000 or distance(a, b) <= most(a, b) for a, b in found]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(found)], "i int, a string, b string")
    side = lambda x: lines.with_letters(df.select("i", F.col(x).alias("norm"), F.length(x).alias("size"))).drop(
        "norm").alias(x)
    left = {x.i for x in side("a").join(side("b"), "i").where(lines.like_letters("a", "b")).select("i").collect()}
    assert left >= {i for i, x in enumerate(near) if x} and 20 < sum(near) < len(found)


def test_words_of_a_line_are_parted_by_one_blank(spark):
    raw = ["A  b", " a b ", "a - b", "a-b", "-a\tb-", "a. b", "a .b", "  ", "--", "* *", "\u00a0a\u00a0\u00a0b\u00a0", "É,é", "漢 字。x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "doc_id long, text string")
    got = {x.at._fetch: x.norm for x in lines.lines_of(docs, "doc_id", 1).collect()}
    want = {i: " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) or t.strip() for i, t in enumerate(raw)}
    assert got == {i: t for i, t in want.items() if t}


# --- decontamination ---------------------------------------------------------------------


def test_benchmark_passages_are_found(spark):
    items = [(0, prose(40, 30)), (1, prose(41, 45)), (1, prose(41, 45)), (2, "three short words"), (3, None), (4, ""),
             (5, prose(42, 30)), (None, prose(43, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("m", F.lit(1))
    one = items[0][1].split(" ")
    found = [
        (1, prose(50, 200) + " " + items[0][1].upper() + " " + prose(51, 100)), (2, items[1][1].replace(" ", "\n")),
        (3, prose(52, 400)), (4, "and Three SHORT words here"), (5, None), (6, " "), (7, " ".join(one[:29])),
        (8, " ".join(one[:15]) + " " + prose(53, 15)), (9, " ".join(["zz", *one[1:]])), (None, items[5][1] if False else items[6][1]),
        (10, prose(54, 20_000, 9000) + " " + items[7][1]), (1, prose(55, 60)),
    ]
    docs = spark.createDataFrame(found, "doc_id long, text string").withColumn("start", F.lit("own"))
    out = {(r.doc_id, r.item_id): r for r in decontam.matches(docs, bench).collect()}
    assert set(out) == {(1, 0), (2, 1), (4, 2), (7, 0), (9, 0), (None, 5), (10, None)}
    assert out[(1, 0)].similarity == 1.0 and out[(1, 0)].start == 200 and out[(1, 0)].size == 26
    assert (out[(7, 0)].common, out[(7, 0)].total) == (25, 26)
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 5, 6, 8, 1])
    assert decontam.matches(empty(spark), bench).count() == 0
    assert decontam.without_leaks(docs, bench.limit(0)).count() == len(found)


def test_windows_reach_every_similar_one(spark):
    """Every window of the item's size whose similarity reaches the limit is matched."""
    r = random.Random(12)
    items = [(i, prose(60 + i, r.randrange(12, 60), 300)) for i in range(8)]
    found = []
    for d in range(80):
        w = r.choice(items)[1].split(" ")
        for _ in range(r.randrange(0, 3)):
            w[r.choice([0, 1, len(w) - 1, len(w) // 2])] = f"q{r.randrange(99)}"
        found.append((d, " ".join([prose(900 + d, r.randrange(0, 50), 300), *w, prose(950 + d, r.randrange(0, 50), 300)])))

    def grams(t):
        w = WORD.findall(t)
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    want = {}
    for d, t in found:
        g = grams(t)
        for i, it in items:
            h = Counter(grams(it))
            m = sum(h.values())
            best = max((sum((Counter(g[p:p + m]) & h).values()) / sum((Counter(g[p:p + m]) | h).values())
                        for p in range(len(g))), default=0)
            if 100 * best >= 80:
                want[(d, i)] = round(best, 9)
    out = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontam.matches(
        spark.createDataFrame(found, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out == want and len(want) > 20


def test_blocks_find_the_radius_and_select(spark):
    """Every pair within the radius exactly once; random fingerprints meet in a few pairs of a hundred."""
    r = random.Random(21)
    marks = [r.getrandbits(64) for _ in range(300)]
    near = [(x ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 24)))) for x in marks]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ours = spark.createDataFrame([(i, 7, signed(x)) for i, x in enumerate(near)], "a long, m int, fingerprint long")
    theirs = spark.createDataFrame([(i, 7, signed(x)) for i, x in enumerate(marks)], "b long, m int, mark long")
    got = [(x.a, x.b) for x in decontam.within_radius(ours, theirs.checkpoint()).collect()]
    want = {(i, j) for i, x in enumerate(near) for j, y in enumerate(marks) if (x ^ y).bit_count() <= decontam.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 150
    met = sum(((x >> 16 * k ^ y >> 16 * k) & 0xFFFF).bit_count() <= decontam.BLOCK_RADIUS
              for x in near for y in marks for k in range(decontam.BLOCKS))
    assert met < 0.1 * len(near) * len(marks) and len(decontam.PROBES) == 697


def test_common_weight_counts_repeats(spark):
    r = random.Random(22)
    pairs = [([r.randrange(6) for _ in range(r.randrange(0, 12))], [r.randrange(6) for _ in range(r.randrange(0, 12))])
             for _ in range(60)]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    both = decontam.common_weight(decontam.shingle_counts(F.col("a")), decontam.shingle_counts(F.col("b")))
    assert [x.n for x in df.select(both.alias("n")).collect()] == [
        sum((Counter(a) & Counter(b)).values()) for a, b in pairs]
