"""Toxic passages by maximum-scoring segments of token log-odds.

Learning: for each token (runs of letters or digits, lower case) the labelled
training texts with it are counted exactly, toxic and clean, every distinct text
once.  A token's score is its log-odds under Dirichlet priors of PRIOR texts a token,
shared by the classes' sizes (no odds of its own; so have unseen tokens none), drawn towards zero by CAUTION standard errors, so what a text or two say
counts for little; every token also pays DRIFT, which makes the expected score
negative.  Tokens whose odds the caution leaves at zero all score -DRIFT; the others
are sent to the tasks up to BROADCAST_TOKENS of them, else joined to the texts' tokens.

Search: all maximal scoring segments of a text come from one pass over its tokens
(Ruzzo and Tompa; linked candidates, none passed twice).  Under the
extreme-value law a clean text of n tokens has K n exp(-lambda s) segments of sum
s or more; lambda solves the moment equation of the clean tokens and K is the
clean texts' rate of such segments.  A segment is significant when its expected
number in a clean text of that length is at most SIGNIFICANT.

A document's statistic adds up, over its segments, how far each lies beyond one
expected occurrence (in nats).  Its score is the share of toxic texts among
training texts of that statistic, monotone, where a training text's statistic
comes from the log-odds of the other half of the texts.  Scores depend on the
text alone.

Defined results: a null or empty text has no segment and the lowest score; without
toxic or without clean training texts every score is 0; texts with contradicting
labels are not learned from, repeated label rows and copies count once; equal
texts have equal scores; an empty table gives an empty table; only the key and
text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from stockroom.session import ensure_checkpoint_dir

PRIOR = 1.0
CAUTION = 1.5
DRIFT = 0.4
FIT_AT = 4.0
SIGNIFICANT = 0.05
THRESHOLD = 0.7
LEVELS = 128                    # histogram levels of the statistic, a quarter nat each
# Training keys are broadcast up to this many, else joined.
BROADCAST_KEYS = 1_000_000
# Tokens with odds likewise.
BROADCAST_TOKENS = 300_000
TOKEN = re.compile(r"[^\W_]+")


def held_out(key: Column) -> Column:
    """The contract's held-out third: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def with_keys(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), key)


def training(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(text, toxic, fold): every distinct labelled text outside the held-out third."""
    ensure_checkpoint_dir(docs.sparkSession)
    said = (labels.where("toxic is not null").where(~held_out(F.col(key)))
            .select(F.col(key).cast("long").alias("_key"), F.col("toxic").cast("int").alias("toxic")).checkpoint())
    texts = docs.select(F.col(key).cast("long").alias("_key"), "text").where(F.length("text") > 0)
    copies = with_keys(texts.select("_key", F.xxhash64("text").alias("hash")), said.distinct(), "_key")
    chosen = (copies.groupBy("hash").agg(F.min("_key").alias("_key"), F.min("toxic").alias("toxic"),
                                         F.max("toxic").alias("_most"))
              .where("toxic = _most").select("_key", "hash", "toxic").checkpoint())
    return (with_keys(texts, chosen, "_key").where(F.xxhash64("text") == F.col("hash"))
            .select("text", "toxic", F.pmod("hash", F.lit(2)).cast("int").alias("fold")))


PARTS = ["clean0", "toxic0", "clean1", "toxic1"]      # class and fold


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, clean0, toxic0, clean1, toxic1): training texts with each token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter() for _ in PARTS]
            for text, toxic, fold in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                found[2 * fold + (toxic == 1)].update(set(tokens_of(text)))
            for part, counts in enumerate(found):
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(counts), pa.string()), pa.array(np.full(len(counts), part), pa.int64()),
                    pa.array(list(counts.values()), pa.int64())], ["token", "part", "n"])

    return (rows.mapInArrow(count, "token string, part long, n long").groupBy("token")
            .agg(*[F.sum(F.when(F.col("part") == i, F.col("n")).otherwise(0)).alias(x) for i, x in enumerate(PARTS)]))


def log_odds(clean: Column, toxic: Column, n_clean: float, n_toxic: float, tokens: int) -> Column:
    """The cautious log-odds of a token, less DRIFT; unseen ones share the prior."""
    both = max(1.0, n_clean + n_toxic)
    a_clean, a_toxic = max(n_clean / both, 1e-9) * PRIOR, max(n_toxic / both, 1e-9) * PRIOR
    p_toxic = (toxic + F.lit(a_toxic)) / F.lit(n_toxic + a_toxic * tokens)
    p_clean = (clean + F.lit(a_clean)) / F.lit(n_clean + a_clean * tokens)
    odds = F.log(p_toxic / (1 - p_toxic)) - F.log(p_clean / (1 - p_clean))
    error = F.sqrt(1 / (toxic + F.lit(a_toxic)) + 1 / (clean + F.lit(a_clean)))
    return F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - CAUTION * error) - DRIFT


class Scores:
    """Scores of the tokens that have odds, by all texts and by either fold's; a token
    not in the table scores -DRIFT."""

    NAMES = ["both", "fold0", "fold1"]

    def __init__(self, table: DataFrame):
        self.table = table                            # token, both, fold0, fold1; written
        self.sent = None
        if table.count() <= BROADCAST_TOKENS:
            got = table.toArrow()
            index = {w: i for i, w in enumerate(got.column("token").to_pylist(), 1)}
            values = np.array([[-DRIFT, *got.column(x).to_pylist()] for x in self.NAMES])
            self.sent = table.sparkSession.sparkContext.broadcast((index, values))

    def of_texts(self, rows: DataFrame, body, schema: str) -> DataFrame:
        """``body(row, values)`` of every row (its text last) as rows of ``schema``;
        ``values`` holds the scores of the text's tokens, [name, token]."""
        sent, names, kept = self.sent, self.NAMES, rows.columns[:-1]
        types = rows.select(*kept).schema
        arrow = to_arrow_schema(StructType.fromDDL(schema))

        def emit(out: list[dict], like: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=like)

        if sent is not None:
            def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                index, values = sent.value
                for batch in batches:
                    out = []
                    for *row, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                        tokens = tokens_of(text)
                        at = np.fromiter(map(index.get, tokens, repeat(0)), dtype=np.int64, count=len(tokens))
                        out.append(body(row, values[:, at]))
                    yield emit(out, arrow)

            return rows.mapInArrow(search, schema)

        spread = StructType(types.fields).add("_row", "long").add("_n", "long").add("_token", "string").add(
            "_at", ArrayType(LongType()))
        wide = to_arrow_schema(spread)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for *row, number, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    tokens, places = tokens_of(text), {f" {number}": []}      # no token, but keeps the text
                    for i, w in enumerate(tokens):
                        places.setdefault(w, []).append(i)
                    yield emit([dict(zip(kept, row, strict=True)) | {
                        "_row": number, "_n": len(tokens), "_token": w, "_at": at} for w, at in places.items()], wide)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for *row, n, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    values = np.full((len(names), n), -DRIFT)
                    for x in found:
                        for k, name in enumerate(names):
                            values[k, x["_at"]] = x[name]
                    out.append(body(row, values))
                yield emit(out, arrow)

        numbered = rows.select(*kept, F.monotonically_increasing_id().alias("_row"), rows.columns[-1])
        met = (numbered.mapInArrow(split, spread)
               .join(self.table.withColumnRenamed("token", "_token").hint("shuffle_hash"), "_token", "left")
               .where(F.col("_token").startswith(" ") | F.col("both").isNotNull()).groupBy(*kept, "_row", "_n")
               .agg(F.collect_list(F.when(F.col("both").isNotNull(), F.struct("_at", *names))).alias("_found")))
        return met.select(*kept, "_n", "_found").mapInArrow(gather, schema)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), left to right, disjoint.

    Positive tokens arrive one by one as candidates; a candidate that the last
    smaller left sum lets grow is merged with what lies between.  Each keeps a link to
    that last one, so no candidate is passed twice."""
    stack: list[list] = []           # [start, end, sum before, sum through, link]
    sums = np.cumsum(scores, dtype=np.float64)
    for i in np.flatnonzero(scores > 0):
        before, through = float(sums[i] - scores[i]), float(sums[i])
        seg = [int(i), int(i) + 1, before, through]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append([*seg, j])
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            at, j = j, stack[j][4]
            del stack[at:]
    return [(a, b, y - x) for a, b, x, y, _ in stack]


def clean_rate(counts: np.ndarray, scores: np.ndarray) -> float:
    """lambda: the positive root of E[exp(lambda * score)] = 1 over clean tokens."""
    p = counts / max(1.0, counts.sum())
    low, high = 1e-3, 1.0
    value = lambda x: float((p * np.exp(x * scores)).sum())
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return (low + high) / 2


class Model:
    """Extreme-value parameters and the calibration table."""

    def __init__(self, rate: float, k: float = 1.0):
        self.rate, self.k = rate, k
        self.table = np.zeros(LEVELS)

    def statistic(self, sums: list[float], tokens: int) -> float:
        """Nats beyond one expected occurrence, over all segments of a text."""
        once = np.log(max(1e-12, self.k * max(1, tokens)))
        return float(sum(max(0.0, self.rate * s - once) for s in sums))

    def score(self, statistic: float) -> float:
        x = min(4.0 * statistic, LEVELS - 1.0)
        i = min(int(x), LEVELS - 2)
        return float(self.table[i] + (self.table[i + 1] - self.table[i]) * (x - i))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[Model, Scores]:
    rows = training(docs, labels, key)
    counts = token_counts(rows).checkpoint()
    sums = counts.agg(*[F.sum(x).alias(x) for x in PARTS], F.count(F.lit(1)).alias("tokens")).first()
    n = {x: float(sums[x] or 0) for x in PARTS}
    c = {x: F.col(x).cast("double") for x in PARTS}
    tokens = sums["tokens"] + 1                                          # the unseen ones are one more
    # a text is searched with what the other half of the texts says
    table = counts.select(
        "token", (F.col("clean0") + F.col("clean1")).alias("clean"),
        log_odds(c["clean0"] + c["clean1"], c["toxic0"] + c["toxic1"], n["clean0"] + n["clean1"],
                 n["toxic0"] + n["toxic1"], tokens).alias("both"),
        log_odds(c["clean1"], c["toxic1"], n["clean1"], n["toxic1"], tokens).alias("fold0"),
        log_odds(c["clean0"], c["toxic0"], n["clean0"], n["toxic0"], tokens).alias("fold1"))
    told = " or ".join(f"{x} <> {-DRIFT}D" for x in Scores.NAMES)
    if not n["clean0"] + n["clean1"] or not n["toxic0"] + n["toxic1"]:
        return Model(1.0), Scores(table.where("false").select("token", *Scores.NAMES))
    scores = Scores(table.where(told).select("token", *Scores.NAMES).checkpoint())
    levels = table.groupBy(F.round("both", 3).alias("s")).agg(F.sum("clean").alias("n")).toArrow()   # some thousands
    rate = clean_rate(levels.column("n").to_numpy().astype(float), levels.column("s").to_numpy())

    def search(row: list, values: np.ndarray) -> dict:
        toxic, fold = row
        return {"toxic": int(toxic == 1), "tokens": values.shape[1],
                "sums": [x for _, _, x in maximal_segments(values[1 + fold])]}

    found = scores.of_texts(rows.select("toxic", "fold", "text"), search,
                            "toxic long, tokens long, sums array<double>").checkpoint()
    # K: clean texts have segments of lambda * sum >= FIT_AT as often as K n exp(-FIT_AT) says
    seen = found.where("toxic = 0").agg(F.sum(F.size(F.filter("sums", lambda s: s * rate >= FIT_AT))).alias("x"),
                                        F.sum("tokens").alias("n")).first()
    k = (seen["x"] + 0.5) / (max(1, seen["n"]) * float(np.exp(-FIT_AT)))
    model = Model(rate, k)
    once = F.log(F.lit(k) * F.greatest(F.col("tokens"), F.lit(1)))
    nats = F.aggregate(F.transform("sums", lambda s: F.greatest(F.lit(0.0), s * rate - once)), F.lit(0.0),
                       lambda acc, x: acc + x)
    level = F.least(4.0 * nats, F.lit(LEVELS - 1.0)).cast("int").alias("level")
    hist = np.zeros((2, LEVELS))
    for r in found.groupBy("toxic", level).count().collect():            # 2 * LEVELS rows at most
        hist[r["toxic"], r["level"]] += r["count"]
    model.table = monotone(hist)
    return model, scores


def monotone(hist: np.ndarray) -> np.ndarray:
    """Non-decreasing share of toxic texts per level (pool adjacent violators).

    A level without texts takes the level below; above the highest level seen, the
    share of that one."""
    n = hist.sum(axis=0)
    blocks: list[list[float]] = []
    for bad, w in zip(hist[1], n, strict=True):
        # nothing seen: no say of its own, so it joins the block below
        blocks.append([bad / w if w else 0.0, w, 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][0] >= blocks[-1][0]):
            v2, w2, c2 = blocks.pop()
            v1, w1, c1 = blocks.pop()
            total = w1 + w2
            blocks.append([(v1 * w1 + v2 * w2) / total if total else 0.0, total, c1 + c2])
    return np.concatenate([np.full(int(c), v) for v, _, c in blocks])


def toxicity(docs: DataFrame, learned: tuple[Model, Scores], key: str = "doc_id") -> DataFrame:
    """Per row: key, score and the significant segments (first and last token, score,
    expected number in a clean text of the same length)."""
    m, scores = learned

    def search(row: list, values: np.ndarray) -> dict:
        n, parts = values.shape[1], maximal_segments(values[0])
        expected = [m.k * n * float(np.exp(-m.rate * x)) for _, _, x in parts]
        return {"doc_id": row[0], "score": m.score(m.statistic([x for _, _, x in parts], n)),
                "segments": [{"start": a, "stop": b, "sum": x, "expected": e}
                             for (a, b, x), e in zip(parts, expected, strict=True) if e <= SIGNIFICANT]}

    return scores.of_texts(
        docs.select(F.col(key).cast("long").alias("doc_id"), "text"), search,
        "doc_id long, score double, segments array<struct<start: long, stop: long, sum: double, expected: double>>")


def op4_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                         F.size("segments").alias("n_segments"))
