r"""Spelling variants grouped: words one edit apart, found by PartEnum signatures.

The letters of a word form a multiset, taken as a binary vector with a place for every
copy of every letter.  One inserted or deleted letter moves the vector by Hamming
distance one, one replaced letter by two.  PartEnum for distance two with one first-level
partition: the letters are dealt into ``PARTS`` parts, and for every choice of two parts
the vector's projection on the other parts is a signature.  Two vectors within distance
two differ in at most two parts, so they agree in the signature that leaves these out.
Words are joined on equal signatures and verified: exactly one edit between them.

A signature held by more than ``BUSY`` words is split exactly: of two words one edit
apart, the shorter (or either) with m letters, the first or the last m // 2 letters agree,
so the words of such a signature meet on signature, m, side and half.

The form of a word is its most frequent near word if that is ``MIN_RATIO`` times as
frequent; its root is where the forms end (each is more frequent than the one before, so
there are no circles).

Defined results: null, empty and blank texts have no words; repeated rows count again; a
row without a key counts like any other; ties between forms go to the smaller word in code-point order;
an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import few
from stockroom.session import ensure_checkpoint_dir

MIN_LETTERS = 5
MIN_COUNT = 3
MIN_RATIO = 2
PARTS = 8
# Words of a signature above which it is split; either way gives the same pairs.
BUSY = 2_000
# Busy signatures up to which they are broadcast, above it joined by a shuffle.
BUSY_BROADCAST = 200_000
# Distinct words a task holds before it passes its counts on.
HELD_WORDS = 400_000

# One byte a code point: other characters become '?', and lower() knows A-Z alone.
_ONE_BYTE = ("latin-1", "replace")

Change = Callable[[int | None, bytes], bytes]


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", min_letters: int = MIN_LETTERS,
                min_count: int = MIN_COUNT, change: Change | None = None) -> DataFrame:
    """(word, n) of the maximal runs of letters (ASCII and U+00C0 to U+00FF), A-Z in lower case.

    ``change(key, run)`` may put another word (Latin-1 bytes) in place of all runs
    of one text that are equal to ``run``."""
    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % min_letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = run.findall((value.as_py() or "").encode(*_ONE_BYTE).lower())
                if change:
                    for w, n in Counter(found).items():
                        held[change(k, w)] += n
                else:
                    held.update(found)
                if len(held) > HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    counts = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(count, "word string, n long")
    return (counts.where(F.length("word") >= min_letters).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def letter_parts(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters dealt over ``parts`` parts by falling frequency, so that all parts
    hold about as many.  The letters are few: the alphabet, not the words, bounds the list."""
    counts = (words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
              .groupBy("letter").count().orderBy(F.desc("count"), "letter").collect())
    out = [""] * parts
    for i, row in enumerate(counts):
        turn, at = divmod(i, parts)
        out[at if turn % 2 == 0 else parts - 1 - at] += row.letter
    return out


def signatures(words: DataFrame, parts: list[str]) -> DataFrame:
    """The rows of ``words`` once for every signature (``sig``, a hash)."""
    ordered = F.array_join(F.sort_array(F.split("word", "")), "")
    left_out = [a + b for a, b in combinations(parts, 2)]
    sigs = F.array(*[F.xxhash64(F.lit(i), F.translate(F.col("_letters"), out, "")) for i, out in enumerate(left_out)])
    return words.withColumn("_letters", ordered).select(*words.columns, F.explode(sigs).alias("sig"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether exactly one code point is inserted, deleted or replaced between the two."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def halves(rows: DataFrame) -> DataFrame:
    """Keys of which two words one edit apart share one: for m the shorter one's length,
    its first or last m // 2 letters.  A word has m its own length and one less."""
    n = F.length("word")
    keys = F.array(*[F.xxhash64(F.lit(side), m, F.substring("word", start, F.floor(m / 2).cast("int")))
                     for m in (n, n - 1)
                     for side, start in ((0, F.lit(1)), (1, (n - F.floor(m / 2) + 1).cast("int")))])
    return rows.withColumn("half", F.explode(keys))


def near_words(words: DataFrame, parts: int = PARTS, busy: int = BUSY) -> DataFrame:
    """(word, near, n, near_n) of every ordered pair of words one edit apart; ``words``
    (word, n) should be written."""
    ensure_checkpoint_dir(words.sparkSession)
    sigs = signatures(words, letter_parts(words, parts))
    crowded, n_crowded = few(sigs.groupBy("sig").count().where(F.col("count") > busy).select("sig").checkpoint(),
                             BUSY_BROADCAST)

    def meet(rows: DataFrame, keys: list[str]) -> DataFrame:
        a = rows.select(*keys, F.col("word").alias("a"), F.col("n").alias("na"))
        b = rows.select(*keys, F.col("word").alias("b"), F.col("n").alias("nb"))
        return (a.join(b, [F.col("a") < F.col("b"), *[a[k] == b[k] for k in keys], one_edit(F.col("a"), F.col("b"))])
                .select("a", "b", "na", "nb"))

    if n_crowded:
        pairs = (meet(sigs.join(crowded, "sig", "left_anti"), ["sig"])
                 .union(meet(halves(sigs.join(crowded, "sig", "left_semi")), ["sig", "half"])))
    else:
        pairs = meet(sigs, ["sig"])
    # a pair agrees in several signatures if its words differ in one part alone
    pairs = pairs.distinct()
    ways = [F.struct(*[F.col(c).alias(name) for c, name in zip(way, ("word", "near", "n", "near_n"), strict=True)])
            for way in (("a", "b", "na", "nb"), ("b", "a", "nb", "na"))]
    return pairs.select(F.inline(F.array(*ways)))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain word -> form ends.  Each round doubles the steps
    taken and is written to the checkpoint folder; chains of k steps take log k rounds."""
    ensure_checkpoint_dir(forms.sparkSession)
    at = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                     F.col("further").isNotNull().alias("_moved")).checkpoint()
        at = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            return at


def group_variants(words: DataFrame, parts: int = PARTS, busy: int = BUSY, min_ratio: int = MIN_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n)."""
    ensure_checkpoint_dir(words.sparkSession)
    words = words.select("word", "n").checkpoint()
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    found = (near_words(words, parts, busy).groupBy("word", "n")
             .agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).checkpoint())
    frequent = -F.col("best.less") >= min_ratio * F.col("n")
    forms = (found.where(frequent).select("word", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    return (words.join(found.select("word", "n_near"), "word", "left").join(forms, "word", "left")
            .join(roots(forms), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


# --- the query ------------------------------------------------------------------


def lost_letter(key: int | None, run: bytes) -> bytes:
    """The contract's change: some words of some documents lose a letter."""
    utf8 = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(utf8, zlib.crc32(b":" if key is None else b"%d:" % key))
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def op11_documents(docs: DataFrame) -> DataFrame:
    return group_variants(count_words(docs, change=lost_letter))
