r"""Periodic runs of words, found in an enhanced suffix array.

The words of some hundred thousand words' worth of texts are numbered, each text with
numbers of its own and a separator that occurs nowhere else, and form one array.  Its
suffix array comes from prefix doubling (only classes with several members are sorted
again), the LCP values from the classes of each doubling round, undone one by one.
A repeat ww with \|w\| = d ends a run if the word after it breaks the period.  Such a
branching repeat shows in the LCP interval of depth d: the suffixes of all its child
intervals but the largest are tested for a partner d words to the right or to the left
whose place in the suffix array (ISA) lies in the same interval.  The repeats found are
rotated to the left as long as the period holds, and repeats of one run under several
multiples of its period are merged into it.  No suffix tree nodes are built: intervals
are arrays of bounds.

A run is a stretch of words with smallest period q, at least ``min_exponent`` periods
and ``min_length`` words long, that no neighbouring word extends.  A word goes from the
collapsed text if any run holds it after that run's first q words.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed
text; texts are whole however long (one text is one task's work, its arrays take some
hundred bytes a word); repeated rows each keep their row; an empty table gives an empty
table; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from stockroom.llm.common import drop_clashes

MIN_LENGTH = 6
MIN_EXPONENT = 4
# Words whose suffixes are sorted together; a longer text is sorted alone.
BATCH_WORDS = 400_000

RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])
OUTPUT = ("n_words", "runs", "collapsed")

Words = list[bytes]
Change = Callable[[int | None, Words], Words]


def class_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each element of a sorted array differs from the one before."""
    return np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SA, ISA, LCP) of an array whose last element occurs once; LCP[p] is that of SA[p-1] and SA[p]."""
    n = len(codes)
    pos = np.argsort(codes, kind="stable")
    first = np.flatnonzero(class_starts(codes[pos]))
    sizes = np.diff(np.r_[first, n])
    isa = np.empty(n, dtype=np.int64)
    isa[pos] = np.repeat(first, sizes)                  # a class is known by its first place
    active = pos[np.repeat(sizes > 1, sizes)]
    before, k = [], 1                                   # what each round changed
    while len(active):
        before.append((active, isa[active]))
        key = isa[active] * n + isa[active + k]
        order = np.argsort(key, kind="stable")
        pos, key = active[order], key[order]
        old = isa[pos]
        at = np.arange(len(pos))
        group = np.maximum.accumulate(np.where(class_starts(old), at, 0))
        split = class_starts(key)
        isa[pos] = old + np.maximum.accumulate(np.where(split, at, 0)) - group
        sizes = np.diff(np.r_[np.flatnonzero(split), len(pos)])
        active = pos[np.repeat(sizes > 1, sizes)]
        k *= 2
    sa = np.empty(n, dtype=np.int64)
    sa[isa] = np.arange(n)

    lcp = np.zeros(n, dtype=np.int64)
    ranks, live = isa.copy(), np.zeros(0, dtype=np.int64)
    for pos, old in reversed(before):
        k //= 2
        ranks[pos] = old                                # classes of the first k words again
        same = isa[pos]
        same = same[same != old]                        # not first in its class: shares k words with its neighbour
        new = same[lcp[same] == 0]
        if len(live):
            hit = live[ranks[sa[live - 1] + lcp[live]] == ranks[sa[live] + lcp[live]]]
            lcp[hit] += k
        lcp[new] = k
        live = np.r_[live, new]
    return sa, isa, lcp


def next_smaller(v: np.ndarray) -> np.ndarray:
    """For every place of ``v`` (its last element is 0) with a value above 0, the next
    place with a smaller value.

    Places jump together over what is known not to be smaller; the few that are left
    after some rounds walk on from right to left, over the final jumps of those behind."""
    nxt = np.arange(1, len(v) + 1)
    todo = np.flatnonzero(v > 0)
    todo = todo[v[nxt[todo]] >= v[todo]]
    for _ in range(40):
        if len(todo) < 200:
            break
        nxt[todo] = nxt[nxt[todo]]
        todo = todo[v[nxt[todo]] >= v[todo]]
    for x in todo[::-1].tolist():
        j, own = int(nxt[x]), v[x]
        while v[j] >= own:
            j = int(nxt[j])
        nxt[x] = j
    return nxt


def small_children(lcp: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(place in SA, depth, first, last) of every suffix in a child of an LCP interval
    that isn't the largest child; intervals with fewer than ``least`` suffixes are left out."""
    n = len(lcp)
    after = next_smaller(np.r_[lcp, 0])[:n]
    ahead = n - next_smaller(np.r_[lcp[::-1], 0])[:n][::-1] - 1
    cut = np.flatnonzero(lcp > 0)                       # every border between children of an interval
    cut = cut[after[cut] - ahead[cut] >= least]
    if not len(cut):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    key = ahead[cut] * (n + 1) + after[cut]
    order = np.argsort(key, kind="stable")
    cut, key = cut[order], key[order]
    head = class_starts(key)
    which = np.cumsum(head) - 1                         # interval of each border
    first, last, depth = ahead[cut[head]], after[cut[head]] - 1, lcp[cut[head]]
    # children of an interval: from its first place and from each of its borders
    n_children = len(cut) + len(first)
    start = np.empty(n_children, dtype=np.int64)
    owner = np.empty(n_children, dtype=np.int64)
    at_cut = np.arange(len(cut)) + which + 1
    at_first = np.flatnonzero(head) + np.arange(len(first))
    start[at_cut], owner[at_cut] = cut, which
    start[at_first], owner[at_first] = first, np.arange(len(first))
    end = np.r_[start[1:], 0]
    end[np.r_[at_first[1:] - 1, n_children - 1]] = last + 1
    size = end - start
    largest = np.flatnonzero(size == np.maximum.reduceat(size, at_first)[owner])
    largest = largest[class_starts(owner[largest])]     # one of them
    small = np.ones(n_children, dtype=bool)
    small[largest] = False
    start, size, owner = start[small], size[small], owner[small]
    total = np.cumsum(size)
    place = np.arange(total[-1]) + np.repeat(start - (total - size), size)
    owner = np.repeat(owner, size)
    return place, depth[owner], first[owner], last[owner]


def run_ends(codes: np.ndarray, min_exponent: int) -> list[tuple[int, int]]:
    """(end, period) of every repeat w^min_exponent whose next word breaks the period."""
    sa, isa, lcp = suffix_array(codes)
    place, depth, first, last = small_children(lcp, min_exponent)
    found = set()
    # the suffix tested starts the repeat's last copy of w (1) or the last but one (2)
    for back in (1, 2):
        end = sa[place] + back * depth
        ok = np.flatnonzero(end - min_exponent * depth >= 0)
        for copy in [x for x in range(1, min_exponent + 1) if x != back]:
            there = np.minimum(end[ok] - copy * depth[ok], len(codes) - 1)
            spot = isa[there]
            ok = ok[(spot >= first[ok]) & (spot <= last[ok])]
        ok = ok[codes[end[ok]] != codes[end[ok] - depth[ok]]]
        found.update(zip(end[ok].tolist(), depth[ok].tolist(), strict=True))
    return sorted(found)


def stretch(codes: np.ndarray, start: int, period: int) -> int:
    """Rotates to the left: the first place from which the period holds up to ``start``."""
    step = 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(codes[low:start] != codes[low + period:start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 4
    return 0


def runs_in(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array whose last element occurs once, by start and period."""
    out: list[tuple[int, int, int]] = []
    end_now, here = -1, []
    for end, period in run_ends(codes, min_exponent):
        if end != end_now:
            end_now, here = end, []
        # a multiple of the period of a run that holds the whole repeat ww
        if any(end - start >= 2 * period for start, _ in here):
            continue
        start = stretch(codes, end - min_exponent * period, period)
        here.append((start, period))
        if end - start >= min_length:
            out.append((start, end - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]


def runs_of_texts(texts: list[Words], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    total = int(sizes.sum())
    if not total:
        return found
    flat = np.empty(total, dtype=object)
    flat[:] = [w for words in texts for w in words]
    number, names = pd.factorize(flat)
    offset = np.cumsum(sizes + 1) - sizes - 1           # a separator after each text
    text_of = np.repeat(np.arange(len(texts)), sizes)
    codes = np.empty(total + len(texts), dtype=np.int64)
    codes[np.arange(total) + text_of] = text_of * len(names) + number
    codes[offset + sizes] = len(texts) * len(names) + np.arange(len(texts))
    for start, length, period in runs_in(codes, min_length, min_exponent):
        t = int(np.searchsorted(offset, start, side="right")) - 1
        found[t].append((start - int(offset[t]), length, period))
    return found


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT, change: Change | None = None) -> DataFrame:
    """The input columns plus n_words, runs (array of start, length, period, counted in
    words) and collapsed (the words left, joined by blanks) of every row.

    ``change(key, words)`` may put other words in place of a row's own."""
    df = drop_clashes(docs, *OUTPUT)
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("n_words", LongType(), False),
                         StructField("runs", ArrayType(RUN, False), False),
                         StructField("collapsed", StringType(), False)])
    run_type = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN.fields]))

    def out_of(batch: pa.RecordBatch, words: list[Words], runs: list) -> pa.RecordBatch:
        cols = [*batch.columns, pa.array([len(w) for w in words], pa.int64()),
                pa.array([[dict(zip(RUN.names, r, strict=True)) for r in found] for found in runs], run_type),
                pa.array([b" ".join(without_repeats(w, found)).decode("utf-8", "replace")
                          for w, found in zip(words, runs, strict=True)], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[*names, *OUTPUT])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(names.index(key)).to_pylist()
            values = batch.column(names.index(text))
            held, size, start = [], 0, 0
            for i in range(len(keys)):
                value = values[i].as_py()
                # blank, tab, LF, VT, FF and CR are the ASCII white space that bytes are split at
                words = value.encode("utf-8", "surrogatepass").split() if value else []
                held.append(change(keys[i], words) if change else words)
                size += len(held[-1])
                if size >= BATCH_WORDS or i + 1 == len(keys):
                    yield out_of(batch.slice(start, i + 1 - start), held, runs_of_texts(held, min_length, min_exponent))
                    held, size, start = [], 0, i + 1

    return df.mapInArrow(scan, schema)


# --- the query ------------------------------------------------------------------


def periodic_tail(key: int | None, words: Words) -> Words:
    """The contract's change: the words of one document in ten repeat from some place on.
    A row without a key keeps its words."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op13_documents(docs: DataFrame) -> DataFrame:
    found = find_runs(docs.select("doc_id", "text"), change=periodic_tail).drop("text")
    # greatest exact length / period first: compared by cross products
    best = F.reduce("runs", F.lit(None).cast(RUN), lambda b, r: F.when(
        b.isNull() | (r.length * b.period > b.length * r.period)
        | ((r.length * b.period == b.length * r.period)
           & ((r.start < b.start) | ((r.start == b.start) & (r.period < b.period)))), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return (found.withColumn("_best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
                    F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
                    F.expr("1000L * _best.length DIV _best.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
