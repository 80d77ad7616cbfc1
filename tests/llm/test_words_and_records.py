"""Spelling variants, token records and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import periodic, records, spelling
from stockroom.llm.queries import op11_spelling_variants, op12_token_records, op13_periodic_runs
from stockroom.session import scratch_path
from tests.llm.util import SF, WORD, documents, empty

CLASH = ["word", "n", "sig", "half", "root", "runs", "Collapsed", "n_words", "k", "t", "h", "path", "part", "ids"]


def clashing(df):
    return df.select("*", *[F.lit("own").alias(c) for c in CLASH])


def base_docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# --- periodic runs ------------------------------------------------------------------


def slow_runs(words, least=6, exponent=4):
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)        # smaller periods come first
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def slow_op13(key, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{length},{p}\n" for s, length, p in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_of_random_words(exponent):
    r = random.Random(exponent)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 4)):
            k = r.choice([1, 2, 2, 3, 6])
            w = [b"%d" % r.randrange(k) for _ in range(r.randint(0, 30))]
            unit = [b"%d" % r.randrange(k) for _ in range(r.randint(1, 6))]
            cut = r.randint(0, len(w))
            texts.append(w[:cut] + unit * r.choice([0, 2, 4, 7]) + unit[:r.randint(0, 3)] + w[cut:])
        assert periodic.runs_of_texts(texts, 6, exponent) == [slow_runs(w, 6, exponent) for w in texts]


def test_runs_of_very_long_texts():
    """Nested periods, neighbours that sort on either side of the run, one word throughout."""
    a, b, c = b"a", b"b", b"c"
    assert periodic.runs_of_texts([[a] * 60_000], 6, 4) == [[(0, 60_000, 1)]]
    texts = [[c] + [b] * 20_000 + [a], [a] + [b] * 20_000 + [c], ([a, a, b] * 9 + [c]) * 500 + [b]]
    found = periodic.runs_of_texts(texts, 6, 4)
    assert found[0] == [(1, 20_000, 1)] and found[1] == [(1, 20_000, 1)]
    assert (0, 14_000, 28) in found[2] and len(found[2]) == 501


def test_next_smaller():
    r = np.random.default_rng(7)
    for v in ([0], [0, 3, 2, 1, 0], [*range(500), 0], [0, 1, *range(600, 2, -1), 0], [*r.integers(0, 4, 3000), 0]):
        v = np.array(v)
        nxt = periodic.next_smaller(v)
        for i in np.flatnonzero(v > 0):
            assert nxt[i] == i + 1 + next(k for k, x in enumerate(v[i + 1:]) if x < v[i])


def test_op13_matches_brute_force(spark):
    got = {tuple(r) for r in op13_periodic_runs(spark, SF).collect()}
    want = [slow_op13(k, t) for k, t in base_docs(spark)]
    assert got == set(want) and any(w[1] for w in want)


def test_find_runs_on_odd_rows(spark):
    odd = [(1, None), (1, ""), (2, " \n "), (3, "x " * 9), (3, "x " * 9), (None, "y z " * 5 + "y"), (4, "é é é " * 4)]
    df = clashing(spark.createDataFrame(odd, "doc_id long, text string"))
    out = periodic.find_runs(df)
    assert [c for c in out.columns if c.lower() in periodic.OUTPUT] == list(periodic.OUTPUT)
    assert set(CLASH) - {"runs", "Collapsed", "n_words"} <= set(out.columns)
    rows = sorted(((r.text or "", [tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in out.collect()))
    assert rows == sorted([("", [], "", 0), ("", [], "", 0), (" \n ", [], "", 0), ("x " * 9, [(0, 9, 1)], "x", 9),
                           ("x " * 9, [(0, 9, 1)], "x", 9), ("y z " * 5 + "y", [(0, 11, 2)], "y z", 11),
                           ("é é é " * 4, [(0, 8, 2)], "é é é", 8)])
    assert sorted(map(str, periodic.op13_documents(documents(spark, extra=True)).collect())) == \
        sorted(str(r) for r in periodic.op13_documents(documents(spark)).collect())
    assert periodic.op13_documents(empty(spark)).count() == 0


# --- spelling variants ----------------------------------------------------------------


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return (len(b) == len(a) + 1 and a[k:] == b[k + 1:]) or (len(a) == len(b) and a != b and a[k + 1:] == b[k + 1:])


def slow_variants(counts):
    by = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, found in by.items():
        if found:
            best = min(found, key=lambda v: (-counts[v], v))
            if counts[best] >= 2 * counts[w]:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(by[w]), counts.get(form.get(w))))
    return out


def slow_counts(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def test_op11_matches_brute_force(spark):
    got = [tuple(r) for r in op11_spelling_variants(spark, SF).collect()]
    want = slow_variants(slow_counts(base_docs(spark)))
    assert len(got) == len(set(got)) and set(got) == want and any(w[1] for w in want)


@pytest.mark.parametrize("busy,parts", [(2_000, 8), (3, 8), (1, 3), (5, 4)])
def test_variants_of_crowded_words(spark, busy, parts):
    """Few letters, so that signatures hold many words: the split way gives the same pairs."""
    r = random.Random(busy)
    counts = {"".join(r.choice("aabéz") for _ in range(r.randint(5, 8))): r.choice([3, 4, 6, 8, 8, 16, 50]) for _ in range(500)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(x) for x in spelling.group_variants(words, parts, busy).collect()}
    assert got == slow_variants(counts)


def test_long_chains_end(spark):
    words = [("abcdefgh" + "x" * i, 3 * 2 ** (20 - i)) for i in range(15)]
    got = {r.word: r.root for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {"abcdefgh"}


def test_word_counts_of_odd_rows(spark):
    odd = [(1, None), (1, ""), (None, "straße STRASSE ÀÉÎÕÜ àéîõü x漢Motor motor_motor"), (2, "motor " * 3), (2, "motor " * 3)]
    df = clashing(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.word: r.n for r in spelling.count_words(df, min_count=1).collect()}
    assert got == {"straße": 1, "strasse": 1, "ÀÉÎÕÜ": 1, "àéîõü": 1, "motor": 9}
    assert spelling.op11_documents(empty(spark)).count() == 0
    plain, extra = (spelling.op11_documents(documents(spark, extra=x)).collect() for x in (False, True))
    assert sorted(map(str, plain)) == sorted(map(str, extra))


# --- token records --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(records.default_path())


def slow_op12(library, docs):
    out, start = [], 0
    for key, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op12_matches_the_library(spark, library):
    got = sorted(tuple(r) for r in op12_token_records(spark, SF).collect())
    assert got == slow_op12(library, sorted(base_docs(spark)))


def test_encoder_equals_the_library(library):
    r = random.Random(3)
    texts = ["", " ", "\n\n x  y\t\tz ", "it's we'll I'D 'S", "<|endoftext|> a<|endoftext|>", "漢字 ☃ é ²³¼ x\x1c\x85\xa0y",
             "٣٤ ℵ z", "a" * 5000, " " * 3000 + "x", "\x00\x01 ÿĀſ ƀ"]
    texts += ["".join(r.choice("ab \n\t'sé²7ÿ.-_\x85\xa0Āſ") for _ in range(r.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(map(chr, range(i, i + 64))) for i in range(0, 0x300, 64)]
    enc = records.Encoder(records.default_path())
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, enc.width).tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_records_of_odd_rows(spark, library):
    """Null, repeated and negative keys, small files, a shuffled read of the same records."""
    df = clashing(documents(spark))
    written = records.write_records(df, scratch_path(spark, "records"), file_bytes=2_000)
    got = records.read_records(spark, written).orderBy("start").collect()
    given = [(r.doc_id, r.text) for r in documents(spark).collect()]
    keys = [r.doc_id for r in got]
    assert keys == sorted((k for k, _ in given), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    want = Counter((k, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for k, t in given)
    ids = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got]
    assert Counter(ids) == want
    one, two = ([(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in
                 records.read_shuffled(spark, written, seed, 3).collect()] for seed in (1, 2))
    assert Counter(one) == Counter(two) == want and one != two and one != ids
    index = written.rows(spark)
    assert index.select("path").distinct().count() > 5
    assert records.op12_documents(empty(spark)).count() == 0
    assert records.read_shuffled(spark, records.write_records(empty(spark)), 1, 2).count() == 0


def test_damaged_records_are_found(spark):
    written = records.write_records(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"))
    files, path = records.open_files(written.rows(spark).first().path)
    data = files.open_input_file(path).readall()
    assert data == records.frame(data[12:-4])
    for at in (0, 9, 14, len(data) - 1):
        with files.open_output_stream(path) as out:
            out.write(data[:at] + bytes([data[at] ^ 4]) + data[at + 1:])
        with pytest.raises(Exception, match="wrong checksum"):
            records.read_records(spark, written).collect()
    for cut in (5, len(data) - 3):
        with files.open_output_stream(path) as out:
            out.write(data[:cut])
        with pytest.raises(Exception, match="cut off|wrong checksum"):
            records.read_records(spark, written).collect()
    with files.open_output_stream(path) as out:
        out.write(data + data)
    with pytest.raises(Exception, match="the index has"):
        records.read_records(spark, written).collect()

