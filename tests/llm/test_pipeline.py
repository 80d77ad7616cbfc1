"""The pipeline against a plain reimplementation, and every query with SQL against it."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from stockroom.llm import decontam, mixing, quality, sharding
from stockroom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_small_operators import slow_place
from tests.llm.test_text_operators import slow_components, slow_measures
from tests.llm.util import SF, WORD, documents, empty, labels
from tools.compare import TABLES, digest

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def grams(text, width):
    w = WORD.findall((text or "").lower())
    return Counter(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def leaks(text, items):
    w = WORD.findall((text or "").lower())
    for item in items:
        own = WORD.findall((item or "").lower())
        if not own:
            continue
        k = min(5, len(own))
        want, mine = grams(item, k), [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
        m = sum(want.values())
        if not any(g in want for g in mine):
            continue
        for p in range(len(mine)):
            have = Counter(mine[p:p + m])
            if 100 * sum((have & want).values()) >= 80 * sum((have | want).values()):
                return True
    return False


def slow_order(docs):
    """The Pfair schedule slot by slot: sources' blocks by earliest deadline."""
    by = defaultdict(list)
    for d in docs:
        by[d.source or ""].append(d)
    spread = lambda i: i % 2147483647 * 48271 % 2147483647 % mixing.SOURCE_BUCKETS
    roots = {s: len(x) ** 0.5 for s, x in by.items()}
    parts = {s: max(1, int(mixing.PARTS * r / sum(roots.values()) + 0.5)) for s, r in roots.items()}
    total, blocks = sum(parts.values()), {}
    for s, x in by.items():
        x.sort(key=lambda d: (spread(d.doc_id), d.doc_id))
        blocks[s] = [x[i:i + mixing.BLOCK_ROWS] for i in range(0, len(x), mixing.BLOCK_ROWS)]
    out, done, t = [], dict.fromkeys(sorted(by), 0), 0
    while any(done[s] < len(blocks[s]) for s in done):
        ready = [(-(-(done[s] + 1) * total // parts[s]), s) for s in done if done[s] * total // parts[s] <= t]
        _, s = min(ready)
        if done[s] < len(blocks[s]):
            out += blocks[s][done[s]]
        done[s] += 1
        t += 1
    return out


@needs_data
def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    said = spark.read.parquet(f"{SF}/labels.parquet")
    cutoffs = quality.certified_cutoffs(quality.narrow_measures(spark.read.parquet(f"{SF}/documents.parquet")), said).count()
    assert cutoffs == 0                      # too few labels here; the certified case is tested on its own
    good = []
    for d in docs:
        n_words, _, _, _, repeats = slow_measures(d.text)
        if not (n_words < 50 or 100 * repeats > 50 * n_words):
            good.append(d)
    good.sort(key=lambda d: d.doc_id)
    _, roots = slow_components([d.text for d in good], 5, 80)
    one = [d for i, d in enumerate(good) if roots[i] == i]
    clean = [d for d in one if not leaks(d.text, items)]
    want = [d.doc_id for d in slow_order(clean)]
    out = corpus_pipeline.run(spark, SF).collect()
    n = len(want)
    assert sorted(r.row_number for r in out) == list(range(n))
    assert [r.doc_id for r in sorted(out, key=lambda r: r.row_number)] == want
    for r in out:
        place = slow_place(r.row_number, n, sharding.SEED)
        assert (r.position, r.shard, r.slot) == (place, place % sharding.SHARDS, place // sharding.SHARDS)
    text = {d.doc_id: d for d in docs}
    assert all((r.text, r.lang, r.source, r.n_chars) == text[r.doc_id][1:] for r in out)


@needs_data
def test_stages_bear_odd_tables(spark, tmp_path):
    """Each stage on nulls, blanks, copies, clashing columns and no rows at all."""
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    folder = str(tmp_path / "tables")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    for name, given in (("odd", documents(spark, extra=True)), ("none", empty(spark))):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{i}")
            given.write.parquet(path)
            docs = spark.read.parquet(path)
            out = stage(spark, docs, folder)
            if i < 4:
                assert out.columns == docs.columns
            else:
                assert set(out.columns) >= set(docs.columns) - {"Slot"} | {"slot", "shard"}
            if name == "none":
                assert out.count() == 0
            if i >= 3:
                assert out.count() == docs.count()


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE_SQL[name])
    cols, want = [d[0] for d in res.description], res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, want)[0]


def test_every_query_is_there():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert decontam.SQL and set(ORACLE_SQL) <= set(QUERIES)
