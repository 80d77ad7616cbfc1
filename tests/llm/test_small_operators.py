"""Sharding, chat formatting, mixing, token counts and page text on small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import chat, html, mixing, sharding, tokens
from tests.llm.util import documents, empty, rows

# --- sharding -------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_with_inverse(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permute(p, n, inverse=True) == np.arange(n)).all()


def slow_place(r: int, n: int, seed: int) -> int:
    """The permutation in plain integers."""
    a, b = sharding.radix(n)

    def mixed(x, key):
        z = (x + key) % 2**64
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        return z ^ (z >> 31)

    while True:
        left, right = divmod(r, b)
        for i, key in enumerate(sharding.round_keys(seed)):
            if i % 2 == 0:
                left = (left + mixed(right, key)) % a
            else:
                right = (right + mixed(left, key)) % b
        r = left * b + right
        if r < n:
            return r


def test_shards_follow_row_numbers(spark):
    found = sharding.op1_documents(documents(spark)).collect()
    n = len(rows())
    assert sorted(r.row_number for r in found) == list(range(n))
    slots = defaultdict(list)
    for r in found:
        assert r.position == slow_place(r.row_number, n, sharding.SEED)
        assert (r.shard, r.slot) == (r.position % 16, r.position // 16) and r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    sizes = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == sizes


def test_shards_do_not_depend_on_partitions(spark):
    one = sharding.op1_documents(documents(spark).repartition(1)).select("doc_id", "text_crc32", "shard", "slot")
    many = sharding.op1_documents(documents(spark).repartition(7, "n_chars")).select(*one.columns)
    keyed = lambda df: Counter(map(tuple, df.collect()))
    assert keyed(one) == keyed(many)


def test_shard_keeps_columns_and_stored_order(spark, tmp_path):
    docs = documents(spark, extra=True)
    out = sharding.shard(docs)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "Slot", "position")] + [
        "row_number", "position", "shard", "slot"]
    assert out.count() == len(rows())
    documents(spark).orderBy(F.desc("n_chars"), "doc_id").write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    order = [r.row_number for r in sharding.shard(stored, stored_order=True).collect()]
    assert sorted(order) == list(range(len(rows())))
    chars = {r.row_number: r.n_chars for r in sharding.shard(stored, stored_order=True).collect()}
    seen = [chars[i] for i in range(len(rows())) if chars[i] is not None]
    assert seen == sorted(seen, reverse=True)
    assert sharding.op1_documents(empty(spark)).count() == 0


# --- chat -------------------------------------------------------------------------


CONVERSATIONS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_start|> <\\|x"), (1, 2, "assistant", "<|im_end|>\n"),
    (2, 0, "assistant", "too early"), (2, 1, "user", None), (3, 0, None, None), (4, 5, "user", "a"),
    (4, 5, "user", "a"), (4, 5, "assistant", ""), (None, 0, "user", "lost"), (5, 0, "odd\nrole\\<|", "é漢" * 5000),
    (6, 0, "user", "q"), (6, 1, "assistant", "r1"), (6, 2, "user", "q"), (6, 3, "assistant", "r2<"),
]


def conversations(spark, rows=CONVERSATIONS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_reads_back_what_was_written(spark):
    found = {r.conv_id: r for r in chat.op2_conversations(
        conversations(spark).withColumn("segments", F.lit(1))).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    turns = defaultdict(list)
    for c, t, role, text in [*CONVERSATIONS, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        turns[c].append((t, role or "", text or ""))
    assert set(found) == set(turns)
    for c, own in turns.items():
        own.sort()
        r = found[c]
        joined = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        formatted = "".join(s for _, role, text in own for s, _ in chat.render(role, text))
        assert r.formatted_chars == len(formatted)
        assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == len(own)
        assert chat.read_back(formatted) == [(role, text) for _, role, text in own]
    assert [found[c].valid for c in (1, 2, 3, 4, 6, -1)] == [True, False, False, False, True, True]
    assert found[2].error_turn == 0 and found[4].error_turn == 5


def test_chat_segments_and_empty(spark):
    out = chat.format_conversations(conversations(spark)).where("conv_id = 6").orderBy("position").collect()
    assert [r.state for r in out] == ["user", "assistant", "user", "assistant"]
    assert ["".join(s.text for s in r.segments if s.loss) for r in out] == ["", "r1", "", "r2<"]
    assert chat.conversation_digests(chat.format_conversations(conversations(spark, []))).count() == 0


@pytest.mark.parametrize("text", ["", "<", "|", "<|", "<\\|", "<\\\\|", "<<||", "\\<|", "<|im_end|>", "a<\\", "漢<|"])
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"


def test_long_conversation_in_one_stream(spark):
    many = spark.range(20_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role",
                                          "concat('t', id) as text")
    r = chat.conversation_digests(chat.format_conversations(many)).first()
    assert r.n_turns == 20_000 and r.valid
    want = "".join(f"t{i}" for i in range(1, 20_000, 2))
    assert r.loss_sha256 == hashlib.sha256(want.encode()).hexdigest()


# --- mixing -----------------------------------------------------------------------


def test_mixing_keeps_every_row_and_the_deviation(spark):
    docs = documents(spark, extra=True)
    out = mixing.mix(docs, block_rows=2, parts=12).collect()
    assert len(out) == len(rows())
    assert len({(r.slot, r.in_block) for r in out}) == len(out)
    parts = {r.source or "": r.parts for r in out}
    total = sum(parts.values())
    for r in out:
        assert r.release == r.block * total // r.parts and r.release <= r.slot < r.deadline
    # after t slots every source that still has blocks lies within one block of its share
    used = defaultdict(set)
    for r in out:
        used[r.source or ""].add(r.slot)
    for s, slots in used.items():
        for t in range(max(slots) + 1):
            assert abs(sum(x < t for x in slots) - t * parts[s] / total) < 1


def test_mixing_takes_given_targets(spark):
    targets = spark.createDataFrame([("a", 3), ("b", 1), ("zzz", 9)], "source string, parts int")
    out = mixing.mix(documents(spark), targets, block_rows=1).collect()
    assert {(r.source or "", r.parts) for r in out} == {("a", 3), ("b", 1), ("c", 1), ("", 1)}
    assert mixing.mix(empty(spark)).count() == 0
    ordered = mixing.in_mixed_order(documents(spark))
    assert ordered.columns == documents(spark).columns
    assert Counter(map(tuple, ordered.collect())) == Counter(map(tuple, documents(spark).collect()))


def test_period_is_a_full_schedule(spark):
    for parts in ([1], [1, 1], [5, 3, 2], [7, 1, 1, 1], [97, 2, 1], [13, 11, 7, 5, 3]):
        t = spark.createDataFrame([(f"s{i}", p) for i, p in enumerate(parts)], "_source string, _parts int")
        rows_ = mixing.period(t).collect()
        total = sum(parts)
        assert sorted(r["_at"] for r in rows_) == list(range(total))
        for r in rows_:
            k, a = r["_turn"], r["_parts"]
            assert k * total // a <= r["_at"] < -(-(k + 1) * total // a)


# --- token counts -------------------------------------------------------------------


ODD = ["<|endoftext|>a<|startoftext|>", "<|ENDOFTEXT|>", "aaaaaaaa", "ΑΣ ΣΑΣ", "İ ﬀ é", "x" * 3000, "don't I'LL",
       "a\x00b﻿", "日本語 👩‍👩‍👧 ٣٤", "!?" * 500, "tab\tnew\nline\u0085 end", "ſ K Å ẞ", "1234567"]


def test_token_counts_match_the_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(tokens.VOCABULARY))
    given = [t for _, t, *_ in rows()] + ODD
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(given)], "doc_id long, text string, N_tokens int")
    out = {r.doc_id: r for r in tokens.count_tokens(docs).collect()}
    for i, t in enumerate(given):
        want = len(library.encode(t, add_special_tokens=False).ids) if t else 0
        assert (out[i].n_tokens, out[i].n_bytes) == (want, len((t or "").encode())), t and t[:40]
        assert out[i].over_limit == (want > 2048)
    assert tokens.op10_documents(empty(spark)).count() == 0


def test_small_cache_changes_no_count(spark, monkeypatch):
    import public_tokenizers as P

    vocab = tokens.Vocabulary(P.path(tokens.VOCABULARY))
    words = [w for _, t, *_ in rows() if t for w in vocab.pre_tokens(t)[0]][:3000]
    together = vocab.count(words)
    assert together.tolist() == [int(vocab.count([w])[0]) for w in words[:300]] + together[300:].tolist()


# --- page text -----------------------------------------------------------------------


PAGES = {
    "": "", "plain  text": "plain text", "a<br>b<br><br>c": "a\nb\n\nc", "<p>one<p>two": "one\n\ntwo",
    "<div>a<div>b</div>c</div>": "a\nb\nc", "<b>bo</b>ld": "bold", "x<script>no</p></script>y": "xy",
    "<p hidden>no<p>yes": "yes", "<div style='display: none'>no</div>yes": "yes", "5 < 6 &amp; 7": "5 < 6 & 7",
    "<ul><li>a<li>b<ol start=9><li>x<li>y</ol></ul>": "- a\n- b\n  9. x\n  10. y",
    "<table><tr><td>ab<td>c<tr><td>d<td>ef</table>": "ab  c\nd   ef",
    "<table><td>1<td>2</table>": "1  2", "<table><tr><td colspan=2>wide<tr><td>a<td>b</table>": "wide\na  b",
    "<table><tr><td>x<br>y<td>z</table>": "x  z\ny", "<pre> a\n  b</pre>c": " a\n  b\n\nc",
    "<head><title>t</title></head><body>b": "b", "<!-- c --><!doctype x>t<!-- open": "t", "a</p>b": "a\n\nb",
    "<h1>h</h1>t": "h\n\nt", "<td>loose": "loose", "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<a href='x>y'>link</a> <img alt=no> end": "link end", "&nbsp;&copy;&#x41;&bogus;": " ©A&bogus;",
    "<p": "", "<textarea>\nraw  <b></textarea>": "raw  <b>", "<noscript>no</noscript>z": "z",
}


@pytest.mark.parametrize("page", sorted(PAGES))
def test_visible_text(page):
    assert html.visible_text(page) == PAGES[page]


HIDING = {
    '<p title="The hidden cost">a': "a", '<div class="nav hidden lg:block">a</div>': "a",
    "<div style='overflow: hidden !important'>a</div>": "a", "<p data-x=' hidden '>a": "a",
    "<button onclick=\"x.style.cssText='display:none'\">a</button>": "a", "<p aria-hidden=true>a": "a",
    "<p HIDDEN=''>no</p>a": "a", "<p style='color:red;DISPLAY : None!important;display:block'>no</p>a": "a",
    "<p style='display:none;display:block'>a": "a", "<p style='background:url(x;display:none)'>a": "a",
    "<p style='display:none;display:bogus'>no</p>a": "a", "<p style='/* display:none */'>a": "a",
    "<p hidden style='display:block'>a": "a", "<ol><li title='value=7'>a</ol>": "1. a",
    "<div style='visibility:hidden'>no<b style='visibility:visible'>a</b>no<i>no</i></div>": "a",
    "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>a</table>": "a",
    "<ul style='visibility:hidden'><li>no<li><span style='visibility:visible'>a</span></ul>": "a",
    "<dialog title='open'>no</dialog><dialog open>a</dialog>": "a",
}


@pytest.mark.parametrize("page", sorted(HIDING))
def test_only_what_hides_is_hidden(page):
    assert html.visible_text(page).strip() == HIDING[page]


SHOWN = {
    "<table><tbody>a<tr><td>b</table>": "a\nb", "<table><thead>a</thead><tfoot hidden>b</tfoot></table>": "ab",
    "x<svg><path d='M0'/><g><text x=1>a<tspan>b</tspan></text><title>no</title></g><text>c</text>no</svg>y": "x ab c y",
    "<svg><defs><text>no</text></defs><text display='none'>no</text><foreignObject><p>a</p></foreignObject></svg>": "a",
    "<svg><g visibility='hidden'><text>no</text><text visibility='visible'>a</text></g></svg>": "a",
    "<svg><style>.a > .b {}</style><text><![CDATA[a < b]]></text></svg>": "a < b", "<svg><rect><p>a": "a",
    "<svg/>a": "a", "f: <math><mi>x</mi> <mo>=</mo> <mn>2</mn><annotation>no</annotation></math>.": "f: x=2.",
    "<math display=block><semantics><mrow><mi>y</mi></mrow><annotation>no</annotation></semantics></math>a": "y\na",
    "<math><mtext> if <b>so</b> </mtext></math>": "if so",
    "<div>" * 600 + "<p hidden>" + "<b>no</b>" * 3 + "</p>a": "a",
    "<div>" * 255 + "<div hidden><p>no</p>no<div>no</div></div>a": "a",
}


@pytest.mark.parametrize("page", sorted(SHOWN))
def test_all_visible_text_is_there(page):
    assert html.visible_text(page).strip() == SHOWN[page]


def test_depth_changes_no_rule():
    for n in (10, 255, 256, 300, 5000):
        assert html.visible_text("<div>" * n + "<i hidden>no<b>no</b></i><ul><li>a<li>b</ul>c") == "- a\n- b\n\nc"
        assert html.visible_text("<table><tr><td>" * (n // 10) + "<i hidden>no</i>x").strip() == "x"
    assert html.visible_text("<ul><li>" * 300 + "x") == " " * 598 + "- x"


def test_deep_and_broken_pages():
    assert html.visible_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert html.visible_text("<table><tr><td>" * 400 + "x").strip() == "x"
    assert html.visible_text("<b>" * 5000 + "<p>a" * 5000).count("a") == 5000
    assert html.visible_text("<ul><li>" * 1000 + "x").strip().endswith("x")


def test_pages_table(spark):
    found = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "u", ""), (3, "u", "<p>é漢" * 50_000)]
    pages = spark.createDataFrame(found, "page_id long, url string, html string").withColumn("Text", F.lit(1))
    out = html.extract_text(pages)
    assert out.columns == ["page_id", "url", "html", "text"]
    got = Counter((r.page_id, r.text if r.page_id != 3 else r.text.count("漢")) for r in out.collect())
    assert got == Counter([(1, "a"), (1, "a"), (2, None), (None, ""), (3, 50_000)])
    assert html.op8_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("template", [
    chat.TEMPLATE,
    {"open": "[INST]", "after_role": ": ", "close": "[/INST]", "loss_roles": ("assistant",), "marks": ("[INST]", "[/INST]")},
    {"open": "### ", "after_role": "\n", "close": "\n<end>\n", "loss_roles": ("assistant",), "marks": ("# ", "<end>")},
    {"open": "<s>", "after_role": "|", "close": "</s>", "loss_roles": (), "marks": ("<s", "</")}])
def test_any_template_reads_back(template):
    import random
    chat.check_template(template)
    r = random.Random(4)
    bits = ["[INST]", "[/INST]", "[INS", "T]", "###", "#", " ", "<end>", "<s>", "</s>", "<|im_start|>", "<|", "|", "\\", "\\\\", "\n", ": ",
            ":", "u00003a", "n", "x", "é"]
    for _ in range(3000):
        turns = [("".join(r.choice(bits) for _ in range(r.randint(0, 5))), "".join(r.choice(bits) for _ in range(r.randint(0, 8))))
                 for _ in range(r.randint(1, 4))]
        formatted = "".join(s for role, text in turns for s, _ in chat.render(role, text, template))
        assert chat.read_back(formatted, template) == turns
        assert formatted.count(template["open"]) == len(turns)


@pytest.mark.parametrize("change", [{"marks": ("[[",)}, {"marks": ("<",)}, {"marks": ("<|", "|>|")}, {"after_role": ""}, {"open": "<|a", "close": "|a<|"}])
def test_templates_that_could_be_misread_are_refused(change):
    with pytest.raises(ValueError):
        chat.check_template({**chat.TEMPLATE, **change})
