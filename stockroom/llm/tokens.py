r"""Token counts by rank-synchronous merging of ragged arrays.

A batch of distinct pre-tokens is held as one flat numpy array of symbol ids
with the sequence of each symbol.  Each round looks up the rank of every
adjacent pair, takes each sequence's lowest rank and merges all of that pair's
occurrences in that sequence (left to right, not overlapping) at the same time;
sequences without a mergeable pair drop out.  The symbols that survive are the
tokens.  Texts are split with the vocabulary's own rules (NFC, white space to
blanks, lower case, letters / digits / other, bytes, word-end mark), and the
strings of its special tokens count as one token each, as the library has it.

The vocabulary is read where it lies (a path of the tokenizer's folder, a
parameter).  A task keeps the counts of pre-tokens it has met in a dictionary of
bounded size; what is not in there is merged again, so the bound changes no count.

Defined results: a null text has no bytes and no tokens; texts are whole however
long; repeated rows each keep their row; an empty table gives an empty table;
input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import drop_clashes

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
CACHE_WORDS = 400_000
OUTPUT = ("n_bytes", "n_tokens", "over_limit")

# Letters and case of these ranges depend on the Unicode version of the library
# that splits, so texts with such characters are split by the tokenizer's own library.
_BY_LIBRARY = regex.compile("[\u0800-\u2bff\u2c00-\u2fff\ua000-\uabff\ud7a4-\uffff\U00010000-\U0010ffff]")


def byte_symbols() -> list[str]:
    """Printable stand-in of every byte: itself where printable in Latin-1, else
    the next free code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [chr(b) for b in range(256)]
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        out[b] = chr(256 + i)
    return out


class Vocabulary:
    """Splitting rules and merge ranks of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.size = max(ids.values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        # a pair listed twice keeps its later rank
        last = {int(k): i for i, k in enumerate(keys)}
        ranks = np.array(list(last.values()), dtype=np.int64)
        order = np.argsort(keys[ranks])
        self.pair_keys, self.pair_ranks = keys[ranks][order], ranks[order]
        self.merged = merged
        end = model.get("end_of_word_suffix") or ""
        stand_in = byte_symbols()
        self.inner = np.array([ids.get(s, -1) for s in stand_in], dtype=np.int64)
        self.final = np.array([ids.get(s + end, -1) for s in stand_in], dtype=np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.path, self.library, self.byte_of = path, None, {c: b for b, c in enumerate(stand_in)}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of special strings in it."""
        parts = self.special.split(text) if self.special else [text]
        out: list[str] = []
        for part in parts:
            if _BY_LIBRARY.search(part):
                out += self.split_by_library(part)
                continue
            # lower case is per code point: a final sigma stays a plain one
            normal = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += self.split.findall(normal)
        return out, len(parts) - 1

    def split_by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(self.byte_of[c] for c in piece).decode("utf-8") for piece, _ in pieces]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word: symbols left when no pair can be merged."""
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.int64)
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(b) for b in raw], dtype=np.int64)
        owner = np.repeat(np.arange(n), sizes)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        ends = ends[sizes > 0]
        symbols[ends] = self.final[data[ends]]
        known = symbols >= 0                        # bytes without a symbol are dropped, as by the library
        symbols, owner = symbols[known], owner[known]
        counts = np.zeros(n, dtype=np.int64)
        none = len(self.merged)
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where((self.pair_keys[at] == key) & (owner[:-1] == owner[1:]), self.pair_ranks[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            per_symbol = np.repeat(lowest, lengths)
            going = per_symbol < none
            finished = lowest >= none
            counts[owner[starts[finished]]] = lengths[finished]
            hit = np.r_[(rank == per_symbol[:-1]) & going[:-1], False]
            # a run of overlapping hits (aaaa) merges every other pair from its left end
            run_start = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            index = np.arange(len(hit))
            since = index - np.r_[0, run_start][np.searchsorted(run_start, index, side="right")]
            hit &= since % 2 == 0
            symbols[hit] = self.merged[per_symbol[hit]]
            keep = going & ~np.r_[False, hit[:-1]]
            symbols, owner = symbols[keep], owner[keep]
        return counts


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column (null: none)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path or default_path())
        known: dict[str, int] = {}
        for texts in batches:
            out = np.zeros(len(texts), dtype=np.int64)
            # some megabytes of text at a time, so that the arrays stay small
            start, held, size = 0, [], 0
            for i, text in enumerate(texts):
                tokens, special = vocab.pre_tokens(text) if text else ([], 0)
                out[i] = special
                held.append(tokens)
                size += len(tokens)
                if size >= 1_000_000 or i + 1 == len(texts):
                    new = list({w for words in held for w in words if w not in known})
                    if len(known) + len(new) > CACHE_WORDS:
                        known = {}
                        new = list({w for words in held for w in words})
                    known.update(zip(new, vocab.count(new).tolist(), strict=True))
                    for j, words in enumerate(held, start):
                        out[j] += sum(map(known.__getitem__, words))
                    start, held, size = i + 1, [], 0
            yield pd.Series(out)

    return count(text)


def count_tokens(docs: DataFrame, text: str = "text", limit: int = TOKEN_LIMIT,
                 path: str | None = None) -> DataFrame:
    """The input columns plus n_bytes, n_tokens and over_limit of every row."""
    df = drop_clashes(docs, *OUTPUT) if {c.lower() for c in docs.columns} & set(OUTPUT) else docs
    return (df.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
            .withColumn("n_tokens", token_count(F.col(text), path))
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))


def op10_documents(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text")).drop("text")
