"""Prefix counts against the tokenizer itself."""

import random

import pytest
from tokenizers import Tokenizer

from sievework.llm import catalog, token_counts

SF = "/root/testdata/sf0.001"
#: Pieces of text at which words, merges and special tokens begin and end.
PARTS = [
    " ", "  ", "\n", "\t", "'", "'re", "'ll", "'s", "a", "b", "the", "ing", "ſ", "é", "0", "12", "!", "...", "<|endoftext|>", "<|endof",
    "　", "日本", "՘", "👩‍🚀", "\xa0", "\x1c", "\x85", "ll", "re", "aaaa", "====", "\r\n", "Ø", "x",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(catalog.token_files()[0])


def brute(tokenizer, text):
    return [len(tokenizer.encode((text or "")[:k], add_special_tokens=False).ids) for k in range(len(text or "") + 1)]


def test_every_prefix(tokenizer):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(1500)]
    texts += ["a" * 200, " " * 150, "ab" * 90, "=-" * 70, "0" * 99, "they're we'll I've he'l I'vx", "<|endoftext|>" * 3]
    counter = token_counts.PrefixCounter(catalog.token_files()[0])
    assert [c.tolist() for c in counter.prefixes(texts)] == [brute(tokenizer, t) for t in texts]


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "REMEMBERED_PAIRS", 2)
    counter = token_counts.PrefixCounter(catalog.token_files()[0])
    for text in ["some words, and others", "others again and again", "", "some  more\n\n words"]:
        assert counter.prefixes([text])[0].tolist() == brute(tokenizer, text)


def test_every_token_is_its_own_encoding():
    counter = token_counts.PrefixCounter(catalog.token_files()[0])
    assert all(counter._holds(left, right) is False for left, right, _ in counter.parts.values())
    words = [t for t in ("the", "ing", "tion", " the", "ment", "====", "0000") if " " not in t]
    assert [counter.word(w)[-1] for w in words] == [1] * len(words)


def test_index_and_its_answers(spark, tokenizer):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choices(PARTS, k=rng.randint(0, 30)))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "long text. " * 300), (103, rows[3][1])]
    full = [(d, t, 1, "x", [1], True) for d, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, start long, counts string, within array<int>, last boolean").repartition(3)
    index = token_counts.prefix_counts(docs, catalog.token_files()[0], (0, 5, 10**9), block=16).cache()
    want = {d: brute(tokenizer, t) for d, t in rows}
    got = {}
    for r in sorted(index.collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got.setdefault(r.doc_id, [])) and len(r.counts) <= 16
        got[r.doc_id] += r.counts
    assert got == want
    for r in token_counts.totals(index).collect():
        text = dict(rows)[r.doc_id] or ""
        assert (r.n_chars, r.n_bytes, r.n_tokens) == (len(text), len(text.encode()), want[r.doc_id][-1])
        assert list(r.within) == [max(k for k, c in enumerate(want[r.doc_id]) if c <= b) for b in (0, 5, 10**9)]
    for budget in (0, 5, 40):
        longest = {r.doc_id: r.n_chars for r in token_counts.longest_within(index, budget).collect()}
        assert longest == {d: max(k for k, c in enumerate(cs) if c <= budget) for d, cs in want.items()}
    asked = [(d, n, "y") for d in want for n in (0, 1, 15, 16, 17, 10**6)] + [(0, -1, "y"), (0, None, "y"), (999, 1, "y"), (None, 1, "y")]
    lengths = spark.createDataFrame(asked, "doc_id long, n_chars long, counts string")
    answers = {(r.doc_id, r.n_chars): r.n_tokens for r in token_counts.counts_at(index, lengths, 16).collect()}
    none = {(0, -1): None, (0, None): None, (999, 1): None, (None, 1): None}
    assert answers == none | {(d, n): want[d][min(n, len(want[d]) - 1)] for d, n, _ in asked if (d, n) not in none}
    index.unpersist()


def test_rows_without_id_repeated_and_empty(spark, tokenizer):
    docs = spark.createDataFrame([(None, "ab c"), (None, "ab c"), (1, "ab c"), (1, "ab c"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.totals(token_counts.prefix_counts(docs, catalog.token_files()[0])).collect())
    n = brute(tokenizer, "ab c")[-1]
    assert got == [(0, n), (0, n), (1, n), (1, n), (2, 0)]
    assert token_counts.prefix_counts(docs.limit(0), catalog.token_files()[0]).count() == 0


def test_query_on_all_documents(spark, tokenizer):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.op11(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)
        cut = docs[r.doc_id][: r.fitting_chars]
        assert len(tokenizer.encode(cut, add_special_tokens=False).ids) <= 512
        assert r.over_limit == (cut != docs[r.doc_id])
