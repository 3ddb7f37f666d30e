import random

import public_tokenizers
from tokenizers import Tokenizer

from sourcelode.llm import token_counts as t

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_every_code_point_class_splits_as_the_library_does():
    tok, counter = Tokenizer.from_file(PATH), t.ByteLevelCounter(PATH)
    chars = [c for c in map(chr, range(0x11000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = [f"a{c}b  {c} {c}{c}1 's{c}\n" for c in chars]
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    wrong = [hex(ord(c)) for c, x, n in zip(chars, texts, want) if counter.count(x) != n]
    assert wrong == []


def test_counts_against_the_library(spark):
    rnd = random.Random(5)
    texts = [None, "", " ", "<|endoftext|>", "a <|endoftext|>  <|endoftext|>b", "x" * 20_000, "don't we'll\t\n\n  Ünïcode ١٢ ½ 日本語 🙂🙂", "\0a\0"]
    texts += ["".join(rnd.choice("ab é\n 1.,'s<|>") for _ in range(n)) for n in (1, 7, 100, 5000)] + ["the of and " * 300] * 3
    rows = [(i, x, 9, 9) for i, x in enumerate(texts)] + [(None, "hi", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, n_tokens int")
    want = sorted((str(i), len((x or "").encode()), n := library(x), n > 512) for i, x, _, _ in rows)
    for kw in ({}, {"table_size": 3, "cache_size": 2, "sample_docs": 1}):
        got = t.token_counts(docs, PATH, **kw).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_empty_table(spark):
    assert t.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
