import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievework.llm import bpe
from sievework.llm.queries import op10_bpe

SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encoder(None).encode_batch(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcthe 's\n\t  é1")), max_size=60), max_size=6))
def test_any_text_as_the_library(texts):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    assert ids(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_special_and_long(library):
    rng = random.Random(3)
    texts = ["", SPECIAL, f" {SPECIAL}{SPECIAL} x", "a" * 5000, "th" * 3000, "".join(rng.choice("abcd é") for _ in range(20_000)), "ab " * 700_000]
    assert ids(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_cache_overflow_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    texts = ["one two three four five six seven", "eight nine ten one two"]
    assert ids(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query_edges(spark, tmp_path, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  wörld\n", None), (3, "Hello  wörld\n", None), (None, "z", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op10_bpe(spark, str(tmp_path)).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def row(i, text):
        own = library.encode(text or "", add_special_tokens=False).ids
        return (i, len(own), sha(np.array(own, "<u4").tobytes()), sha((text or "").encode()))

    assert got == sorted([row(i, t) for i, t, _ in rows], key=str)


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id int, text string")).count() == 0
