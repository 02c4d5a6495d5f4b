import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from filingloom.llm.bpe import TreeBPE, digest_documents, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def small():
    """Tiny leaves, so that short texts go through every join."""
    return TreeBPE(PATH, leaf_chars=24, word_bytes=16, window=8, segment_chars=6)


@pytest.fixture(scope="module")
def usual():
    return TreeBPE(PATH)


ALPHABET = "ab Ae\n\t 'sre1 2é中  .,-<|>  \x1c\x85😀"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=300))
def test_joins_agree_with_the_library(library, small, text):
    assert small.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text(library, small, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert small.encode(text) == ids
    assert small.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_letter_splits_as_in_the_library(library, small, usual):
    for start in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        ids = library.encode(text, add_special_tokens=False).ids
        assert usual.encode(text) == ids, hex(start)
        assert small.encode(text) == ids, hex(start)


@pytest.mark.parametrize("seed", range(6))
def test_long_unbroken_words(library, seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "thetionandé"
    text = "".join(rng.choice(letters) for _ in range(30_000)) + " end " + "=" * 5_000 + " " * 9_000 + "x" + "a" * 40_000
    assert TreeBPE(PATH, leaf_chars=1000, word_bytes=64, window=16, segment_chars=100).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_special_tokens(library, small):
    text = "x<|endoftext|> y" * 40
    assert small.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    texts = [None, "", "a", "Hello  world\n\n ok", "word " * 20_000]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "a", "x"), (2, "a", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.id, r.decoded): list(r.ids) for r in encode_documents(docs, PATH).collect()}
    for i, t in enumerate(texts):
        assert got[(i, t or "")] == library.encode(t or "", add_special_tokens=False).ids
    digests = digest_documents(docs, PATH).collect()
    assert Counter(map(tuple, digests)) == Counter(told(library, i, t) for i, t, _ in rows)
    assert digest_documents(docs.limit(0), PATH).count() == 0


def told(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_digests_of_a_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = Counter(told(library, r.doc_id, r.text) for r in docs.collect())
    assert Counter(map(tuple, digest_documents(docs, PATH).collect())) == want
    # cut to pieces of 700 characters, most texts are joined over rows
    assert Counter(map(tuple, digest_documents(docs, PATH, piece_chars=700).collect())) == want


def test_long_texts_over_rows(spark, library):
    rng = random.Random(2)
    words = ["the", " of", "\n\n", "  ", "x" * 3000, "é中", "=" * 900, " " * 1500, "'s", "12", "<|endoftext|>", "aa" * 2000]
    texts = ["".join(rng.choice(words[: rng.choice([5, 10, 12])]) for _ in range(60)) for _ in range(40)]
    texts += ["\n\n" + "a" * 9000, "b" * 20_000, " " * 5000 + "c" * 5000 + "\n" * 4000, "d\n\n" * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[0])] + [(100 + i, texts[-1]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' key", "'p' pieces")
    for size in (97, 1000, 4096):
        assert Counter(map(tuple, digest_documents(docs, PATH, piece_chars=size).collect())) == Counter(told(library, i, t) for i, t in rows)
