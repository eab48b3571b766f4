"""Tokens against the tokenizer itself, pieces against the text, and sequences against their capacity."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from helpers import corpus, table
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidewater.llm.packing import WordTokenizer, pack, pack_documents

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


WORDS = WordTokenizer(FILE)
ODD = [
    "İstanbul ǅ ΣΑΣ ﬁne Ⅷ don't we'll ''s x's,", "a.b, c., d,. 3.14 1,000 ,", "<|startoftext|>x <|endoftext|>", "naïve é ́x",
    "日本語、です。 ñandú, Ñ.  line　wide hard\x85next", "ÅÅ. ǆ, ŉ. ßß, İ, ª. º,", "\x00 \x1f a\x1cb", "\U0001f600\U0001f600, ok.", "K ſ, Å",
]


def test_ids_are_the_tokenizers(tokenizer):
    texts = ODD + [t or "" for _, t in corpus(8)]
    words = WordTokenizer(FILE)
    for _ in range(2):  # unknown, then known words
        for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


class Counting:
    """Passes texts on to a tokenizer and keeps them."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode(self, text, **options):
        self.texts.append(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch(texts, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_a_run_of_letters_is_encoded_once_whatever_closes_it(tokenizer):
    words = WordTokenizer(FILE)
    words.tokenizer = full = Counting(tokenizer)
    words.runs = runs = Counting(words.runs)
    for text in ("Straße straße. straße*** niño!! niño.### niño,&&& niño- d'or ab1. (x)", "日本。 日本 日本***"):
        (ids,) = words.encode([text.encode()])
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(" ".join(runs.texts).split()) == ["niño", "straße"] and not any("niño" in x for x in full.texts)
    assert " ".join(full.texts).split().count("日本") == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=['Cs']), max_size=30), max_size=6))
def test_any_text_has_the_tokenizers_ids(texts):
    words, tokenizer = WORDS, WORDS.tokenizer
    for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_sequences_are_gapless_and_within_capacity(lengths):
    where, offset, used = pack(np.array(lengths, np.int64), 30)
    rows = defaultdict(list)
    for n, w, o in zip(lengths, where, offset):
        rows[w].append((o, n))
    assert set(rows) == set(range(used))
    for row in rows.values():
        at = 0
        for o, n in sorted(row):
            assert o == at
            at += n
        assert at <= 30
    large = [n for n in lengths if 3 * n > 30]
    assert all(sum(3 * n > 30 for _, n in row) <= 2 for row in rows.values()) or not large


def test_few_sequences():
    r = random.Random(1)
    lengths = np.array([r.choice([r.randint(1, 600), r.randint(300, 2047)]) for _ in range(5000)])
    assert pack(lengths, 2048)[2] <= np.ceil(lengths.sum() / 2048) * 1.05


@pytest.mark.parametrize("group_items", [25_000, 10])
def test_pieces_of_documents(spark, tokenizer, group_items):
    rows = corpus(9) + [(5000, "word " * 90), (5001, "one two, three. " * 700)]
    got = pack_documents(table(spark, rows), capacity=64, group_items=group_items, keep_ids=True).collect()
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    pieces = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
        assert r.start == r.piece * 64
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        want = sorted((i, tuple(x[a : a + 64])) for x in texts[d] for i, a in enumerate(range(0, len(x), 64)))
        assert sorted((r.piece, tuple(r.ids)) for r in own) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for row in sequences.values():
        at = 0
        for o, n in sorted(row):
            assert o == at
            at += n
        assert at <= 64


def test_empty_table(spark):
    assert pack_documents(table(spark, [])).count() == 0
    assert [r.length for r in pack_documents(table(spark, [(1, None)])).collect()] == [1]
