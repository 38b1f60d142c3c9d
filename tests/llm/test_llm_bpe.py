import random

import pytest
import public_tokenizers
from brute_texts import sha
from conftest import ODD_TEXTS
from tokenizers import Tokenizer

from callscope.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "a", "Σίσυφος ΟΔΟΣ", "<|endoftext|>x <|startoftext|>", "it's we'll I'M  don't ", "\x1c\x1d a\x85b　c",
    "é café İstanbul ǅ ß", "123 456７８ ①²", "ab" * 500, "x" * 3000, "日本語テキスト 🎉🎉!! ---", "​﻿ a\tb\x00c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_decoding_equal_the_library(library):
    model, draw = bpe.Encoder(PATH), random.Random(1)
    letters = "aAbB \n\t'\"éÉßΣsſ1２<|>endoftextst!?.🎉́"
    texts = ODD + ["".join(draw.choices(letters, k=draw.randint(0, 80))) for _ in range(1500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert model.ids(text) == want
        assert model.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_words_merge_like_short_ones():
    model, draw = bpe.Encoder(PATH), random.Random(2)
    for _ in range(50):
        ids = [model.inner[draw.choice(b"aeinrst")] for _ in range(draw.randint(2, 150))]
        assert model.merge(list(ids)) == model.merge_long(list(ids))


def test_cache_forgets_without_changing_results():
    cache = bpe.Cache(len, limit=3)
    assert [cache[w] for w in ("a", "bb", "a", "ccc", "dddd", "a", "eeeee")] == [1, 2, 1, 3, 4, 1, 5]
    assert len(cache) + len(cache.old) <= 6


def test_query_on_odd_rows(library, odd):
    got = sorted(map(tuple, bpe.encode(odd, PATH).collect()), key=str)
    want = []
    for doc_id, text, *_ in ODD_TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    assert got == sorted(want, key=str)
    assert bpe.encode(odd.limit(0), PATH).count() == 0
