import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import wordids

WORD_BPE, BYTE_BPE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
HARD = [
    "",
    " ",
    "\n\n  ",
    "İstanbul ΣΑΣ. don't I'll 'S O'Reilly's 's't a'd'm ''s 9's 'x 'Sa",
    "<|endoftext|> a<|endoftext|>b <|x",
    "Ђурђевак Ἀθῆναι е́ é it’s ŉ ſ Ŀ ĳ ǆ 1½ x² ¹ ﬁ ª º µ × ÷ 한글 ᄀ 가",
    "日本語テキスト 12345\tx\r\n\x0b\x0c\xa0z y \ud83d😀a😀".replace("\ud83d", ""),
    "word " * 120_000,
    "x" * 300_000 + " y",
]


@pytest.fixture(scope="module", params=[WORD_BPE, BYTE_BPE])
def both(request):
    return wordids.WordIds(request.param, 12), Tokenizer.from_file(request.param)


def same(found, tokenizer, texts):
    for ids, text in zip(found, texts, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


def test_hard_texts_one_by_one_and_together(both):
    words, tokenizer = both
    same([words.texts([t])[0] for t in HARD], tokenizer, HARD)
    same(words.texts(HARD), tokenizer, HARD)
    assert words.texts([]) == []


def test_only_the_tokenizer_that_splits_so_is_looked_up():
    assert wordids.WordIds(WORD_BPE).plain and not wordids.WordIds(BYTE_BPE).plain
    assert wordids.vocabulary(WORD_BPE)[1] == np.dtype("<u2")


def test_every_character_of_the_alphabet():
    words, tokenizer = wordids.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    known = [chr(i) for i in np.flatnonzero(wordids.alphabet()[0] != wordids.OTHER)]
    assert len(known) > 40_000
    texts = [" ".join(f"{c}a{c.upper()}1{c}{c}" for c in known[i : i + 500]) for i in range(0, len(known), 500)]
    same(words.texts(texts), tokenizer, texts)


def test_a_full_table_begins_anew():
    words, tokenizer = wordids.WordIds(WORD_BPE, 6), Tokenizer.from_file(WORD_BPE)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}ord{i * j}x" for j in range(40)) for i in range(60)]
    same([words.texts([t])[0] for t in texts], tokenizer, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB'sé1 .\n-<|Σx’日́t"), max_size=40), max_size=6))
def test_random_texts(texts):
    if not hasattr(test_random_texts, "pair"):
        test_random_texts.pair = wordids.WordIds(WORD_BPE, 10), Tokenizer.from_file(WORD_BPE)
    words, tokenizer = test_random_texts.pair
    same(words.texts(texts), tokenizer, texts)
