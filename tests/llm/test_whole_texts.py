"""Operator 5 encodes whole texts at once, with the library's ids."""

import random
import sys
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobsift.llm.token_files import Units, Whole

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE), Units(BYTE)


def test_texts_are_not_cut_at_spaces(byte, monkeypatch):
    library, units = byte
    monkeypatch.setattr(units, "by_units", lambda text: pytest.fail("cut at spaces"))
    for text in ("plain words, isn't it?", "two  spaces \n\n and\ttabs ", "café 日本語 12½—“q” \U0001d400", " ", "\n", "a\x1cb\x85 c　 d",
                 " " * 300_000, " " * 300_000 + "a", "x" + "\n" * 300_000 + " a", "=" * 50_000):
        assert units.encode(text, b"end!") == array("I", library.encode(text, add_special_tokens=False).ids).tobytes() + b"end!", text


def test_added_tokens_and_doubtful_characters_go_by_units(byte):
    _, units = byte
    assert not any(map(units.whole.sure, ("a <|endoftext|> b", "new \U0001fae8 face", "͸", "\U00031350")))
    assert Whole.of(Tokenizer.from_file(WORD), None) is None


def test_every_character_is_of_the_same_kind_in_both_libraries(byte):
    library, units = byte
    sure = [x for x in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(x) < 0xE000 and units.whole.sure(x)]
    assert len(sure) > 50_000
    for at in range(0, len(sure), 2000):
        text = "\n".join(f"a{x}1{x}{x}.{x}b" for x in sure[at : at + 2000])
        assert units.whole.ids(text) == units.ids(text), at


def test_random_texts_are_the_librarys(byte):
    library, units = byte
    rnd = random.Random(5)
    tokens = list(library.get_vocab())
    for _ in range(4000):
        text = "".join(rnd.choice([" ", " ", "  ", "\n", "\t", "'s", "'LL", "é", "中", "́", "7", "<|endoftext|>", " ", "\x85", rnd.choice(tokens), rnd.choice(tokens).strip("Ġ")]) for _ in range(rnd.randrange(1, 30)))
        assert units.encode(text) == units.ids(text), text
