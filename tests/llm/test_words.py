"""Operators 2, 4 and 5 and their parts against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_SMALL
from jobsift.llm import rans
from jobsift.llm.bpe_codec import Codec, bpe_encode, digests
from jobsift.llm.token_counts import CHUNK, StateMap, UnitCounts, chunk_map, compose, count_tokens, scan, token_counts
from jobsift.llm.token_files import Units, read_tokens, write_tokens

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "don't STOP it's we'll \"'s '' 'x", "a b c", "<|startoftext|>hi<|endoftext|> x<|endoftext|", "<|ENDOFTEXT|> <|x|>",
       "ﬁ Ⅷ ½ ÀÉ é İ Σς ß", "日本語 テスト 한국어 😀👍🏽", "\x00\x01 \x1c\x1d a\x85b", "x" * 5000, "ab1234 5.6,7--!!..", "a!?. b's x.) y'.,z?,",
       "  a\n b  ", "a ", " <|endoftext|> x", "Über, STRASSE. Ñandú! ça?"]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD), UnitCounts(WORD), Codec(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE), Units(BYTE)


def _texts():
    rnd = random.Random(5)
    return ODD + ["".join(rnd.choice("abcdeé' \n1!ßñ日<|>\x1c .,A") for _ in range(150)) for _ in range(200)]


def test_counts_and_ids_equal_the_library(word):
    library, counts, codec = word
    for text in _texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert count_tokens(text.encode(), counts) == len(want), text
        got = np.frombuffer(codec.encode(text.encode()), "<i4")
        assert got.tolist() == want, text
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(word, byte, text):
    want = word[0].encode(text, add_special_tokens=False).ids
    assert count_tokens(text.encode(), word[1]) == len(want)
    assert np.frombuffer(word[2].encode(text.encode()), "<i4").tolist() == want
    assert np.frombuffer(byte[1].encode(text), "<u4").tolist() == byte[0].encode(text, add_special_tokens=False).ids


def test_state_maps_compose_like_the_whole_text(word):
    _, counts, _ = word
    rnd = random.Random(1)
    text = "".join(rnd.choice("abc def\n") for _ in range(400)).encode() + b"x" * 50
    whole = count_tokens(text, counts)
    for size in (1, 3, 7, 64):
        maps = [chunk_map(text[a : a + size], counts) for a in range(0, len(text), size)]
        prefixes = scan(maps, counts)
        left = maps[0]
        for i, m in enumerate(maps[1:], 1):
            left = compose(left, m, counts)
            assert prefixes[i] == left
        done = prefixes[-1]
        assert done.count + sum(counts[x] for x in (done.head, done.tail) if x) == whole
    assert chunk_map(b"abc", counts) == StateMap(b"abc", 0, None)


def test_a_text_longer_than_many_chunks(word):
    library, counts, _ = word
    text = ("thou art Übermut, 12 " * 9000) + "y" * (2 * CHUNK)
    assert count_tokens(text.encode(), counts) == len(library.encode(text, add_special_tokens=False).ids)


def test_forced_boundaries_are_certain(word):
    _, _, codec = word
    rnd = random.Random(2)
    for _ in range(300):
        w = "".join(rnd.choice("abcdefgxyzq") for _ in range(rnd.randint(2, 12)))
        w = w[:-1] + chr(0xE000 + ord(w[-1]))
        assert codec.encode_word(w) == [codec.bpe.ids[x] for x in codec.bpe.merge(w)]


def test_pieces_equal_the_library(byte):
    library, units = byte
    for text in _texts():
        assert np.frombuffer(units.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_rans_round_trip_and_parts():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 1_500_000) % 5000).astype("<u4")
    symbols, counts = np.unique(ids, return_counts=True)
    table = rans.Table.from_counts(symbols, counts)
    assert table.frequencies.sum() == 1 << rans.BITS
    for n in (0, 1, rans.LANES - 1, rans.LANES, rans.LANES + 1, 1_500_000):
        block = rans.encode(ids[:n], table)
        assert (rans.decode(block, table) == ids[:n]).all()
        parts = [rans.decode_part(block, table, k) for k in reversed(range(rans.checkpoints(block)))]
        assert n == 0 or (np.concatenate(parts[::-1]) == ids[:n]).all()
    entropy = -(counts / len(ids) * np.log2(counts / len(ids))).sum()
    assert len(block) * 8 / len(ids) < entropy * 1.15
    one = rans.Table.from_counts([7], [3])
    assert (rans.decode(rans.encode(np.full(5000, 7), one), one) == 7).all()


def test_rans_detects_damage():
    table = rans.Table.from_counts([0, 1, 2], [5, 3, 1])
    block = bytearray(rans.encode(np.array([0, 1, 2, 0, 1] * 500), table))
    block[-1] ^= 1
    with pytest.raises(rans.Corrupt):
        rans.decode(bytes(block), table)
    with pytest.raises(rans.Corrupt):
        rans.decode(b"", table)


def _edge(spark):
    rows = [(3, "b b", "x"), (1, None, "x"), (2, "", None), (3, "b b", "x"), (None, "c", "x"), (3, "a", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_edge_rows(spark):
    docs = _edge(spark)
    counted = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, WORD).collect())
    assert counted == [(0, 1, 1, False), (1, 0, 0, False), (2, 0, 0, False), (3, 1, 1, False), (3, 3, 2, False), (3, 3, 2, False)]
    got = digests(bpe_encode(docs, WORD)).collect()
    assert len(got) == 6 and sum(r.n_tokens for r in got) == 6
    assert token_counts(docs.limit(0), WORD).count() == 0 and bpe_encode(docs.limit(0), WORD).count() == 0


def test_token_files(spark):
    library = Tokenizer.from_file(BYTE)
    docs = _edge(spark).union(spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id + 100", "text", "source"))
    path = write_tokens(docs, BYTE)
    got = [tuple(r) for r in read_tokens(spark, path).orderBy("start").collect()]
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at = 0
    for (doc_id, start, n, crc, ids), row in zip(got, rows, strict=True):
        want = library.encode(row.text or "", add_special_tokens=False).ids + [0]
        assert (doc_id, start, n, ids) == (row.doc_id, at, len(want), want)
        assert crc == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        at += n
    assert read_tokens(spark, write_tokens(docs.limit(0), BYTE)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a é\n\t\x1c\x85\xa0\u2003\u3000日", max_size=12))
def test_more_space_is_the_search(text):
    from jobsift.llm.token_files import _MORE_SPACE, more_space
    assert more_space(text) == bool(_MORE_SPACE.search(text))


def test_ranked_pieces_are_the_models(byte):
    """Made-up words, and all tokens of the vocabulary run together, piece by piece."""
    from jobsift.llm.token_files import ranked_pieces
    library, units = byte
    assert units.pieces is not None and ranked_pieces(Tokenizer.from_file(WORD)) is None
    rnd = random.Random(1)
    tokens = [t.strip("Ġ") for t in library.get_vocab() if t.strip("Ġ").isalpha() and t.isascii()]
    words = ["".join(rnd.sample(tokens, rnd.randrange(1, 5))) for _ in range(20_000)] + ["".join(rnd.choice("aeioxyzéñüß") for _ in range(rnd.randrange(1, 40))) for _ in range(20_000)]
    for word in words:
        assert np.frombuffer(units[word], "<u4").tolist() == library.encode(" " + word, add_special_tokens=False).ids, word
