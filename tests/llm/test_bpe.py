import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe
from lectern.llm.queries import tokenizer_path

PARTS = ["a", "aa", "the", "ing", "é", "ß", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'ll", "<|endoftext|>", "<|", "中文", "😀", "½", "Ⅳ", "²", "٣", "!!", "0", "12", "_", "́"]


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(tokenizer_path()), bpe.load(bpe.Encoder, tokenizer_path())


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(max_size=60).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t))))
def test_like_the_library(both, text):
    library, own = both
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own.encode(text)) == want
    assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_long_pieces(both):
    library, own = both
    for text in ("ab" * 20_000, "中" * 5_000, "x " * 700_000):
        assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_ids_that_spell_no_text(both):
    library, own = both
    broken = np.array([162, 255, 100, 50256], "<u4")
    assert own.decode(broken.tobytes()) == library.decode(broken.tolist(), skip_special_tokens=False)


def test_messy_table(messy):
    from lectern.llm.queries import tokenizer_path as path
    library = Tokenizer.from_file(path())
    out = bpe.decode(bpe.encode(messy, path()), path()).collect()
    assert len(out) == messy.count()
    for r in out:
        assert ids(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert bpe.encode(messy.limit(0), path()).count() == 0


def test_one_pass_gives_the_same(messy):
    two = bpe.decode(bpe.encode(messy, tokenizer_path()), tokenizer_path())
    one = bpe.round_trip(messy, tokenizer_path())
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_memory_is_given_back(both, monkeypatch):
    library, own = both
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 4_000)  # several generations within one text
    text = " ".join(f"{a}{b}ing" for a in "abcdefghij" for b in ("st", "rup", "ö", "x9"))
    for _ in range(2):
        assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert own.parts and own.pairs and own.parts.weight < 4_000 + 400
    own.forget()
    assert not own.parts and not own.parts.before and not own.pieces and not own.pairs
    assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_query_digests(spark):
    from lectern.llm.queries import QUERIES
    row = QUERIES["op6_bpe_round_trip"](spark, "/root/testdata/sf0.001").where("doc_id = 3").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 3").first()["text"]
    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert row["n_tokens"] == len(want) and row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
