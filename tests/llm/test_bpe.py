import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from notelake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "b", " ", "\n", "'s", "'", "1", "²", "ª", "é", "一", "\x1c", "\x1f", "\x85", "\xa0", "🙂", "#", "Ⅷ", "́", "ß", "'ll", "\t", "_", "½", "ʰ", "ɐ", "the", "\u2028"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_random_texts_encode_as_the_reference_does(reference):
    rng = random.Random(5)
    encoder = bpe._Encoder(bpe.load_ranks(PATH))
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        assert array("I", reference.encode_ordinary(text)).tobytes() == encoder.pack(text), repr(text)


def test_long_piece_and_forgetting(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_REMEMBERED", 3)
    encoder = bpe._Encoder(bpe.load_ranks(PATH))
    text = "ab" * 20_000 + " one two three four five one two"
    assert array("I", reference.encode_ordinary(text)).tobytes() == encoder.pack(text)
    assert len(encoder) <= 3


def test_round_trip_over_odd_rows(odd_docs):
    coded = bpe.decode_ids(bpe.encode_texts(odd_docs, PATH), PATH)
    assert "lang" in coded.columns and dict(coded.dtypes)["ids"] == "binary"
    for r in coded.collect():
        assert bytes(r.decoded).decode() == (r.text or "")
        assert len(r.ids) % 4 == 0


def test_empty_table(odd_docs):
    assert bpe.encode_texts(odd_docs.where(F.lit(False)), PATH).count() == 0


def test_encoding_runs_once(odd_docs):
    coded = bpe.decode_ids(bpe.encode_texts(odd_docs, PATH), PATH).select("ids", "decoded")
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bpe_encode(") == 1


def test_frequent_pieces_are_merged_once_however_many_others_come(monkeypatch):
    merged = []
    monkeypatch.setattr(bpe, "MAX_REMEMBERED", 20)
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: merged.append(piece) or [len(piece)])
    encoder = bpe._Encoder({})
    for i in range(200):
        assert encoder["often"] == (5).to_bytes(4, "little") and encoder[f"rare {i}"]
    assert merged.count(b"often") == 1 and len(encoder) + len(encoder.older) <= 20
