import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.common import awkward, frame, shared
from tidepool.llm import bpe_automaton as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library(library):
    automaton = op.compile_automaton(op.read_vocabulary(PATH))
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdeeeethino  \n\t'sdm12777é 　.,ABC") for _ in range(rnd.randint(0, 200))) for _ in range(400)]
    texts += ["".join(rnd.choice(["the", "ing", " th", "er", "  ", "'re", "<|endoftext|>", "\U0001f600", "ß"]) for _ in range(60)) for _ in range(200)]
    texts += ["a" * k for k in range(70)] + [" " * k + "x" for k in range(70)] + ["=" * k for k in range(70)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert op.unpack(automaton.encode(text)) == want.ids
        assert automaton.decode(op.pack(want.ids)) == library.decode(want.ids, skip_special_tokens=False) == text


def test_small_memo(library, monkeypatch):
    monkeypatch.setattr(op, "MEMO_WORDS", 3)
    monkeypatch.setattr(op, "MEMO_STEPS", 3)
    automaton = op.compile_automaton(op.read_vocabulary(PATH))
    text = "some words repeat and some words do not " + "longword" * 30
    assert op.unpack(automaton.encode(text * 3)) == library.encode(text * 3, add_special_tokens=False).ids


def test_long_words(library):
    automaton = op.compile_automaton(op.read_vocabulary(PATH))
    rnd = random.Random(8)
    for text in ("".join(rnd.choice("qzxjk") for _ in range(1 << 20)), "ab" * 300_000, "=" * 500_000):
        assert op.unpack(automaton.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_query(spark, library):
    rows = awkward() + shared(5)
    got = op.bpe_round_trip(frame(spark, rows), PATH).select("doc_id", F.hex("ids").alias("ids"), "decoded").collect()
    assert len(got) == len(rows)
    for (doc_id, text, *_), r in zip(rows, got, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.ids.lower(), r.decoded) == (doc_id, b"".join(i.to_bytes(4, "little") for i in ids).hex(), text or "")
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(b""), 256)).collect()[0][0]
    assert op.bpe_round_trip(frame(spark, []), PATH).count() == 0
