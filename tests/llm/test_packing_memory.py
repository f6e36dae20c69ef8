"""What a packing task holds: bounded tables, no merges without a long word, small batches; and the same pieces for it."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from undula.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture()
def texts():
    rnd = random.Random(5)
    return [" ".join("".join(rnd.choice("etaoinsrhl0123") for _ in range(rnd.randrange(1, 12))) + rnd.choice(["", ",", "#7"]) for _ in range(400)) for _ in range(30)]


def plain(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_tables_are_bounded(texts, monkeypatch):
    monkeypatch.setattr(bpe, "BYTE_CACHE", 1000, raising=False)
    enc = bpe.ByteEncoder(PATH)
    for text in texts:
        assert enc.encode_text(text) == plain(text)
        assert len(enc.ids) <= 1000 and len(enc.pieces) <= 1000
    assert "merges" not in enc.__dict__
    long = "ab1" * 300 + " " + " ".join(f"q{i}" for i in range(1500))
    assert enc.encode_text(long) == plain(long) and "merges" in enc.__dict__
    assert len(enc.ids) <= 1000
    enc.forget()
    assert not enc.ids and not enc.pieces and "merges" not in enc.__dict__


def test_small_batches(spark, texts, monkeypatch):
    during = []
    real = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, *most: during.append(spark.conf.get(KEY)) or real(df, *most))
    before = spark.conf.get(KEY)
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "one long text, " * 200_000), (101, None), (101, "")]  # a text of 3 MB is a batch of its own
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, PATH).collect()
    assert during == [str(1 << 20)] and spark.conf.get(KEY) == before
    assert sum(r.length for r in got) == sum(len(plain(t or "")) // 4 + 1 for _, t in rows)
    whole = {r.doc_id: r.ids_crc32 for r in got if r.start == 0 and r.length == r.doc_tokens}
    assert all(whole[i] == zlib.crc32(plain(rows[i][1]) + b"\1\0\0\0") for i in whole if i < 100)
