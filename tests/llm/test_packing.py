import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specton.llm import packing
from specton.llm.registry import tokenizer_path


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t '.1<|>ñ😀 s"), max_size=40))
def test_ids_are_those_of_the_tokenizer(encoder, reference, text):
    assert np.frombuffer(encoder([text])[0], "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_special_strings_are_tokens(encoder, reference):
    text = "a <|endoftext|> b<|endoftext|><|endoftext|>  c <|endoftext"
    assert np.frombuffer(encoder([text])[0], "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(spark, reference):
    r = random.Random(1)
    texts = [None, "", "a", "word " * 3000, "x" * 50] + [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(1, 1500))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, start long")
    rows = packing.pack_documents(docs, tokenizer_path(), shard=20).collect()
    by = {}
    for row in rows:
        by.setdefault(row.doc_id, []).append(row)
    assert sorted(by) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = reference.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by[i], key=lambda x: x.piece)
        assert [x.piece for x in own] == list(range(len(own))) and sum(x.length for x in own) == len(ids)
        assert all(x.length == 1024 for x in own[1:]) and len(own) == -(-len(ids) // 1024)
        for x in own:
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes())
    seq = {}
    for row in rows:
        seq.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for own in seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert packing.pack_documents(docs, tokenizer_path()).count() == 2
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_local_search_only_helps():
    r = random.Random(2)
    for _ in range(20):
        lengths = [r.randint(1, 60) for _ in range(r.randint(1, 60))]
        bins = packing.best_fit(lengths, 100)
        after = packing.local_search([b[:] for b in bins], lengths, 100)
        assert sorted(i for b in after for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in after) and len(after) <= len(bins)


def test_local_search_exchanges():
    # 60 + 30 and 55 + 40 and 5 + 10: only moves and exchanges empty the last bin
    lengths = [60, 30, 55, 40, 5, 10]
    assert len(packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 100)) == 2
    # one for two: 50 goes for 20 + 20
    lengths = [50, 50, 20, 20, 50]
    after = packing.local_search([[0, 2, 3], [1], [4]], lengths, 100)
    assert len(after) == 2
