import zlib
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxfabric.llm import packing, token_index
from voxfabric.llm.tokens import Encoder, default_tokenizer

TEXTS = ["", None, "a", "Hello  world\n\n\tIt's we'LL 123 ½² x y\x1c\x1dz \x85 <|endoftext|> été—日本 \U0001f600", "a <|endoftext|> b", "<|endoftext|>", "word " * 5000, "  ", "a", "\n", "the the The 'S", "Ünïcode_é×÷ x_y __ 12a ß\x1cq\x7f it'll's '' !'re\n \t \n x"]


ENCODER = Encoder(default_tokenizer(), max_pieces=50)
TOKENIZER = Tokenizer.from_file(default_tokenizer())


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, None, "x", 9), (None, "null id", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, ids int").repartition(3)


def test_pieces_equal_whole_texts():
    e = Encoder(default_tokenizer(), max_pieces=3)
    got = [np.frombuffer(x, e.dtype).tolist() for x in e.encode([t or "" for t in TEXTS])]
    assert got == [whole(t) for t in TEXTS]


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aé '\n\t_1×sre")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_like_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode([text])[0], ENCODER.dtype).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(spark, docs):
    pieces = packing.pack(docs, length=64)
    rows = pieces.collect()
    stream = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        for k, x in enumerate(ids):
            at = r.sequence_id * 64 + r.offset + k
            assert at not in stream
            stream[at] = x
    assert sorted(stream) == list(range(len(stream)))
    want = sorted(whole(r.text) + [0] for r in docs.collect())
    ends = [k for k in range(len(stream)) if stream[k] == 0]
    got = [[stream[k] for k in range(a + 1, b + 1)] for a, b in zip([-1, *ends], ends)]
    assert sorted(got) == want
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert all(sum(n for _, n in v) % k[1] == 0 for k, v in by_doc.items())
    seqs = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(pieces, 64).collect()}
    assert all(len(s) == 64 for s in seqs.values()) and len(seqs) == -(-len(stream) // 64)


def test_pack_empty(spark, docs):
    assert packing.pack(docs.limit(0)).collect() == []


def test_index_round_trip(spark, docs):
    index = token_index.write(docs, shard_ids=40, shard_keys=3)
    rows = token_index.read_all(index).collect()
    source = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [r.doc_id for r in source]
    assert [r.start for r in rows] == [0, *accumulate(r.n_tokens for r in rows)][:-1]
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == sorted((r.doc_id or -1, np.array(whole(r.text) + [2], "<u4").tobytes()) for r in source)


def test_index_lookup(spark, docs):
    index = token_index.write(docs, shard_ids=40, shard_keys=3)
    keys = spark.createDataFrame([(3,), (4,), (24,), (None,), (-7,), (999,)], "doc_id long")
    got = sorted((r.doc_id or -1, len(r.ids) // 4) for r in token_index.lookup(index, keys).collect())
    assert got == sorted([(-1, len(whole("null id")) + 1), (3, 1), (3, 1), (24, len(whole(TEXTS[8])) + 1)])


def test_one_id_over_many_shards(spark):
    """A third of all rows without an id, and another id of many rows."""
    rows = [(None, f"null {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(40)] + [(i, f"text {i}") for i in range(40)]
    index = token_index.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_ids=30)
    assert index.where("n_null > 0").count() > 2 and index.where("first_id <= 7 and last_id >= 7").count() > 2
    got = token_index.read_all(index).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [0, *accumulate(r.n_tokens for r in got)][:-1]
    want = spark.createDataFrame([(None,), (7,), (8,), (77,)], "doc_id long")
    found = sorted((str(r.doc_id), r.ids) for r in token_index.lookup(index, want).collect())
    assert found == sorted((str(i), bytes(np.array(whole(t) + [2], "<u4"))) for i, t in rows if i in (None, 7, 8))


def test_index_empty(spark, docs):
    assert token_index.read_all(token_index.write(docs.limit(0))).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    slots = token_index.locate(keys, len(keys), token_index.build(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_crc_is_unsigned(spark):
    assert spark.sql("select crc32(unhex('01000000')) c").first().c == zlib.crc32(b"\x01\0\0\0")
