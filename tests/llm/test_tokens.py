import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cvframe.llm import pieces, sequences

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = st.one_of(st.sampled_from(list("abcdet  \n\t▁.,'0123éß日😀\x00　") + ["the", "ing", "  ", "<|endoftext|>", "<s>", "<0x41>"]),
                     st.characters(exclude_categories=["Cs"]))
TEXT = st.lists(ALPHABET, max_size=60).map("".join)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, "rb") as f:
        return pieces.Encoder(f.read(), limit=200)


def ids_of(enc, text):
    return np.frombuffer(enc.encode([text])[0], "<i4")


@settings(max_examples=400, deadline=None)
@given(text=TEXT)
def test_pieces_as_the_library(text, library, encoder):
    ids = ids_of(encoder, text)
    want = library.encode(text)
    assert ids.tolist() == want
    assert encoder.model.decode(ids) == library.decode(want)


def test_long_words_and_runs(library, encoder):
    rng = random.Random(4)
    texts = ["a" * 5000, "xyzq" * 900, "\n" * 3000, "ab\n" * 700, "日本" * 800, "=" * 999, "é" * 333]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(900)) for _ in range(20)]
    texts += [" " * k + w for k in range(0, 70, 3) for w in ("", "the x", "\n")]
    for t in texts:
        assert ids_of(encoder, t).tolist() == library.encode(t)
    assert len(ids_of(encoder, " " * 100_000)) == len(library.encode(" " * 100_000))


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.integers(0, 31_999) | st.integers(0, 270), max_size=12))
def test_decode_any_ids(ids, library, encoder):
    assert encoder.model.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_pieces_frame(spark, make_docs, library):
    rows = [(1, "Hello  world\n", "s"), (1, "Hello  world\n", "s"), (2, None, None), (None, "", "s"), (3, "x " * 60_000, "s")]
    got = pieces.encode(make_docs(rows, extra=("ids", "decoded")), MODEL)
    assert got.columns[-2:] == ["ids_1", "decoded_1"]
    for r in got.collect():
        want = library.encode(r["text"] or "")
        assert r["ids_1"] == want and r["decoded_1"] == library.decode(want)
    assert pieces.encode(make_docs([]), MODEL).collect() == []


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_chunks_as_the_library(text):
    enc = chunk_encoder()
    assert enc.by_chunk
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


_CHUNKS = []


def chunk_encoder():
    if not _CHUNKS:
        with open(BYTES, encoding="utf-8") as f:
            _CHUNKS.append(sequences.ChunkEncoder(f.read(), limit=100))
    return _CHUNKS[0]


def test_sequence_files(spark, make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "#", "日本", "x\n"]) for _ in range(rng.randrange(0, 60))), "s") for i in range(80)]
    rows += [(17, "again", "s"), (17, "again", "s"), (5, None, "s"), (None, "no id", "s"), (200, "w " * 30_000, "s"), (-4, "", None)]
    folder = sequences.new_folder(spark)
    docs = make_docs(rows, extra=("start", "tokens")).repartition(6)
    shards = sequences.write(docs, BYTES, folder, end_id=2, length=16, batch=4)
    got = sorted((tuple(r) for r in sequences.read_documents(shards, folder).collect()), key=lambda r: r[1])
    tok = Tokenizer.from_file(BYTES)
    order = lambda r: (r[0] is not None, r[0] or 0)
    assert [order((r[0],)) for r in got] == sorted(order(r) for r in rows)
    streams, at = {}, 0
    for _, text, _ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        streams.setdefault(_, []).append(ids)
    want = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
                  for i, t, _ in rows for x in [tok.encode(t or "", add_special_tokens=False).ids + [2]])
    assert sorted((str(i), n, c) for i, _, n, c in got) == want
    for _, start, n, _ in got:      # starts run on without gaps
        assert start == at
        at += n
    for r in shards.collect():      # equal lengths; any sequence by itself
        reader = sequences.open_shard(folder, r["file"])
        assert isinstance(reader, pa.ipc.RecordBatchFileReader)
        n_seq = -(-r["tokens"] // 16)
        assert sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches)) == n_seq
        ids, mask = sequences.sequence(reader, n_seq - 1, batch=4)
        assert len(ids) == 16 and ids.dtype == np.uint16 and mask.sum() == (r["tokens"] - 1) % 16 + 1


def test_no_documents(spark, make_docs):
    folder = sequences.new_folder(spark)
    shards = sequences.write(make_docs([]), BYTES, folder, end_id=2)
    assert shards.collect() == [] and sequences.read_documents(shards, folder).collect() == []
