"""Token ids as Arrow files of equal-length sequences and masks.

Documents stand in ascending id order.  Each task writes its range of them
as one Arrow IPC file of record batches whose columns are fixed-size lists:
``ids`` (unsigned, 16 bits if the vocabulary allows), ``mask`` (true: a
token, false: padding after the last document) and ``ends`` (true: the last
token of a document), plus a second file with the ids of its documents.
All batches but the last hold the same number of sequences, so sequence j
is row j mod ``BATCH`` of batch j div ``BATCH`` and can be read from a
memory map without copying or reading anything before it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cvframe.llm.common import quoted, written
from cvframe.session import scratch_dir

LENGTH = 2048         # tokens in a sequence
BATCH = 256           # sequences in a record batch
SLICE_BYTES = 4 << 20
CACHE_CHUNKS = 1_200_000  # chunks remembered by one worker (some 200 bytes each); forgetting only costs time
GROUP = 100             # words the library gets in one text


class ChunkEncoder:
    """Whole texts through the tokenizers library, remembering chunks.

    With byte-level splitting a space between two characters that are not
    white space always begins a new token, so a text is the concatenation of
    its chunks cut there; each new chunk is encoded once by the library.
    Tokenizers without that property get the whole texts."""

    def __init__(self, spec: str, limit: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        conf = json.loads(spec)
        pre = conf.get("pre_tokenizer") or {}
        self.by_chunk = (
            conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and conf.get("truncation") is None and conf.get("padding") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t.get("normalized") or re.search(r"\s", t["content"])
                        for t in conf.get("added_tokens", [])))
        self.limit = limit
        self._forget()
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)   # tokens that begin with a space
        self.begins[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True

    def _forget(self) -> None:
        """Rows of known words (with the space before them) and of other
        chunks, numbered together, and the ids of all rows."""
        number = count()
        self.words, self.chunks, self.ids = _Rows(number), _Rows(number), _Ids()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_space(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word with the space before it: (all ids, ids per word).

        The library gets many words in one text; a chunk begins with the only
        token that begins with a space, so its ids are cut out there."""
        parts, sizes = [], []
        for a in range(0, len(words), GROUP):
            part = words[a:a + GROUP]
            ids = np.array(self._ids([" " + " ".join(part)])[0], np.uint32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(part) and at[0] == 0:
                parts.append(ids)
                sizes.append(np.diff(at, append=len(ids)))
            else:
                single = self._ids([" " + w for w in part])
                parts += [np.array(x, np.uint32) for x in single]
                sizes.append(np.array([len(x) for x in single]))
        return np.concatenate(parts), np.concatenate(sizes)

    def _learn(self, rows: "_Rows", known: int) -> None:
        """Ids of the texts that got rows since there were ``known``."""
        texts = list(islice(rows, known, None))
        at = np.fromiter(islice(rows.values(), known, None), np.int64, len(texts))
        for a in range(0, len(texts), 20_000):
            part = texts[a:a + 20_000]
            if rows is self.words:
                self.ids.add(at[a:a + 20_000], *self._after_space(part))
            else:
                ids = self._ids(part)
                self.ids.add(at[a:a + 20_000], np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    @staticmethod
    def _odd_chunks(text: str) -> list[str]:
        """Cuts before each space that has no white space on either side."""
        cuts = [0, *(m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text)), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        if not self.by_chunk:
            return [np.array(x, np.uint32) for x in self._ids(texts)]
        if len(self.words) + len(self.chunks) > self.limit:
            self._forget()
        known = len(self.words), len(self.chunks)
        row, chunk = self.words.__getitem__, self.chunks.__getitem__
        odd = [_odd_space(t) for t in texts]
        # plain texts: words are looked up once a call, not once an occurrence
        plain = pa.array([t for t, o in zip(texts, odd) if not o], pa.string())
        split = pc.split_pattern(plain, " ")
        counted = split.flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(counted.dictionary)], counted.dictionary), " ")[0].as_py()
        at = np.fromiter(map(row, distinct.split(" ")), np.int64)[np.asarray(counted.indices)] if len(plain) else np.zeros(0, np.int64)
        sizes = np.asarray(pc.list_value_length(split)).astype(np.int64)
        firsts = np.cumsum(sizes) - sizes
        at[firsts] = [chunk(w) for w in split.flatten().take(pa.array(firsts)).to_pylist()]     # no space before it
        whole = iter(np.split(at, firsts[1:])) if len(plain) else iter(())
        rows = [np.array([chunk(c) for c in self._odd_chunks(t)], np.int64) if o else next(whole) for t, o in zip(texts, odd)]
        self._learn(self.words, known[0])
        self._learn(self.chunks, known[1])
        out, sizes = self.ids.take(np.concatenate([np.zeros(0, np.int64), *rows]))
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, rows)])].tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]


#: White space other than the space and the line feed.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_BESIDE = re.compile(r"[^\S ] | [^\S ]")


def _odd_space(text: str) -> bool:
    """Whether a space stands beside other white space, or first or last."""
    if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " ":
        return True
    return any(c in text for c in _OTHER_SPACE) and _BESIDE.search(text) is not None


class _Ids:
    """Ids of rows, one after the other in a growing array."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used + len(ids))
        self.flat[self.used:self.used + len(ids)] = ids
        n = int(rows.max()) + 1
        self.start, self.size = self._room(self.start, n), self._room(self.size, n)
        self.size[rows], self.start[rows] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows, one after the other; ids per row)."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(self.start[rows] - (ends - sizes), sizes)
        return self.flat[at], sizes


class _Rows(dict):
    """text -> row; an unknown text gets the next number."""

    def __init__(self, number: Iterator[int]):
        super().__init__()
        self.number = number

    def __missing__(self, text: str) -> int:
        row = self[text] = next(self.number)
        return row


_ENCODERS: dict[int, ChunkEncoder] = {}


def _encoder(spec: str) -> ChunkEncoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(spec)
    return _ENCODERS[key]


def _file_system(uri: str):
    """(file system, path) of a Hadoop-style folder name."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Packs one shard's token stream into fixed-size-list batches."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int):
        self.length, self.room = length, length * batch
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)),
                                 ("ends", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.ids, self.ends, self.used = np.zeros(self.room, dtype), np.zeros(self.room, bool), 0
        self.tokens = 0

    def add(self, ids: np.ndarray) -> None:
        """One document, its end id included."""
        at, last = 0, len(ids)
        while at < last:
            n = min(self.room - self.used, last - at)
            self.ids[self.used:self.used + n] = ids[at:at + n]
            self.used += n
            at += n
            if at == last:
                self.ends[self.used - 1] = True
            if self.used == self.room:
                self._flush()
        self.tokens += last

    def _flush(self) -> None:
        rows = -(-self.used // self.length)
        n = rows * self.length
        mask = np.arange(n) < self.used
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (self.ids[:n], mask, self.ends[:n])],
            schema=self.schema))
        self.ids, self.ends, self.used = np.zeros_like(self.ids), np.zeros_like(self.ends), 0

    def close(self) -> None:
        if self.used:
            self._flush()
        self.out.close()


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    a = 0
    while a < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[a:]), limit, "right")))
        yield a, a + n
        a += n


_SHARD = "shard int, file string, tokens long, docs long"


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Writes the files and returns the shards: shard, file, tokens, docs, start.

    ``docs`` are range-partitioned by id and sorted (NULL ids first; rows
    with equal ids by a hash of the text, then the text; repeated rows are
    separate documents).  NULL and empty texts are documents with the end id
    alone.  Only id and text are read, so other columns do not matter; an
    empty table gives no shards.  A shard is written under a name of its own
    attempt and renamed when complete, so retries and duplicates of a task
    leave one whole file."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())   # a fixed vocabulary file
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc = _encoder(spec.value)
        size = enc.tokenizer.get_vocab_size()
        dtype = np.dtype(np.uint16 if max(size, end_id + 1) <= 1 << 16 else np.uint32)
        fs, top = _file_system(folder)
        fs.create_dir(top, recursive=True)
        ctx = TaskContext.get()
        name = f"shard-{ctx.partitionId():06d}"
        temp = f"{top}/_{name}-{ctx.taskAttemptId()}"
        end = np.array([end_id], np.uint32)
        n_docs = 0
        with fs.open_output_stream(f"{temp}.arrow") as sink, fs.open_output_stream(f"{temp}.docs") as id_sink:
            out = SequenceWriter(sink, dtype, length, batch)
            ids_out = pa.ipc.new_file(id_sink, pa.schema([("doc_id", pa.int64())]))
            rb = first
            while rb is not None:
                for a, b in _slices(rb.column(1), SLICE_BYTES):
                    for ids in enc.encode([t or "" for t in rb.column(1).slice(a, b - a).to_pylist()]):
                        out.add(np.concatenate([ids, end]))
                if rb.num_rows:
                    ids_out.write_batch(pa.RecordBatch.from_arrays([rb.column(0)], names=["doc_id"]))
                n_docs += rb.num_rows
                rb = next(batches, None)
            out.close()
            ids_out.close()
        for kind in ("arrow", "docs"):
            fs.move(f"{temp}.{kind}", f"{top}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([ctx.partitionId()], pa.int32()), "file": [name], "tokens": [out.tokens], "docs": [n_docs]})

    shards = written(rows.mapInArrow(work, _SHARD), "sequence-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def open_shard(folder: str, name: str, kind: str = "arrow") -> pa.ipc.RecordBatchFileReader:
    """Random access to a shard's batches (memory-mapped where local)."""
    from pyarrow import fs as pafs

    fs, top = _file_system(folder)
    path = f"{top}/{name}.{kind}"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, j: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence j of a shard; reads its batch alone."""
    rb = reader.get_batch(j // batch)
    ids, mask = rb.column(0), rb.column(1)
    width = ids.type.list_size
    at = j % batch * width
    return ids.values.slice(at, width).to_numpy(), mask.values.slice(at, width).to_numpy(zero_copy_only=False)


def _documents(reader: pa.ipc.RecordBatchFileReader) -> Iterator[tuple[int, int]]:
    """(tokens, crc32 of the ids as little-endian uint32) per document."""
    n = crc = 0
    for k in range(reader.num_record_batches):
        rb = reader.get_batch(k)
        ids = rb.column(0).flatten().to_numpy()
        mask = rb.column(1).flatten().to_numpy(zero_copy_only=False)
        ends = rb.column(2).flatten().to_numpy(zero_copy_only=False)
        used = int(np.count_nonzero(mask))
        raw = memoryview(ids[:used].astype("<u4").tobytes())
        at = 0
        for stop in (np.flatnonzero(ends) + 1).tolist():
            yield n + stop - at, zlib.crc32(raw[4 * at:4 * stop], crc)
            n = crc = 0
            at = stop
        n, crc = n + used - at, zlib.crc32(raw[4 * at:], crc)


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                reader = open_shard(folder, row["file"])
                own = open_shard(folder, row["file"], "docs")
                found = _documents(reader)
                start = row["start"]
                for k in range(own.num_record_batches):
                    ids = own.get_batch(k).column(0)
                    part = [next(found) for _ in range(len(ids))]
                    n = np.array([x[0] for x in part], np.int64)
                    ends = start + np.cumsum(n)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(ends - n), pa.array(n), pa.array([x[1] for x in part], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start = int(ends[-1])

    # as many tasks as files: left to itself Spark would join the short list of files in one task
    spread = shards.select("shard", "file", "start").repartition(max(1, shards.count()), "shard")
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return scratch_dir(spark, "sequences")
