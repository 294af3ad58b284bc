"""Language identification by cross-parsing entropy.

For each language a suffix automaton recognises every substring of a sample
of its labelled text.  A text is parsed from left to right: the next phrase
is the longest match with the language's sample (one symbol where nothing
matches).  Few phrases mean a small cross entropy; with c phrases in n
symbols and a sample of N, c * log2(N) / n bits a symbol.  The language with
the fewest normalised phrases wins.

Texts are read as lower-cased letters with one space between words, in UTF-8
bytes.  They are parsed in stretches (cut at any byte), all stretches and
bytes of a batch abreast: one table look-up a byte and language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvframe.llm.common import fresh, id_remainder, quoted
from cvframe.llm.words import text_slices

#: Bounds of what is learned from: documents a language (smallest id hashes first) and passages of them.
DOCUMENTS, PASSAGES, PASSAGE_BYTES = 256, 64, 512
#: Languages with the most labelled documents (ties: code-point order) that are learned.
LANGUAGES = 256
STRETCH = 1024               # bytes parsed on their own
NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> bytes:
    """Lower-case letters, other runs as one space, a space at both ends;
    empty if there is no letter."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    # signs that count as word characters but not as letters (marks, vowel signs) stay inside words
    return f" {words} ".encode("utf-8", "surrogatepass") if any(map(str.isalpha, words)) else b""


def automaton(sample: list[bytes]) -> tuple[np.ndarray, int]:
    """Edges (state, byte, next state) of the suffix automaton of the
    passages, state 0 first, and their number of states.

    A passage starts from state 0 again (a generalised automaton), so no
    match runs across a border."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def split(p: int, q: int, byte: int) -> int:
        clone = len(edges)
        edges.append(dict(edges[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and edges[p].get(byte) == q:
            edges[p][byte] = clone
            p = link[p]
        return clone

    for passage in sample:
        last = 0
        for byte in passage:
            q = edges[last].get(byte)
            if q is not None:       # seen in an earlier passage
                last = q if length[q] == length[last] + 1 else split(last, q, byte)
                continue
            state, p = len(edges), last
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and byte not in edges[p]:
                edges[p][byte] = state
                p = link[p]
            if p >= 0:
                q = edges[p][byte]
                link[state] = q if length[q] == length[p] + 1 else split(p, q, byte)
            last = state
    rows = [(s, b, t) for s, e in enumerate(edges) for b, t in e.items()]
    return np.array(rows, np.int32).reshape(-1, 3), len(edges)


class Parser:
    """Counts the phrases of stretches of bytes for one language at a time.

    ``models``: language -> (edges, states, sample bytes).  Only one
    language's dense table exists at a time, so memory does not grow with
    the number of languages."""

    def __init__(self, models: dict[str, tuple[np.ndarray, int, int]]):
        self.models = models

    @staticmethod
    def table(edges: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray]:
        """(column of each byte, look-up).  An entry is twice the row offset of
        the state reached, odd if a new phrase began; column 0 is for bytes
        without an edge (a phrase of one byte), the last for padding."""
        column = np.zeros(257, np.int64)
        used = np.unique(edges[:, 1])
        column[used] = np.arange(1, len(used) + 1)
        width = len(used) + 2
        column[256] = width - 1
        first = np.zeros(width, np.int64)
        at_root = edges[edges[:, 0] == 0]
        first[column[at_root[:, 1]]] = at_root[:, 2]
        look = np.broadcast_to(2 * width * first + 1, (states, width)).copy()     # no edge: a new phrase from the start
        look[edges[:, 0], column[edges[:, 1]]] = 2 * width * edges[:, 2].astype(np.int64)
        look[0] = 2 * width * first + 1                                          # a text's first phrase, and after a lone byte
        look[:, width - 1] = 2 * width * np.arange(states)
        return column, look.astype(np.int32 if 2 * width * states < 1 << 31 else np.int64).ravel()

    def phrases(self, flat: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """language -> phrases of each text; ``flat`` holds all bytes."""
        pieces = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * STRETCH
        size = np.minimum(sizes[text] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        text, start, size = text[order], start[order], size[order]
        longest = int(size.max(initial=0))
        abreast = np.searchsorted(-size, -np.arange(longest), "left")     # stretches longer than t
        by_step = np.concatenate([flat[start[:k] + t] for t, k in enumerate(abreast)] or [flat[:0]])
        ends = np.cumsum(abreast)
        out = {}
        for lang, (edges, states, _) in self.models.items():
            column, look = self.table(edges, states)
            symbols = column[by_step].astype(look.dtype)
            at, count = np.zeros(len(size), look.dtype), np.zeros(len(size), np.int64)
            for a, k in zip(ends - abreast, abreast):
                step = look.take((at[:k] >> 1) + symbols[a:a + k])
                count[:k] += step & 1
                at[:k] = step
            out[lang] = np.bincount(text, count, len(sizes))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        data = [plain(t) for t in texts]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        langs = sorted(self.models)
        if not langs:
            return ["und"] * len(data), np.zeros(len(data))
        counts = self.phrases(np.frombuffer(b"".join(data), np.uint8), sizes)
        bits = np.array([counts[x] * np.log2(max(2, self.models[x][2])) for x in langs])
        best = np.argmin(bits, axis=0)          # ties: the first in code-point order
        rest = bits.copy()
        rest[best, np.arange(len(data))] = np.inf
        other = rest.min(axis=0)
        least = bits.min(axis=0)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(other), 1.0, other / (other + least))
        none = sizes == 0
        return [("und" if e else langs[b]) for b, e in zip(best, none)], np.where(none, 0.0, score)


def learn(docs: DataFrame, divisor: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          documents: int = DOCUMENTS, passages: int = PASSAGES, passage_bytes: int = PASSAGE_BYTES, languages: int = LANGUAGES) -> Parser:
    """Automata of the languages of ``docs``.

    Learns from rows with a language, a text and an id whose crc32 (of the
    id as text) mod ``divisor`` is not ``held``.  Per language the first
    ``documents`` rows by hash of the id are read (repeated rows count once),
    cut whole into passages, of which at most ``passages`` are kept, again by
    hash; at most ``languages`` languages are learned (those with the most
    such rows).  One task learns one language; what reaches the driver is
    bounded by these parameters."""
    doc_id = quoted(id_col).cast("long")
    rows = docs.select(doc_id.alias("id"), quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                      & (id_remainder(F.col("id"), divisor) != held))
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # some four times as many by their hash alone, so no task sees more than those of a language
    h = F.xxhash64("id")
    share = F.pmod(h, F.lit(1 << 32)) * F.col("n").cast("double") / float(1 << 32)
    chosen = rows.select("lang", "id").join(F.broadcast(known), "lang").where(share < 4 * documents)
    first = Window.partitionBy("lang").orderBy(h, "id")
    chosen = chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= documents).select("lang", "id")
    # at most documents * languages pairs of ids
    sample = rows.join(F.broadcast(chosen), ["lang", "id"], "left_semi").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, i, text in zip(*(batch[c].to_pylist() for c in ("lang", "id", "text"))):
                data = plain(text)
                parts = [data[a:a + passage_bytes] for a in range(0, len(data), passage_bytes)]
                yield pa.record_batch([pa.array([lang] * len(parts), pa.string()), pa.array([i] * len(parts), pa.int64()),
                                       pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())],
                                      names=["lang", "id", "nth", "part"])

    parts = sample.mapInArrow(cut, "lang string, id long, nth long, part binary")
    place = Window.partitionBy("lang").orderBy(F.xxhash64("id", "nth"), "id", "nth", "part")
    parts = parts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= passages)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = [bytes(p) for p in pdf.sort_values("place")["part"]]
        edges, states = automaton(taken)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "edges": [edges.tobytes()], "states": [states], "size": [sum(map(len, taken))]})

    built = parts.select("lang", "place", "part").groupBy("lang").applyInPandas(build, "lang string, edges binary, states long, size long")
    return Parser({r["lang"]: (np.frombuffer(r["edges"], np.int32).reshape(-1, 3), r["states"], r["size"]) for r in built.collect()})


def predict(docs: DataFrame, parser: Parser, text_col: str = "text", keep: list[str] | None = None, lang_name: str = "lang_pred",
            score_name: str = "score") -> DataFrame:
    """``docs`` (its columns ``keep``, by default all) with the predicted
    language and a score from 0 to 1: the share of the second best language
    in the bits of the best two (0.5: a tie; 1 if there is one language).

    A NULL text or one without a letter is ``und`` with score 0, as is every
    text if nothing was learned.  Ties go to the first language in code-point
    order.  Whole texts are parsed, each row on its own; an empty table gives
    no rows; other columns pass through, and clashing names are refused."""
    kept = docs.select(*[quoted(c) for c in (docs.columns if keep is None else keep)])
    for name in (lang_name, score_name):
        if fresh(kept, name) != name:
            raise ValueError(f"the table has a column {name}; pass another name")
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    schema = T.StructType([*kept.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    rows = docs.select(quoted(text_col), *[quoted(c) for c in kept.columns])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0):
                lang, score = shared.value.predict(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=schema.names)

    return rows.mapInArrow(work, schema)


def classify(docs: DataFrame, divisor: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    ``held_out``: the remainder that is not learned from (a NULL id gives
    NULL); repeated rows are each scored; see ``learn`` and ``predict``."""
    parser = learn(docs, divisor, held, id_col, text_col, lang_col)
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    return predict(rows, parser, keep=["doc_id"]).select("doc_id", (id_remainder(F.col("doc_id"), divisor) == held).alias("held_out"), "lang_pred", "score")
