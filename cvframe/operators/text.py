"""Text preparation (T1-T9): strip, tokenize, token-shuffle ablation,
truncation, vocabulary encoding, batching and per-batch padding.

Everything works on whole texts.  The token shuffle and the encoder are
array-in, array-out Arrow functions, the rest native expressions.  Shuffles:
the vocabulary count (map-side combined) and rank and the per-batch window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cvframe.functions.hashing import keyed_md5
from cvframe.functions.permute import key_words, permuted
from cvframe.functions.text import strip_text, tokenize
from cvframe.operators.index import ordered_index
from cvframe.session import written

PAD_ID = 0
UNK_ID = 1
FIRST_ID = 2
DICTIONARY_TOKENS = 1 << 20     # vocabulary sent to every worker (some 30 MB); beyond, a join


def strip_col(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Unicode strip of ``col`` (NULL stays NULL)."""
    return df.withColumn(out or col, strip_text(F.col(col)))


def tokens_col(df: DataFrame, col: str, out: str = "tokens") -> DataFrame:
    """Word / punctuation tokens of the stripped text."""
    return df.withColumn(out, tokenize(strip_text(F.col(col))))


def shuffled_tokens(tokens: Column, seed, id_col: Column) -> Column:
    """T3 as an expression: one deterministic permutation per (seed, post).

    The order is a keyed permutation of the positions (a Feistel network,
    :mod:`cvframe.functions.permute`) with key ``seed ':' id``: no hash per
    token and no sort.  A NULL id counts as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return permuted(tokens, key_words(key))


def shuffled_text(text: Column, seed, id_col: Column) -> Column:
    """The text's tokens, shuffled and re-joined with spaces."""
    return F.array_join(shuffled_tokens(tokenize(strip_text(text)), seed, id_col), " ")


def shuffle_text(df: DataFrame, col: str, seed, id_col: str = "post_id", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, shuffled_text(F.col(col), seed, F.col(id_col)))


def truncate(tokens: Column, max_len: int = 512) -> Column:
    """T4: keep the first ``max_len`` tokens (the model's input limit)."""
    return F.slice(tokens, 1, max_len)


def build_vocab(df: DataFrame, tokens: str = "tokens", size: int | None = None, digits: int = 3) -> DataFrame:
    """``(token, id)``, most frequent first (ties by ``md5('vocab:' token)``,
    token); ids start at 2 (0 = pad, 1 = unknown).

    All tokens by default; ``size`` keeps the most frequent ones.  Counting
    is a partial aggregate; the rank is a bucketed index over the counts
    (the tokens seen once, a third of the vocabulary, are one hot group
    there), so no task holds the vocabulary.
    """
    # explode_outer + filter: a plain explode lets Catalyst infer a
    # ``size(tokens) > 0`` filter and push it (and the tokenizer) into the scan
    toks = df.select(F.explode_outer(tokens).alias("token")).filter(F.col("token").isNotNull())
    counts = toks.groupBy("token").agg((-F.count(F.lit(1))).alias("_neg"))
    counts = counts.withColumn("_h", keyed_md5(F.lit("vocab"), F.col("token")))
    ranked = ordered_index(counts, [], ["_neg"], "_h", "token", out_col="_rank", digits=digits)
    if size is not None:
        ranked = ranked.filter(F.col("_rank") < size)
    return ranked.select("token", (F.col("_rank") + F.lit(FIRST_ID)).cast("int").alias("id"))


def encode(df: DataFrame, vocab: DataFrame, id_col: str = "post_id", tokens: str = "tokens", out: str = "ids",
           dictionary_tokens: int = DICTIONARY_TOKENS) -> DataFrame:
    """``(id, ids)`` with the id of every token of every row (unknown -> 1);
    a NULL array gives an empty one, repeated ids stay rows of their own.

    The vocabulary is written first.  Up to ``dictionary_tokens`` tokens it is
    sent to the workers as one Arrow dictionary and each array is looked up
    where it is: no row per token and no shuffle.  Of a larger vocabulary the
    tokens with the smallest ids are sent, the others joined
    (:func:`encode_joined`)."""
    vocab = written(vocab.select("token", "id"), "vocab")
    if vocab.count() > dictionary_tokens:
        return encode_joined(df, vocab, id_col, tokens, out, dictionary_tokens)
    return _looked_up(df.select(id_col, tokens), vocab, out)


def _looked_up(df: DataFrame, vocab: DataFrame, out: str, rest: str | None = None) -> DataFrame:
    """``(.., ids)`` for ``(.., tokens)`` by a dictionary sent to the workers.
    With ``rest``, tokens that it lacks are NULL among the ids and follow in
    that column, in order; else they are unknown."""
    known = vocab.toArrow()             # at most the caller's dictionary_tokens rows
    shared = df.sparkSession.sparkContext.broadcast((known["token"].combine_chunks(), known["id"].combine_chunks()))
    strings = [StructField(rest, ArrayType(StringType()))] if rest else []
    schema = StructType([*df.schema.fields[:-1], StructField(out, ArrayType(IntegerType())), *strings])

    def lists(size: np.ndarray, flat: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), flat)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = shared.value
        for batch in batches:
            arrays = batch.column(batch.num_columns - 1)
            size = np.asarray(pc.fill_null(pc.list_value_length(arrays), 0))
            flat = arrays.flatten()
            distinct = flat.dictionary_encode()
            at = pc.index_in(distinct.dictionary, names)
            found = pc.fill_null(ids.take(at), UNK_ID).take(distinct.indices)
            if rest:
                lacking = pc.fill_null(pc.is_null(at).take(distinct.indices), False)
                found = pc.if_else(lacking, pa.scalar(None, pa.int32()), pc.fill_null(found, UNK_ID))
                before = np.append(0, np.cumsum(np.asarray(lacking), dtype=np.int32))
                per_row = np.diff(before[np.append(0, np.cumsum(size))])
                columns = [lists(size, found.cast(pa.int32())), lists(per_row, flat.filter(lacking))]
            else:
                columns = [lists(size, pc.fill_null(found, UNK_ID).cast(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return df.mapInArrow(look_up, schema)


def encode_joined(df: DataFrame, vocab: DataFrame, id_col: str = "post_id", tokens: str = "tokens", out: str = "ids",
                  dictionary_tokens: int = DICTIONARY_TOKENS) -> DataFrame:
    """:func:`encode` for a vocabulary of any size: the tokens with the
    smallest ids (``dictionary_tokens`` of them, in a vocabulary by frequency
    nearly all that occur) are looked up, only the others joined.

    What is shuffled is (row number, position, token) of those others and the
    ids of each row, never the text; the rows get their number in a written
    table, so a retry sees the same ones.  Frequent tokens are left to AQE,
    which splits them.  A group of the final regrouping never outgrows its text.
    """
    first = vocab.agg(F.min("id")).first()[0]
    near = (F.col("id") - F.coalesce(F.lit(first), F.lit(0))) < dictionary_tokens
    sent = vocab.where(near)
    if sent.count() > dictionary_tokens:        # ids that many tokens share say nothing
        near, sent = F.lit(False), vocab.where("false")
    numbered = df.select(id_col, F.monotonically_increasing_id().alias("_row"), tokens)
    rows = written(_looked_up(numbered, sent, "_ids", "_rest"), "encode-rows")
    exploded = rows.select("_row", F.posexplode("_rest").alias("pos", "token"))
    looked = exploded.join(vocab.where(~near), "token", "left")
    # (position, id) packed into one BIGINT: collecting and sorting a
    # primitive array is far cheaper than an array of structs
    packed = F.expr(f"shiftleft(CAST(pos AS BIGINT), 32) + coalesce(id, {UNK_ID})")
    grouped = looked.groupBy("_row").agg(F.sort_array(F.collect_list(packed)).alias("_p"))
    grouped = grouped.selectExpr("_row", "transform(_p, x -> CAST(x & 4294967295 AS INT)) AS _found")
    joined = rows.select("_row", id_col, "_ids").join(grouped, "_row", "left").select(id_col, "_ids", "_found")
    schema = StructType([df.schema[id_col], StructField(out, ArrayType(IntegerType()))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            flat = ids.flatten()
            flat = pc.replace_with_mask(flat, pc.is_null(flat), batch.column(2).flatten())
            offsets = np.append(0, np.cumsum(np.asarray(pc.list_value_length(ids)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=schema.names)

    return joined.mapInArrow(fill, schema)


def attention_mask(ids: Column) -> Column:
    """T6 (unpadded): one 1 per real token.  Ids and tokens are equally many,
    so the token array serves and nothing need be encoded for it."""
    return F.array_repeat(F.lit(1), F.size(ids))


def make_batches(df: DataFrame, id_col: str = "post_id", seed="batches", size: int = 16,
                 digits: int = 3) -> DataFrame:
    """Deterministic batch order, ``batch_id = position div size``.

    The position is a global index in ``md5(seed ':' id)`` order computed
    with per-bucket counts and offsets (no single-partition sort).
    """
    d = df.withColumn("_h", keyed_md5(F.lit(str(seed)), F.col(id_col)))
    idx = ordered_index(d, [], [], "_h", id_col, out_col="_pos", digits=digits)
    return idx.withColumn("batch_id", (F.col("_pos") / size).cast("bigint")).withColumn(
        "slot", (F.col("_pos") % size).cast("int")
    ).drop("_h", "_pos")


def pad_batches(df: DataFrame, ids: str = "ids", batch_col: str = "batch_id", pad_id: int = PAD_ID) -> DataFrame:
    """T8 + T6: pad ids to the longest row of *its* batch; 0/1 mask alongside."""
    w = Window.partitionBy(batch_col)
    n = F.size(F.col(ids))
    m = F.max(n).over(w)
    return df.withColumn("_n", n).withColumn("_m", m).withColumn(
        "attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), F.col("_m") - F.col("_n")))
    ).withColumn(
        ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), F.col("_m") - F.col("_n")))
    ).drop("_n", "_m")


def pack_labels(df: DataFrame, dims, kind: str = "multilabel", out: str = "labels") -> DataFrame:
    """Integer class (binary, first label) or a DOUBLE vector (multilabel).
    Rows without labels (NULL) keep a NULL target."""
    if kind == "binary":
        return df.withColumn(out, F.col(dims[0]).cast("int"))
    vec = F.array(*[F.col(d).cast("double") for d in dims])
    anynull = sum((F.col(d).isNull().cast("int") for d in dims[1:]), F.col(dims[0]).isNull().cast("int"))
    return df.withColumn(out, F.when(anynull == 0, vec))
