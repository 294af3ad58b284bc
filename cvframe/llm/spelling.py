"""Spelling variants: words one edit apart, grouped under the frequent form.

1. Word counts are one aggregate over all texts.
2. Two words one edit apart share, whole, the first or the second half of
   either; so every word goes to the groups of its halves (and of the
   halves that words one symbol longer or shorter would have), as a word
   that can be found and, for its own two halves, as a word to search.
   Groups are hashed into shards of bounded size; a half that more words
   share than a shard holds is dealt into blocks, every block of searched
   words against every block of found ones.
3. A shard's task indexes its words (``fm_index``) and searches both halves
   with one error.  It returns per searched word how many were found and the
   most frequent one; further parts of a word are added up.
4. Forms are followed by pointer doubling: a form is at least ``ratio``
   times as frequent, so chains are short and end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvframe.llm.common import quoted, written
from cvframe.llm.fm_index import Vocabulary

LETTERS = r"A-Za-zÀ-ÿ"
SHARD_ROWS = 1 << 15


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    capitals = "".join(chr(65 + i) for i in range(26))
    return F.when(text.rlike("[A-Z]"), F.translate(text, capitals, capitals.lower())).otherwise(text)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2,
                slip: int = 31) -> DataFrame:
    """(word, n): lower-cased letter runs of whole texts, slips included.

    Where ``slip`` divides the unsigned crc32 h of ``<id>:<run>`` the run
    loses its code point h % length.  NULL texts have no run; a NULL id
    counts as empty text."""
    # a shorter run cannot become a word, and a run is matched from its first letter or not at all
    found = F.regexp_extract_all(quoted(text_col), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.select("doc", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.col("doc"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select("run", h.alias("h")).select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def _halves() -> Column:
    """Keys of a word: (key, scheme); scheme 1 or 2 where the key is the
    word's own first or second half, 0 where it is a neighbour's."""
    size = F.length("word")
    parts = []
    for longer in (-1, 0, 1):
        first = F.floor((size + longer) / 2)
        second = size + longer - first
        parts.append(F.struct(F.concat(F.lit("<"), F.substring("word", F.lit(1), first)).alias("key"),
                              F.lit(0 if longer else 1).alias("scheme")))
        parts.append(F.struct(F.concat(F.lit(">"), F.right("word", second)).alias("key"),
                              F.lit(0 if longer else 2).alias("scheme")))
    # a neighbour's half may equal the own one: each key once, the own ones with their scheme
    own = F.array(parts[2], parts[3])
    others = F.array_distinct(F.array(parts[0], parts[1], parts[4], parts[5]))
    return F.concat(own, F.filter(others, lambda x: ~F.array_contains(F.transform(own, lambda o: o["key"]), x["key"])))


def _search(rows: pa.Table) -> pa.Table:
    """Per searched word of one shard: how many words are near, and the first
    by frequency (ties to the smaller word)."""
    words, n = rows["word"], rows["n"].to_numpy()
    found = rows["found"].to_numpy()
    scheme = rows["scheme"].to_numpy()
    indexed = pa.table([words.filter(pa.array(found)), pa.array(n[found])], names=["word", "n"])
    indexed = indexed.group_by("word").aggregate([("n", "max")]).sort_by("word")
    names, times = indexed["word"].combine_chunks(), indexed["n_max"].to_numpy()
    out = []
    searched = words.to_pylist()
    index = Vocabulary(names.to_pylist(), [w for w, f in zip(searched, found.tolist()) if not f])
    for half in (1, 2):
        at = np.flatnonzero(scheme == half)
        who, rank = index.near([searched[i] for i in at], half == 1)
        order = np.lexsort((rank, -times[rank], who))
        who, rank = who[order], rank[order]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        best = np.full(len(at), -1)
        best[who[first]] = rank[first]
        none = pa.array(best < 0)
        out.append(pa.table([words.take(pa.array(at)), pa.array(n[at]), pa.array(np.bincount(who, minlength=len(at))),
                             names.take(pa.array(best, mask=best < 0)),
                             pa.array(np.append(times, 0)[best], mask=none.to_numpy(zero_copy_only=False))],
                            names=["word", "n", "n_near", "best", "best_n"]))
    return pa.concat_tables(out)


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n, n_near, best, best_n) for distinct ``words`` (word, n):
    how many words are one edit away and the most frequent of them."""
    keyed = words.select("word", "n", F.inline(_halves()))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > shard_rows)
    # at most one key in shard_rows rows is that large
    hot = F.broadcast(sizes.select("key", F.ceil(F.col("rows") / shard_rows).cast("int").alias("blocks")))
    keyed = keyed.join(hot, "key", "left")
    total = words.agg(F.count(F.lit(1))).first()[0]
    shards = max(1, -(-6 * total // shard_rows))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    none = F.lit(None).cast("string")
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    cool = keyed.where(F.col("blocks").isNull()).select(
        none.alias("hot"), shard.alias("i"), F.lit(0).alias("j"), "word", "n", F.lit(True).alias("found"), "scheme")
    split = keyed.where(F.col("blocks").isNotNull())
    there = split.select(F.col("key").alias("hot"), own.alias("i"), F.explode(every).alias("j"), "word", "n",
                         F.lit(True).alias("found"), F.lit(0).alias("scheme"))
    asked = split.where("scheme > 0").select(F.col("key").alias("hot"), F.explode(every).alias("i"), own.alias("j"), "word", "n",
                                             F.lit(False).alias("found"), "scheme")
    rows = cool.unionByName(there).unionByName(asked)
    parts = rows.groupBy("hot", "i", "j").applyInArrow(_search, "word string, n long, n_near long, best string, best_n long")
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    near = parts.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("b"))
    return near.select("word", "n", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form) links without cycles, by doubling."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = now.join(onward, "root", "left")
        new = written(new.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct ``words`` (word, n).

    Words are near if one inserted, deleted or replaced code point makes them
    equal.  The form is the near word of largest n (ties: the first in
    code-point order) if that n is at least ``ratio`` times the word's n,
    else NULL; the root is where following forms ends, the word itself if it
    has none.  NULL words are left out; repeated words count once, with their
    largest n; an empty table gives no rows.  Words of any length and script
    are handled; columns other than word and n are not read."""
    words = words.where("word IS NOT NULL AND length(word) > 0").groupBy("word").agg(F.max("n").alias("n"))
    words = written(words, "words")
    near = near_words(words, shard_rows)
    strong = F.col("best_n") >= F.lit(ratio) * F.col("n")
    near = near.select("word", "n", "n_near", F.when(strong, F.col("best")).alias("form"),
                       F.when(strong, F.col("best_n")).alias("form_n"))
    near = written(near, "near")
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2,
             slip: int = 31, ratio: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``group_variants`` of the ``word_counts`` of documents.

    NULL and empty texts have no words, whole texts of any length count, each
    repeated row counts anew, an empty table gives no rows.  Only the two
    named columns are read."""
    return group_variants(word_counts(docs, id_col, text_col, min_length, min_count, slip), ratio, shard_rows)


#: crc32 by its table (reflected polynomial 0xEDB88320); near words by what is left after one deletion.
ORACLE = """
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]{7,}')) AS run FROM documents),
per AS (SELECT doc, run, count(*) AS k FROM runs GROUP BY 1, 2),
bytes AS (SELECT *, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
         ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END)) AS b FROM per),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b),
    lambda h, x: xor(h // 256, list_extract(t, CAST(xor(h, x) % 256 AS BIGINT) + 1))), 4294967295) AS h FROM bytes, crc),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN v b ON a.rest = b.word
         UNION SELECT b.word, b.n, a.word, a.n FROM d a JOIN v b ON a.rest = b.word),
best AS (SELECT word, n, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1, 2),
formed AS (SELECT b.word, min(x.other) AS form, any_value(b.m) AS form_n FROM best b JOIN near x ON x.word = b.word AND x.m = b.m
           WHERE b.m >= 10 * b.n GROUP BY 1),
chain AS (SELECT word, form AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root),
ended AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM formed))
SELECT v.word, f.form, coalesce(e.root, v.word) AS root, v.n, coalesce(b.n_near, 0) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM v LEFT JOIN best b USING (word) LEFT JOIN formed f USING (word) LEFT JOIN ended e USING (word)
"""
