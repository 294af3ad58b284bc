"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A model's pieces become a pair table: (left symbol, right symbol) -> merged
symbol and rank.  All units (white-space words) of a batch lie in one flat
symbol array.  Each round looks up every adjacent pair, takes the segmented
minimum rank of each unit, merges there (leftmost first) in all units at
once, and compacts the array; a unit leaves when no pair remains.  Units are
independent because no piece of the model holds a word start after another
character, which is checked when the model is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cvframe.llm.common import fresh

SPACE = "▁"
CACHE_UNITS = 300_000        # units remembered by one worker; forgetting only costs time
BATCH_BYTES = 4 << 20        # text bytes encoded at once
LONG_UNIT = 64               # longer words are cut where nothing can merge
NO_RANK = np.int64(1) << 30


class PieceModel:
    """Tables of one BPE model with identity normalisation and byte fallback."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        spec, norm = m.trainer_spec, m.normalizer_spec
        if (spec.model_type != 2 or not spec.byte_fallback or spec.treat_whitespace_as_suffix or norm.precompiled_charsmap
                or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or m.denormalizer_spec.precompiled_charsmap):
            raise ValueError("only BPE models with identity normalisation, dummy prefix and byte fallback are supported")
        names = [p.piece for p in m.pieces]
        kinds = [p.type for p in m.pieces]
        if 4 in kinds or 5 in kinds:
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal = {p: i for i, p in enumerate(names) if kinds[i] == 1}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces that reach across words are not supported")
        self.byte_id = np.array([names.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # symbols: vocabulary ids, then characters that occur only inside longer pieces
        chars = {c for p in normal for c in p} - set(normal)
        self.symbol = dict(normal) | {c: len(names) + k for k, c in enumerate(sorted(chars))}
        self.n_vocab = len(names)
        self.n_symbols = len(names) + len(chars)
        scores = np.array([p.score for p in m.pieces], np.float32)
        levels, rank = np.unique(-scores.astype(np.float64), return_inverse=True)
        shared = np.bincount(rank[list(normal.values())], minlength=len(levels))
        keys, merged = [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.n_symbols + b)
                    merged.append(i)
        order = np.argsort(keys)
        self.pair_key = np.array(keys, np.int64)[order]
        self.pair_to = np.array(merged, np.int32)[order]
        self.pair_rank = rank[self.pair_to].astype(np.int64)
        # a piece is safe if its score is its own and no pair with it as a part ranks before it:
        # then all its occurrences in a unit can be merged in one round
        safe = np.ones(self.n_symbols, bool)
        safe[:len(names)] = shared[rank] <= 1
        for side in (self.pair_key // self.n_symbols, self.pair_key % self.n_symbols):
            own = np.where(side < len(names), rank[np.minimum(side, len(names) - 1)], -1)
            safe[side[self.pair_rank <= own]] = False
        self.safe = safe
        runs = sorted(len(p) for p in normal if set(p) == {SPACE} and len(p) > 1)
        lowest = max((rank[normal[SPACE * n]] for n in runs), default=-1)
        plain = [i for p, i in normal.items() if set(p) != {SPACE} and len(p) > 1]
        self.run = 0                 # longest run of spaces that is a piece, if runs are filled from the left
        alone = not any(p.startswith(SPACE * 2) and set(p) != {SPACE} for p in normal)
        tied = len({rank[normal[SPACE * n]] for n in runs}) == 1
        if runs and alone and tied and lowest > max(rank[plain], default=-1):
            top = runs[-1]           # checked on runs of up to four such pieces
            ids = self.encode_units([" " * k for k in range(1, 4 * top + 1)])
            if all(ids[k - 1] == ids[top - 1] * ((k - 1) // top) + ids[(k - 1) % top] for k in range(1, 4 * top + 1)):
                self.run = top
        # two characters that are neighbours in no piece: nothing merges across them
        self.neighbours = {p[i:i + 2] for p in normal for i in range(len(p) - 1)}
        self.surface = [
            b"" if k == 3 else m.trainer_spec.unk_surface.encode() if k == 2 else p.replace(SPACE, " ").encode()
            for p, k in zip(names, kinds)]
        self.is_byte = np.array([k == 6 for k in kinds])
        self.is_control = np.array([k == 3 for k in kinds])
        for b in range(256):
            self.surface[self.byte_id[b]] = bytes([b])
        self.names, self.kinds = names, kinds

    # --- encoding -----------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """Independent units that spell the text with its dummy prefix.

        A unit is a word that stands for itself and the space mark before it
        (blanks in front of it are further marks), a run of blanks, or, with
        a leading mark, a stretch of a long word as it is."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        words = text.split(" ")
        if "" in words:
            out, run = [], 0
            for k, w in enumerate(words):
                run += 1                                    # the space before this word
                if w or k == len(words) - 1:
                    while self.run and run > self.run:      # whole runs from the left
                        out.append(" " * self.run)
                        run -= self.run
                    out.append(" " * (run - 1) + w if w else " " * run)
                    run = 0
            words = out
        if max(map(len, words)) <= LONG_UNIT:
            return words
        return [p for w in words for p in (self._cut(w) if len(w) > LONG_UNIT and w.strip(" ") else (w,))]

    def _cut(self, word: str) -> list[str]:
        s = SPACE + word.replace(" ", SPACE)
        cuts = [0, *(i for i in range(1, len(s)) if s[i - 1:i + 1] not in self.neighbours), len(s)]
        return [SPACE + s[a:b] for a, b in zip(cuts, cuts[1:])]

    def _spelled(self, unit: str) -> str:
        if unit[0] == SPACE:
            return unit[1:]
        s = unit.replace(" ", SPACE)
        return s if unit[-1] == " " and not unit.strip(" ") else SPACE + s

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of each unit."""
        n = len(units)
        flat: list[int] = []
        text: list[str] = []
        sizes = np.empty(n, np.int64)
        get = self.symbol.get
        for i, u in enumerate(units):
            s = self._spelled(u)
            flat += [get(c, -1) for c in s]
            text.append(s)
            sizes[i] = len(s)
        sym = np.array(flat, np.int64)
        # code point of every symbol that is not in the vocabulary, for byte fallback
        code = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        unit = np.repeat(np.arange(n), sizes)
        done_sym, done_unit, done_code = [], [], []
        while len(sym):
            pair = np.full(len(sym), NO_RANK)
            to = np.full(len(sym), -1, np.int32)
            near = np.flatnonzero((unit[1:] == unit[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0))
            key = sym[near] * self.n_symbols + sym[near + 1]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            hit = self.pair_key[at] == key
            pair[near[hit]] = self.pair_rank[at[hit]]
            to[near[hit]] = self.pair_to[at[hit]]
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat((pair << 32) + np.arange(len(sym)), first)
            active = (best >> 32) < NO_RANK
            if not active.all():       # units with no pair left are finished
                size = np.diff(np.concatenate([first, [len(sym)]]))
                stay = np.repeat(active, size)
                done_sym.append(sym[~stay])
                done_unit.append(unit[~stay])
                done_code.append(code[~stay])
                if not active.any():
                    break
                shift = np.cumsum(stay) - 1
                best = (best[active] >> 32 << 32) + shift[best[active] & 0xFFFFFFFF]
                sym, unit, code, pair, to = sym[stay], unit[stay], code[stay], pair[stay], to[stay]
                first = shift[first[active]]
            left = best & 0xFFFFFFFF
            size = np.diff(np.concatenate([first, [len(sym)]]))
            # every occurrence of a safe piece, the leftmost one of any other
            wanted = np.repeat(np.where(self.safe[to[left]], to[left], -2), size)
            take = to == wanted
            if take.any():             # of overlapping occurrences every second one, from the left
                start = np.flatnonzero(take & ~np.concatenate([[False], take[:-1] & (unit[1:] == unit[:-1])]))
                run = np.cumsum(np.bincount(start, minlength=len(take))) - 1
                take &= (np.arange(len(take)) - start[np.maximum(run, 0)]) % 2 == 0
            take[left] = True
            where = np.flatnonzero(take)
            sym[where] = to[where]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            sym, unit, code = sym[keep], unit[keep], code[keep]
        if not done_sym:
            return [b""] * n
        sym, unit, code = (np.concatenate(x) for x in (done_sym, done_unit, done_code))
        order = np.argsort(unit, kind="stable")
        sym, unit, code = sym[order], unit[order], code[order]
        odd = np.flatnonzero((sym < 0) | (sym >= self.n_vocab))
        if len(odd):                   # byte fallback
            reps = np.ones(len(sym), np.int64)
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[odd].tolist()]
            reps[odd] = [len(r) for r in raw]
            slot = np.repeat((sym < 0) | (sym >= self.n_vocab), reps)
            sym, unit = np.repeat(sym, reps), np.repeat(unit, reps)
            sym[slot] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        out = sym.astype("<i4").tobytes()
        ends = np.cumsum(np.bincount(unit, minlength=n)) * 4
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    # --- decoding -----------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: control pieces are silent, one leading space goes."""
        if not len(ids):
            return ""
        parts = list(map(self.surface.__getitem__, ids.tolist()))
        first = 0
        while first < len(parts) and self.is_control[ids[first]]:
            first += 1
        if first < len(parts) and not self.is_byte[ids[first]] and self.kinds[ids[first]] == 1 and parts[first][:1] == b" ":
            parts[first] = parts[first][1:]
        try:
            return b"".join(parts).decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_invalid(ids, parts)

    def _decode_invalid(self, ids: np.ndarray, parts: list[bytes]) -> str:
        """Runs of byte pieces: valid characters as such, any other byte U+FFFD."""
        out: list[str] = []
        i = 0
        while i < len(parts):
            if not self.is_byte[ids[i]]:
                out.append(parts[i].decode("utf-8"))
                i += 1
                continue
            j = i
            while j < len(parts) and self.is_byte[ids[j]]:
                j += 1
            raw = b"".join(parts[i:j])
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at:at + n].decode("utf-8"))
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            i = j
        return "".join(out)


class Encoder:
    """A model with a bounded memory of units already encoded."""

    def __init__(self, proto: bytes, limit: int = CACHE_UNITS):
        self.model, self.limit, self.known = PieceModel(proto), limit, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of each text."""
        units = [self.model.units(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        new = list({u for us in units for u in us if u not in known})
        for a in range(0, len(new), 100_000):
            part = new[a:a + 100_000]
            known.update(zip(part, self.model.encode_units(part)))
        get = known.__getitem__
        return [b"".join(map(get, us)) for us in units]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(proto: bytes) -> Encoder:
    """One encoder per worker process, kept from task to task."""
    key = hashlib.sha256(proto).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(proto)
    return _ENCODERS[key]


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes (one row at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    a = 0
    while a < len(size):
        n = int(np.searchsorted(np.cumsum(size[a:]), limit, "right"))
        yield a, a + max(1, n)
        a += max(1, n)


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns, the last ones: ids and decoded.

    ``ids`` (array of int) is what the sentencepiece library gives for the
    whole text without begin and end ids; ``decoded`` is decode(ids).  NULL
    and empty texts have no ids and decode to the empty text.  Rows are
    independent: repeated rows, NULLs in other columns and any extra columns
    pass through (the new names get a suffix if they are taken), an empty
    table stays empty, and a very long text is encoded whole.

    The driver reads the model file (half a megabyte, a fixed size) and
    sends its bytes along, so executors need no copy of it."""
    with open(model_path, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    at = docs.columns.index(text_col)
    ids_name = fresh(docs, "ids")
    decoded_name = fresh(docs, "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_name, T.ArrayType(T.IntegerType(), False)),
                           T.StructField(decoded_name, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(proto.value)
        for batch in batches:
            for a, b in _slices(batch.column(at), BATCH_BYTES):
                rows = batch.slice(a, b - a)
                ids = enc.encode([t or "" for t in rows.column(at).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                decoded = [enc.model.decode(np.frombuffer(x, "<i4")) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(decoded, pa.string())],
                    names=schema.names)

    return docs.mapInArrow(work, schema)
