"""SentencePiece encoding and decoding with batched Viterbi.

A text is written as one dummy mark, then the text with spaces as marks (U+2581). No piece has a mark after another
character, so the text falls apart before marks that follow other characters, and each stretch (a word) is encoded by itself: the pieces
with the highest sum of scores. Equal-length words of a batch advance together: hashes of all their substrings of one length probe the
sorted hashes of the pieces, and the maximum over the lengths is taken for all words at once and stored as a back pointer. Among
equal sums the longer last piece wins. A character without a piece costs ``UNKNOWN`` below the lowest score and becomes its bytes
(or the unknown id if the model has no byte pieces).

Words recur, so a task keeps the pieces of the last ``MEMORY`` distinct words; texts are whole, of any length. A long word is worked through in
windows of ``WINDOW`` characters: scores of pieces are held for one window, a back pointer and a piece for each character.
Words are cut, and decoded ids compared with the text, as arrays of bytes.

Defined cases: a null text gives null ids, an empty one none; U+2581 in a text is a space in the decoded one, and lone bytes that are no UTF-8
become U+FFFD; ids that are null or out of range are left out in decoding; repeated rows get equal results; an empty table
gives none; all columns of the input stay, replaced where the names clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinlens.llm.common import text_slices, utf8

MARK, UNKNOWN, MEMORY = "▁", 10.0, 400_000
#: Elements of the largest array of a batch of words, characters of a long word that are looked at together, bytes of text, and bytes of text
#: that are compared together.
CELLS, WINDOW, PART, COMPARED = 1 << 20, 2048, 1 << 20, 1 << 17
_ODD = 0x9E3779B97F4A7C15


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes (length + 1, n) of columns of code points."""
    out = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
    for j in range(codes.shape[0]):
        out[j + 1] = out[j] * np.uint64(_ODD) + codes[j] + np.uint64(1)
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a column for each word."""
    return np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).T)


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    #: Kinds of pieces in a model file (fixed values).
    NORMAL, UNK, BYTE = 1, 2, 6

    def __post_init__(self):
        usable = np.flatnonzero(self.kinds == self.NORMAL)
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        keys = np.array([_hash(_codes([self.pieces[i]]))[-1, 0] for i in usable], np.uint64)
        # the first of equal pieces counts
        self.keys, first = np.unique(keys, return_index=True)
        self.ids = usable[first].astype(np.int32)
        self.value = self.scores[self.ids]
        self.unknown = float(self.scores[usable].min(initial=0.0)) - UNKNOWN
        self.bytes = np.full(256, -1, np.int32)
        for i in np.flatnonzero(self.kinds == self.BYTE):
            self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.unk = int(np.flatnonzero(self.kinds == self.UNK)[0]) if (self.kinds == self.UNK).any() else 0
        self.raw = [b"" if k not in (self.NORMAL, self.BYTE) else bytes([int(p[3:5], 16)]) if k == self.BYTE else p.encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score or -inf, index among the usable pieces) of substring hashes."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(keys.shape, bool)
        return np.where(hit, self.value[at] if len(self.keys) else 0.0, -np.inf), at

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each word (none of them empty)."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, members in by_length.items():
            step = max(1, CELLS // (min(length, WINDOW) * min(length, self.longest)))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for k, ids in zip(part, self._viterbi([words[k] for k in part], length), strict=True):
                    out[k] = ids
        return out

    def _viterbi(self, words: list[str], length: int) -> list[np.ndarray]:
        n, most = len(words), min(length, self.longest)
        # words lie side by side in every array, so that a step over all of them reads memory in order
        sums = _hash(_codes(words))
        powers = [np.uint64(pow(_ODD, size, 1 << 64)) for size in range(most + 1)]
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((length, n), np.int16), np.zeros((length, n), np.int32)
        rows = np.arange(n)
        for low in range(0, length, WINDOW):
            high = min(low + WINDOW, length)
            score = np.full((most, high - low, n), -np.inf)  # of the piece of l + 1 characters that ends at j
            own = np.full((most, high - low, n), -1, np.int32)
            for size in range(1, most + 1):
                first = max(size, low + 1)
                if first <= high:
                    s, at = self.probe(sums[first : high + 1] - sums[first - size : high + 1 - size] * powers[size])
                    score[size - 1, first - low - 1 :] = s
                    own[size - 1, first - low - 1 :] = at
            lone = np.isneginf(score[0])
            score[0][lone] = self.unknown
            own[0][lone] = -1
            for j in range(low, high):
                upto = min(most, j + 1)
                # the longest piece comes first, so it wins among equals
                sums_ = score[upto - 1 :: -1, j - low] + best[j - upto + 1 : j + 1]
                pick = sums_.argmax(0)
                best[j + 1] = sums_[pick, rows]
                back[j] = upto - 1 - pick
                piece[j] = own[upto - 1 - pick, j - low, rows]
        # back from the ends, all words together
        steps, end = [], np.full(n, length)
        while (end > 0).any():
            live = end > 0
            last = np.where(live, end - 1, 0)
            size, found = back[last, rows], piece[last, rows]
            steps.append(np.where(live, np.where(found >= 0, found, -2 - last), -1))
            end = np.where(live, last - size, 0)
        table = np.array(steps[::-1]).T
        used = table != -1
        ends = np.cumsum(used.sum(1))
        flat = table[used]
        ids = self.ids[np.maximum(flat, 0)] if len(self.ids) else np.zeros(len(flat), np.int32)
        out = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for k in np.flatnonzero((table < -1).any(1)):
            row = table[k][used[k]]
            out[k] = np.concatenate([self._spelled(words[k][-2 - r]) if r < 0 else self.ids[r : r + 1] for r in row])
        return out

    def _spelled(self, char: str) -> np.ndarray:
        ids = self.bytes[list(char.encode("utf-8", "surrogatepass"))]
        return ids if (ids >= 0).all() else np.array([self.unk], np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.raw[i] for i in ids.tolist() if i is not None and 0 <= i < len(self.raw)]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file; the file is read on the driver only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = np.array([Vocabulary.BYTE if model.is_byte(i) else Vocabulary.UNK if model.is_unknown(i) else 3 if model.is_control(i) or model.is_unused(i) else Vocabulary.NORMAL for i in range(n)])
    pieces = [model.id_to_piece(i) for i in range(n)]
    if any(k == Vocabulary.NORMAL and MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds, strict=True)):
        raise ValueError("the model has a piece with a mark after another character, so its words can't be encoded by themselves")
    return Vocabulary(pieces, np.array([model.get_score(i) for i in range(n)], float), kinds)


def marked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, marks as blanks and one blank before each text that is not empty, and their bounds."""
    data, bounds = utf8(pc.replace_substring(column, MARK, " "))
    full = np.diff(bounds) > 0
    ends = np.concatenate([[0], np.cumsum(np.diff(bounds) + full)])
    out = np.full(ends[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(full), np.diff(bounds))] = data
    return out, ends


class Encoder:
    """Encodes texts of a task; remembers the pieces of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        # what an id stands for, blanks for marks
        raw = [r.replace(MARK.encode(), b" ") for r in vocabulary.raw]
        self.raw, self.raw_ends = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of the texts) of ``marked`` texts. A word begins at a blank that follows another
        character or begins a text, so words lie end to end."""
        if len(self.known) > MEMORY:
            self.known, self.flat, self.bounds = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            ids = self.vocabulary.encode_words([w.decode().replace(" ", MARK) for w in new])
            self.known |= zip(new, range(len(self.known), len(self.known) + len(new)), strict=True)
            self.flat = np.concatenate([self.flat, *ids])
            self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in ids]))
        slot = np.array([self.known[w] for w in words], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.bounds[slot + 1] - self.bounds[slot]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        # piece k of a word stands at the word's first piece plus k
        take = np.arange(total) + np.repeat(self.bounds[slot] - (ends - size), size)
        return self.flat[take], np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]

    def same(self, ids: np.ndarray, id_bounds: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether the ids of each text give its bytes back; texts of about ``COMPARED`` bytes at a time, or one longer text."""
        out = np.empty(len(bounds) - 1, bool)
        start = 0
        while start < len(out):
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + COMPARED, "right")) - 1)
            out[start:stop] = self._same(ids[id_bounds[start] : id_bounds[stop]], id_bounds[start : stop + 1] - id_bounds[start], data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start])
            start = stop
        return out

    def _same(self, ids: np.ndarray, id_bounds: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        size = self.raw_ends[ids + 1] - self.raw_ends[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        back = self.raw[np.arange(ends[-1]) + np.repeat(self.raw_ends[ids] - ends[:-1], size)]
        per = ends[id_bounds]
        if (per == bounds).all():
            wrong = np.concatenate([[0], np.cumsum(back != data)])
            return wrong[bounds[1:]] == wrong[bounds[:-1]]
        return np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(per[:-1], per[1:], bounds[:-1], bounds[1:], strict=True)], bool)


def encode(docs: DataFrame, vocabulary: Vocabulary, check: bool = False, texts: bool = True) -> DataFrame:
    """``docs`` with ids (array<int>) and n_ids; with ``check`` also same: whether the ids decode to the text. Without ``texts`` the
    column text is left out, and the texts are not sent back from the Python workers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = docs.drop("ids", "n_ids", "same")
    kept = [k for k, f in enumerate(out.schema.fields) if texts or f.name != "text"]
    fields = [*(out.schema.fields[k] for k in kept), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType())]
    schema = T.StructType([*fields, T.StructField("same", T.BooleanType())] if check else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part, _, _ in text_slices(batches, "text", PART):
            column = part.column(part.schema.get_field_index("text"))
            data, bounds = marked(column)
            ids, ends = encoder.encode(data, bounds)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=column.is_null())
            columns = [*(part.column(k) for k in kept), lists, pa.array(np.diff(ends))]
            if check:
                columns.append(pa.array(encoder.same(ids, ends, data, bounds)))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return out.mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``coded`` with text, from ids."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)
    out = coded.drop("text")
    schema = T.StructType([*out.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = part.column(part.schema.get_field_index("ids")).to_pylist()
            texts = [None if r is None else shared.value.decode(np.array(r, object)) for r in rows]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return out.mapInArrow(run, schema)
