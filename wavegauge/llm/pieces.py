"""SentencePiece encoding by batched Viterbi, and decoding.

A text is cut into words, each with the blanks before it: no piece of such a model has a blank after
another character, so the best segmentation of a text is that of its words. Every different word is
segmented once. Words of equal length advance together, one end position at a time: the hashes of
all substrings that end there probe the sorted keys of the pieces, and the best score over the
substring lengths is kept with a pointer back. Characters without a piece fall back to bytes.

The segmentation is the one of largest total score, as a unigram model's encoder finds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import IdPool, Texts, byte_hashes, mix64, slices

BLANK = 0x2581
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
# Lower than the least piece score by this much: a character without a piece.
UNKNOWN_PENALTY = 10.0
FORBIDDEN, FLOOR = -1e8, 1e5
WORDS_AT_ONCE = 20_000
DECODE_IDS = 1 << 19


class Pieces:
    """Pieces of a model file: sorted substring keys with scores and ids, byte pieces, and spelling."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        spelling = [sp.id_to_piece(i) for i in normal]
        self.longest = max(map(len, spelling))
        codes, offsets = _codes(spelling)
        prefix = _prefix(codes)
        keys = _keys(prefix, offsets[:-1], np.diff(offsets))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        score = np.array([sp.get_score(i) for i in normal])[order]
        # Some models mark pieces as all but forbidden by -1e9; a floor keeps sums exact and their order.
        score = np.maximum(score, score[score > FORBIDDEN].min() - FLOOR)
        self.scores = score
        self.unknown = score.min() - UNKNOWN_PENALTY
        inner = np.flatnonzero(np.isin(np.arange(len(codes) - 1), offsets[1:] - 1, invert=True))
        self.pairs = np.unique(_pair(codes[inner], codes[inner + 1]))  # characters that stand together in some piece
        self.bytes = np.zeros(256, np.int64)
        spell = [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                spell[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                spell[i] = p.replace(chr(BLANK), " ").encode()
        self.spell_start = np.concatenate(([0], np.cumsum([len(x) for x in spell])))
        self.spell = np.frombuffer(b"".join(spell), np.uint8)
        self.pool = IdPool()

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from the front of code times a power of P, so that a substring's hash is a difference; inverse powers."""
    power = np.full(len(codes), _P)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(len(codes), np.uint64(pow(int(_P), -1, 1 << 64)))
    inverse[:1] = 1
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(codes.astype(np.uint64)) * power))), np.multiply.accumulate(inverse)


def _keys(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each substring, wherever it stands: the difference is divided by the power at its start."""
    sums, inverse = prefix
    return mix64((sums[start + length] - sums[start]) * inverse[start] + length.astype(np.uint64))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def _cut(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends)]


def viterbi(model: Pieces, codes: np.ndarray) -> list[np.ndarray]:
    """Best segmentation of words of equal length (rows of code points): the piece ids of each."""
    n, size = codes.shape
    flat = codes.ravel()
    prefix = _prefix(flat)
    base = np.arange(n) * size
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((size + 1, n), np.int64)
    piece = np.full((size + 1, n), -1, np.int64)
    widths = np.arange(min(model.longest, size), 0, -1)
    for end in range(1, size + 1):
        for w in widths[widths <= end]:  # the longest first; an equal score does not replace it
            found = model.find(_keys(prefix, base + end - w, np.full(n, w)))
            score = best[end - w] + np.where(found >= 0, model.scores[found], model.unknown if w == 1 else -np.inf)
            better = score > best[end]
            best[end][better], back[end][better], piece[end][better] = score[better], w, found[better]
    # Walk back, all words together.
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, live = np.full(n, size), np.arange(n)
    while live.size:
        w = back[at[live], live]
        steps.append((live, piece[at[live], live], at[live] - w))
        at[live] -= w
        live = live[at[live] > 0]
    row = np.concatenate([s[0] for s in steps])
    found = np.concatenate([s[1] for s in steps])
    where = np.concatenate([s[2] for s in steps])
    order = np.lexsort((where, row))
    row, found, where = row[order], found[order], where[order]
    out = model.ids[found]
    if (found < 0).any():
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in flat[base[row[found < 0]] + where[found < 0]].tolist()]
        lists = _cut(out, np.ones(len(out), np.int64))
        for i, b in zip(np.flatnonzero(found < 0), spelled):
            lists[i] = model.bytes[list(b)]
        sizes = np.array([len(x) for x in lists])
        return _cut(np.concatenate(lists), np.bincount(row, sizes, n).astype(np.int64))
    return _cut(out, np.bincount(row, minlength=n))


def segment(model: Pieces, words: list[str]) -> list[np.ndarray]:
    """Piece ids of each word (blanks as U+2581). Words are first cut where no piece could cross."""
    codes, offsets = _codes(words)
    if not len(codes):
        return [np.zeros(0, np.int64) for _ in words]
    pairs = _pair(codes[:-1], codes[1:])
    at = np.minimum(np.searchsorted(model.pairs, pairs), len(model.pairs) - 1)
    cuts = np.unique(np.concatenate((offsets, np.flatnonzero(model.pairs[at] != pairs) + 1)))
    start, length = cuts[:-1], np.diff(cuts)
    ids: list = [None] * len(start)
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        for lo in range(0, len(rows), WORDS_AT_ONCE):
            part = rows[lo : lo + WORDS_AT_ONCE]
            for i, x in zip(part.tolist(), viterbi(model, codes[start[part][:, None] + np.arange(size)])):
                ids[i] = x
    counts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    return _cut(np.concatenate(ids).astype(np.uint32), np.diff(counts[np.searchsorted(start, offsets)]))


def encode_texts(t: Texts, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each text has. A non-empty text gets a blank in front."""
    model = load_pieces(path)
    if model.pool.full:
        model.pool.clear()
    size = np.diff(t.start)
    ahead = np.cumsum(size > 0)  # blanks inserted up to and with each text
    start = np.concatenate(([0], t.start[1:] + ahead))
    data = np.full(int(start[-1]) + 8, 0x20, np.uint8)
    data[np.arange(len(t.data) - 8) + np.repeat(ahead, size)] = t.data[:-8]
    data[-8:] = 0
    body = data[:-8]
    # A word begins at a blank that follows no blank; every text begins with one.
    blank = body == 0x20
    begins = blank & ~np.concatenate(([False], blank[:-1]))
    begins[start[:-1][size > 0]] = True
    at = np.flatnonzero(begins)
    length = np.diff(np.append(at, len(body)))
    h = byte_hashes(data, at, length)

    def make(new: np.ndarray) -> list[np.ndarray]:
        return segment(model, [data[at[i] : at[i] + length[i]].tobytes().decode().replace(" ", chr(BLANK)) for i in new])

    ids, counts = model.pool.gather(model.pool.entries_of(h, make))
    total = np.concatenate(([0], np.cumsum(counts)))
    return ids, np.diff(total[np.searchsorted(at, start)])


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> list[str]:
    """Texts of id sequences: pieces and bytes are joined, the blank in front is dropped."""
    model = load_pieces(path)
    begin = model.spell_start[ids]
    size = model.spell_start[ids.astype(np.int64) + 1] - begin
    total = np.cumsum(size)
    raw = model.spell[np.repeat(begin - total + size, size) + np.arange(total[-1] if len(total) else 0)].tobytes()
    edge = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:])]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column("text")):
                ids, counts = encode_texts(t, path)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(i).slice(t.first, t.count) for i in range(b.num_columns)] + [lists], [*b.schema.names, "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            lists = b.column("ids")
            counts = np.asarray(lists.value_lengths().fill_null(0))
            ids = np.asarray(lists.flatten())
            ends = np.concatenate(([0], np.cumsum(counts)))
            texts: list[str] = []
            while len(texts) < len(counts):  # a bounded number of ids at a time, one text at least
                lo = len(texts)
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + DECODE_IDS, "right")) - 1)
                texts += decode_ids(ids[ends[lo] : ends[hi]].astype(np.int64), counts[lo:hi], path)
            names = [n for n in b.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(texts, pa.string())], [*names, "decoded"])

    return run


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and ids (array of int) of every whole text.

    NULL or empty text gives no ids. Rows are independent, so repeated rows give equal ids. An empty
    table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return base.mapInArrow(_encode(path), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """Replace column ``ids`` by ``decoded``, the text they spell; NULL ids give an empty text.

    Encoding then decoding returns every text unchanged, but U+2581 comes back as a blank.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids"]
    return encoded.mapInArrow(_decode(path), ", ".join([*fields, "decoded string"]))
