"""Quality rules on repetition: suffix arrays of whole texts over their words.

The words of each text become integers, all suffixes of all texts of a piece are sorted together by
prefix doubling (a suffix never meets one of another text), and the longest common prefix of
neighbouring suffixes is read off the ranks of the doubling rounds. Intervals of the prefix lengths
are the repeated substrings; those that cannot be extended to either side are the maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACE, Texts, slices, words

# Characters counted as symbols, words of a text at least, window and share of repeated windows.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3
MAX_WINDOW_PERCENT = 50
# A substring counts as a repeat from this many words on: longer than a boilerplate line that occurs twice.
REPEAT_WORDS = 15
# Repeats may cover at most this share of the words, and none may be longer than this many words.
MAX_COVERED_PERCENT = 30
MAX_REPEAT_WORDS = 50


def word_codes(data: np.ndarray, start: np.ndarray, length: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """A number for each byte string, equal for equal ones, and the strings by number.

    ``whole`` tells, by byte, what the strings hold where they hold all such bytes of ``data`` (but for its padding).
    """
    ends = np.concatenate(([0], np.cumsum(length)))
    if whole is not None:
        held = data[:-8][whole[data[:-8]]]
    else:
        held = data[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
    strings = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(held)])
    coded = strings.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


@dataclass
class Suffixes:
    """Sorted suffixes of texts: their first words, and the prefix that each shares with the one before it."""

    order: np.ndarray
    lcp: np.ndarray
    text: np.ndarray  # text of each word
    codes: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, first: np.ndarray) -> "Suffixes":
        """``codes`` are the words of consecutive texts, text i from word ``first[i]`` on."""
        n = len(codes)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        end = first[1:][text]
        key = text * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        head = np.append(True, key[order][1:] != key[order][:-1])[:n]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        levels, size = [rank.astype(np.int32)], 1
        alone = head & np.append(head[1:], True)[:n]
        tied = np.flatnonzero(~alone)  # slots of the order that are still to be parted
        while tied.size:
            at = order[tied]
            then = np.where(at + size < end[at], rank[np.minimum(at + size, n - 1)] + 1, 0)
            by = np.lexsort((then, rank[at]))
            at, then = at[by], then[by]
            new = np.append(True, (rank[at][1:] != rank[at][:-1]) | (then[1:] != then[:-1]))
            order[tied] = at
            slot = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
            rank[at] = tied[slot]
            levels.append(rank.astype(np.int32))
            tied = tied[~(new & np.append(new[1:], True))]
            size *= 2
        lcp = np.zeros(n, np.int64)
        same = np.flatnonzero(~head)
        a, b = order[same - 1], order[same]
        shared = np.zeros(len(same), np.int64)
        for i in range(len(levels) - 1, -1, -1):
            x, y = a + shared, b + shared
            inside = (x < end[a]) & (y < end[b])
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            shared += np.where(inside & (levels[i][x] == levels[i][y]), 1 << i, 0)
        lcp[same] = shared
        return cls(order, lcp, text, codes)

    def longest(self) -> np.ndarray:
        """Words of the longest substring that starts at each word and occurs again in its text."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.maximum(self.lcp, np.append(self.lcp[1:], 0))
        return out

    def covered(self, least: int) -> np.ndarray:
        """Whether each word lies in a repeat of ``least`` words or more: the union of the maximal repeats.

        A repeat that could be extended lies inside one that cannot, so the longest repeat at each word suffices.
        """
        long = self.longest()
        start = np.flatnonzero(long >= least)
        change = np.zeros(len(long) + 1, np.int64)
        change[start] += 1
        np.subtract.at(change, start + long[start], 1)
        return np.cumsum(change[:-1]) > 0

    def maximal(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal repeated substrings: (first word of one occurrence, words, occurrences).

        Each interval of prefix lengths reaches from the last smaller value before to the first smaller one
        after; of those, the ones whose occurrences do not all follow the same word stay.
        """
        n = len(self.lcp)
        live = np.flatnonzero(self.lcp >= least)
        low = np.append(self.lcp, -1)
        left, right = live - 1, live + 1
        # Jump over values that are not smaller, by what their own jumps have reached so far.
        jump_l, jump_r = np.arange(n) - 1, np.arange(n) + 1
        for side, jump, at in (("l", jump_l, left), ("r", jump_r, right)):
            while True:
                far = low[at] >= self.lcp[live] if side == "r" else (at >= 0) & (low[at] >= self.lcp[live])
                if not far.any():
                    break
                at[far] = jump[at[far]]
                jump[live] = at
        before = np.where(self.order > 0, self.codes[self.order - 1], -1)
        opening = np.append(True, self.text[1:] != self.text[:-1])[:n][self.order] if n else np.zeros(0, bool)
        differs = np.cumsum(np.append(False, (before[1:] != before[:-1]) | opening[1:] | opening[:-1])[:n])
        first, last = left, right - 1  # slots of the first and last suffix of the interval
        whole = differs[last] > differs[first] if len(live) else np.zeros(0, bool)
        found = np.unique(np.stack([first[whole], last[whole], self.lcp[live][whole]], 1), axis=0) if whole.any() else np.zeros((0, 3), np.int64)
        return self.order[found[:, 0]], found[:, 2], found[:, 1] - found[:, 0] + 1


def _per_text(text: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text, weight, n).astype(np.int64)


def line_repeats(t: Texts) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of the text."""
    body = t.data[:-8]
    breaks = np.flatnonzero(body == 10)
    start = np.sort(np.concatenate((t.start[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((breaks, t.start[1:])), kind="stable")
    per_text = np.diff(np.searchsorted(breaks, t.start)) + 1
    text = np.repeat(np.arange(t.count), per_text)
    solid = np.concatenate(([0], np.cumsum(~SPACE[body])))
    real = np.flatnonzero(solid[end] > solid[start])
    if not len(real):
        return np.zeros(t.count, np.int64)
    code, _ = word_codes(body, start[real], (end - start)[real])
    key = text[real] * (int(code.max()) + 1) + code
    return _per_text(text[real], t.count) - _per_text(np.unique(key) // (int(code.max()) + 1), t.count)


def text_statistics(t: Texts, least: int = REPEAT_WORDS) -> dict[str, np.ndarray]:
    """Counts of words, characters, symbols, repeated lines, windows and substrings of each text."""
    data, start, length, first = words(t, lower=False)
    body = t.data[:-8]
    of_byte = np.repeat(np.arange(t.count), np.diff(t.start))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    letters = ~SPACE[body] & ((body & 0xC0) != 0x80)
    codes, _ = word_codes(data, start, length)
    s = Suffixes.of(codes, first)
    longest = np.zeros(t.count, np.int64)
    np.maximum.at(longest, s.text, s.longest())
    return {
        "n_words": np.diff(first),
        "word_chars": _per_text(of_byte[letters], t.count),
        "n_symbols": _per_text(of_byte[symbol[body]], t.count),
        "n_dup_lines": line_repeats(t),
        "n_repeat_words": _per_text(s.text[s.covered(WINDOW)], t.count),
        "covered_words": _per_text(s.text[s.covered(least)], t.count),
        "longest_repeat": np.where(longest >= least, longest, 0),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def _rules(least: int, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column("text"), 1 << 20):
                got = text_statistics(t, least)
                ids = b.column("doc_id").slice(t.first, t.count)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(got[c], pa.int64()) for c in COUNTS]], ["doc_id", *COUNTS])

    def list_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column("text"), 1 << 20):
                data, start, length, first = words(t, lower=False)
                s = Suffixes.of(word_codes(data, start, length)[0], first)
                at, size, times = s.maximal(least)
                end = at + size - 1
                texts = [data[start[i] : start[j] + length[j]].tobytes().decode() for i, j in zip(at, end)]
                ids = b.column("doc_id").take(pa.array(s.text[at] + t.first))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(at - first[s.text[at]], pa.int64()), pa.array(size, pa.int64()), pa.array(times, pa.int64()), pa.array(texts, pa.string())],
                    ["doc_id", "first_word", "n_words", "occurrences", "repeat"],
                )

    return list_spans if spans else run


def maximal_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = REPEAT_WORDS) -> DataFrame:
    """Maximal repeated substrings of ``least`` words or more of every whole text.

    Returns doc_id, first_word (of one occurrence), n_words, occurrences and repeat (the text of that
    occurrence). Texts without any, NULL and empty texts give no rows; other columns are ignored.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_rules(least, True), f"doc_id {kind}, first_word long, n_words long, occurrences long, repeat string")


def quality_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = REPEAT_WORDS,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_repeat_words: int = MAX_REPEAT_WORDS,
) -> DataFrame:
    """Counts and verdict for every row of ``docs``, over its whole text, in one pass without a shuffle.

    Words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive. ``base_failed``: under 50 words, or over 50 % of
    the words in 3-word windows found twice. ``kept``: not failed, repeats of ``least`` words or more
    cover at most ``max_covered_percent`` of the words, and the longest repeat (occurrences may
    overlap) has at most ``max_repeat_words`` words.

    NULL and empty texts: all counts zero, failed. Repeated rows are judged each; rows without a key
    keep their NULL. An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(_rules(least, False), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_WINDOW_PERCENT * F.col("n_words"))
    clean = (100 * F.col("covered_words") <= max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat_words)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & clean)
