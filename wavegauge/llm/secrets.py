"""Secret scan: fixed base patterns, and formats learned as probabilistic automata.

Credentials that the base patterns label are the training strings, the other runs of the corpus the
background. An automaton grows in rounds: every string follows it to the first transition that is still
open, Spark counts the transitions taken and what follows the open ones, and each open transition leads
to the likeliest of the states whose outgoing distributions agree with its own within Hoeffding bounds, or
to a new state (state merging in the manner of ALERGIA, on two characters ahead). All different strings take part
in full; only counts by transition reach the driver. Spark then counts the histogram of all scores. Every
long run of credential characters in every text is scored by the difference of log-likelihoods per character,
and runs above a calibrated threshold are added to the base spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import Texts, runs, slices

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
KINDS = ("assign", "access", "hex", "grammar")

# Cheap tests that every text with such a match passes.
MAY_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
RUN_CHARS = 16

# Merge confidence.
ALPHA = 0.05
# Share of background runs that may lie above the threshold.
BACKGROUND_RATE = 0.001
# Share of the background that may be credentials in disguise.
HIDDEN_SHARE = 0.05
# Codes of two following symbols: a character, 128 for the end, 129 for none.
NEXT = 130 * 130
FLOOR = 1e-4
MARGIN_DIGITS = 3
SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass
class Automaton:
    """Transitions and log-probabilities by state and byte; column 128 is the end of the string."""

    step: np.ndarray
    log: np.ndarray

    def score(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log-likelihood of every ``data[start:start + length]`` (ASCII), all strings in step."""
        out = np.zeros(len(start))
        state = np.zeros(len(start), np.int64)
        live = np.arange(len(start))
        i = 0
        while live.size:
            live = live[length[live] > i]
            c = data[start[live] + i]
            out[live] += self.log[state[live], c]
            state[live] = self.step[state[live], c]
            i += 1
        return out + self.log[state, 128]

    def visits(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How often the strings take each transition or end in each state."""
        at, _, n = self.paths(data, start, length)
        out = np.zeros(self.step.size, np.int64)
        out[at] = n
        return out.reshape(self.step.shape)

    def paths(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of transitions and ends, up to the first open transition (-1) of a string: transition, two
        characters that follow it (code ``first * 130 + second``; 128: the end, 129: none) and how often.
        Only open transitions have following characters."""
        keys = []
        state = np.zeros(len(start), np.int64)
        live = np.arange(len(start))
        i = 0

        def ahead(which: np.ndarray, by: int) -> np.ndarray:
            left = length[which] - i - by
            return np.where(left > 0, data[np.minimum(start[which] + i + by, len(data) - 1)], np.where(left == 0, 128, 129)).astype(np.int64)

        while live.size:
            over = length[live] <= i
            keys.append((state[live[over]] * 129 + 128) * NEXT + NEXT - 1)
            live = live[~over]
            at = state[live] * 129 + data[start[live] + i]
            to = self.step.ravel()[at]
            stays, ends = to >= 0, live[to < 0]
            keys += [at[stays] * NEXT + NEXT - 1, at[~stays] * NEXT + ahead(ends, 1) * 130 + ahead(ends, 2)]
            live = live[stays]
            state[live] = to[stays]
            i += 1
        key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        return key // NEXT, key % NEXT, n


def _automaton(step: np.ndarray, counts: np.ndarray) -> Automaton:
    prob = FLOOR + counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return Automaton(step, np.log(prob / prob.sum(1, keepdims=True)))


def _single() -> Automaton:
    """One state: single-character frequencies."""
    return _automaton(np.zeros((1, 129), np.int64), np.zeros((1, 129)))


def infer(strings: list[bytes], alpha: float = ALPHA) -> Automaton:
    """Merge the compatible states of the strings' prefix tree into a probabilistic automaton."""
    return grown(Listed(strings), alpha)


def grown(strings: Listed | Spread, alpha: float = ALPHA) -> Automaton:
    """The automaton of all ``strings``, round by round until no transition is open. A round reads every string."""
    width = np.sqrt(0.5 * np.log(2 / alpha)) if alpha > 0 else np.inf  # 0: one state, single-character frequencies
    step = np.full((1, 129), -1)
    while True:
        at, ahead, n = strings.paths(Automaton(step, np.zeros(step.shape)))
        order = np.lexsort((ahead, at))
        at, ahead, n = at[order], ahead[order], n[order]
        counts = np.bincount(at, n, step.size).reshape(step.shape)
        open_at = [e for e in np.unique(at).tolist() if step.flat[e] < 0 and e % 129 < 128]
        if not open_at:
            step[step < 0] = 0
            return _automaton(step, counts)

        def following(edge: int) -> np.ndarray:
            """How often each pair of symbols follows an open transition; the second is 129 after an end."""
            a, b = np.searchsorted(at, (edge, edge + 1))
            return np.bincount(ahead[a:b], n[a:b], NEXT).reshape(130, 130)[:129]

        source: dict[int, int] = {}  # the open transition that a new state of this round was made from

        def second(state: int) -> np.ndarray:
            """What follows each outgoing symbol of a state."""
            if state in source:
                return following(source[state])[:, :129]
            out = np.zeros((129, 129))
            for c in np.flatnonzero(counts[state, :128]).tolist():
                out[c] = following(state * 129 + c).sum(1) if state * 129 + c in was_open else counts[step[state, c]]
            return out

        was_open = set(open_at)
        for edge in sorted(open_at, key=lambda e: (-counts.flat[e], e)):
            pairs = following(edge)
            own = pairs.sum(1)
            step.flat[edge] = len(step)
            near = np.flatnonzero(_agree(own, counts, width))
            likely = np.log(FLOOR + counts[near] / np.maximum(counts[near].sum(1, keepdims=True), 1)) @ own
            for old in near[np.argsort(-likely, kind="stable")].tolist():
                if _agree(pairs[:, :129], second(old), width).all():
                    step.flat[edge] = old
                    break
            else:
                source[len(step)] = edge
                step = np.vstack([step, np.full((1, 129), -1)])
                counts = np.vstack([counts, own])


def _agree(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """Whether counts by symbol (rows) have distributions within their Hoeffding bounds; without counts they have."""
    n, m = np.maximum(a.sum(-1), 1e-9), np.maximum(b.sum(-1), 1e-9)
    return np.abs(a / n[..., None] - b / m[..., None]).max(-1) <= width * (n**-0.5 + m**-0.5)


@dataclass
class Grammar:
    kinds: list[Automaton]
    background: Automaton
    threshold: float

    def margin(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best log-likelihood ratio per character over the kinds."""
        base = self.background.score(data, start, length)
        return (np.max([a.score(data, start, length) for a in self.kinds], axis=0) - base) / (length + 1)


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings) + b"\0" * 8, np.uint8), np.cumsum(length) - length, length


class Listed:
    """Strings in a list."""

    def __init__(self, runs: list[bytes]):
        self.runs = runs

    def count(self) -> int:
        return len(self.runs)

    def paths(self, a: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return a.paths(*_joined(self.runs))

    def visits(self, a: Automaton) -> np.ndarray:
        return a.visits(*_joined(self.runs))

    def histogram(self, g: Grammar) -> tuple[np.ndarray, np.ndarray]:
        """Rounded margins and how many runs have each."""
        return np.unique(np.round(g.margin(*_joined(self.runs)), MARGIN_DIGITS), return_counts=True)

    def below(self, g: Grammar, cut: float) -> Listed:
        m = np.round(g.margin(*_joined(self.runs)), MARGIN_DIGITS)
        return Listed([x for x, y in zip(self.runs, m) if y < cut])

    def parts(self) -> tuple[Listed, Listed]:
        """Three quarters of the strings, and the rest."""
        return Listed([x for i, x in enumerate(self.runs) if i % 4 != 3]), Listed([x for i, x in enumerate(self.runs) if i % 4 == 3])


class Spread:
    """Strings in a DataFrame column ``value``; what reaches the driver grows with the automaton, not with the strings."""

    def __init__(self, runs: DataFrame):
        self.runs = runs

    def count(self) -> int:
        return self.runs.count()

    def paths(self, a: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shared = self.runs.sparkSession.sparkContext.broadcast(a)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in shared.value.paths(*_joined(b.column("value").to_pylist()))], ["at", "ahead", "n"])

        found = self.runs.mapInArrow(run, "at long, ahead long, n long").groupBy("at", "ahead").agg(F.sum("n").alias("n")).toArrow()
        return tuple(found[c].to_numpy() for c in ("at", "ahead", "n"))

    def visits(self, a: Automaton) -> np.ndarray:
        at, _, n = self.paths(a)  # the size of the automaton
        out = np.zeros(a.step.size, np.int64)
        out[at] = n
        return out.reshape(a.step.shape)

    def scored(self, g: Grammar) -> DataFrame:
        shared = self.runs.sparkSession.sparkContext.broadcast(g)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = np.round(shared.value.margin(*_joined(b.column("value").to_pylist())), MARGIN_DIGITS) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(m)], ["value", "margin"])

        return self.runs.mapInArrow(run, "value binary, margin double")

    def histogram(self, g: Grammar) -> tuple[np.ndarray, np.ndarray]:
        rows = self.scored(g).groupBy("margin").count().orderBy("margin").collect()  # as many as there are rounded margins
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)

    def below(self, g: Grammar, cut: float) -> Spread:
        return Spread(self.scored(g).where(F.col("margin") < float(cut)).select("value"))

    def parts(self) -> tuple[Spread, Spread]:
        held = F.pmod(F.xxhash64("value"), F.lit(4)) == 3
        return Spread(self.runs.where(~held)), Spread(self.runs.where(held))


def _weakest(held: list[Listed] | list[Spread], g: Grammar) -> float:
    """The margin below which a twentieth of the held-out credentials lie."""
    found = [x.histogram(g) for x in held]
    margins, n = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    order = np.argsort(margins, kind="stable")
    return float(margins[order][np.searchsorted(np.cumsum(n[order]), 0.05 * n.sum())]) if n.sum() else 0.0


def learn(labelled: dict[str, list[bytes]] | dict[str, Spread], background: list[bytes] | Spread) -> Grammar | None:
    """Automata of the kinds from three quarters of their strings, margins of credentials from the
    rest; the background automaton and the threshold from all background runs. None without credentials."""
    strings = {k: v if isinstance(v, Spread) else Listed(v) for k, v in labelled.items()}
    parts = [v.parts() for v in strings.values() if v.count() >= 8]
    if not parts:
        return None
    if not isinstance(background, Spread):
        background = Listed(background + [x.upper() for x in background if x.isalpha()])  # ordinary text may shout
    kinds, held = [grown(fit) for fit, _ in parts], [rest for _, rest in parts]
    counted = lambda a: _automaton(a.step, background.visits(a))
    # The background may hold credentials that no base pattern labels. The few runs that score like the
    # labelled ones against single-character frequencies are left out; a common format is ordinary text.
    grammar = Grammar(kinds, counted(_single()), 0.0)
    cut = _weakest(held, grammar)
    margins, n = background.histogram(grammar)
    if n.sum() and n[margins >= cut].sum() / n.sum() <= HIDDEN_SHARE:
        background = background.below(grammar, cut)
    grammar.background = grown(background)
    weak = _weakest(held, grammar)
    margins, n = background.histogram(grammar)
    least = margins[np.searchsorted(np.cumsum(n), (1 - BACKGROUND_RATE) * n.sum())] if n.sum() else 0.0
    # Half way to the weakest twentieth of the credentials, so that neither side is cut close.
    grammar.threshold = float(max(least, (least + weak) / 2, 0.1))
    return grammar


def _base_spans(t: Texts, column: pa.Array) -> tuple[dict[int, list], tuple]:
    """Base spans by row of the slice: (start, kind number, end) in code points; and the long runs."""
    points = np.concatenate(([0], np.cumsum((t.data[:-8] & 0xC0) != 0x80, dtype=np.int64)))
    found: dict[int, list] = {}
    start, length = runs(t, _HEX)
    long = length >= HEX_CHARS
    start, length = start[long], length[long]
    row = np.searchsorted(t.start, start, "right") - 1
    for r, s, e in zip(row.tolist(), (points[start] - points[t.start[row]]).tolist(), (points[start + length] - points[t.start[row]]).tolist()):
        found.setdefault(r, []).append((s, 2, e))
    for number, may in ((0, pc.match_substring_regex(column, MAY_ASSIGN)), (1, pc.match_substring(column, "AKIA"))):
        for r in np.flatnonzero(may.to_numpy(zero_copy_only=False)):
            text = column[int(r)].as_py()
            spans = (
                [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
                if number == 0
                else [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
            )
            if spans:
                found.setdefault(int(r), []).extend(spans)
    start, length = runs(t, _RUN)
    long = length >= RUN_CHARS
    start, length = start[long], length[long]
    row = np.searchsorted(t.start, start, "right") - 1
    first = points[start] - points[t.start[row]]
    return found, (start, length, row, first, first + length)


def _outside(found: dict[int, list], row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which runs overlap no base span."""
    out = np.ones(len(row), bool)
    for i in np.flatnonzero(np.isin(row, np.fromiter(found, np.int64, len(found)))):
        out[i] = not any(s < last[i] and first[i] < e for s, _, e in found[int(row[i])])
    return out


def _texts(b: pa.RecordBatch) -> Iterator[tuple[Texts, pa.Array]]:
    column = pc.fill_null(b.column("text"), "")
    for t in slices(column):
        yield t, column.slice(t.first, t.count)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different values of base spans, and of the other long runs, of each batch."""
    for b in batches:
        seen: set[tuple[str, bytes]] = set()
        for t, column in _texts(b):
            found, (start, length, row, first, last) = _base_spans(t, column)
            for r, spans in found.items():
                text = column[r].as_py()
                for s, kind, e in spans:
                    value = text[s:e] if kind else ASSIGN.match(text, s)[2]
                    seen.add((KINDS[kind], value.encode()))
            free = np.flatnonzero(_outside(found, row, first, last))
            seen.update(("background", t.data[i : i + n].tobytes()) for i, n in zip(start[free].tolist(), length[free].tolist()))
        kinds, values = [k for k, _ in seen], [v for _, v in seen]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.binary())], ["kind", "value"])


def learn_grammar(docs: DataFrame, text: str = "text") -> Grammar | None:
    """Learn from the credentials that the base patterns label in ``docs`` and from all its other long runs.

    The fit uses every different value of each kind and of the other runs, so it does not depend on the
    layout of the table.
    """
    found = materialise(docs.select(F.col(text).alias("text")).mapInArrow(_samples, "kind string, value binary").distinct(), "runs")
    of = lambda kind: found.where(F.col("kind") == kind).select("value")
    ordinary = of("background")
    word = F.col("value").cast("string")  # ASCII; ordinary text may shout
    shouted = ordinary.where(word.rlike("^[A-Za-z]+$")).select(F.upper(word).cast("binary").alias("value"))
    return learn({k: Spread(of(k)) for k in KINDS[:3]}, Spread(ordinary.unionByName(shouted)))


def _redacted(text: str, spans: list, mark: str) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan(shared, mark: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar: Grammar | None = shared.value
        for b in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            spans: list[list] = []
            texts: list[pa.Array] = []
            for t, column in _texts(b):
                found, (start, length, row, first, last) = _base_spans(t, column)
                if grammar is not None and len(start):
                    hit = np.flatnonzero(grammar.margin(t.data, start, length) >= grammar.threshold)
                    hit = hit[_outside(found, row[hit], first[hit], last[hit])]
                    for r, s, e in zip(row[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                        found.setdefault(r, []).append((s, 3, e))
                for x in found.values():
                    x.sort()
                spans += [found.get(r, []) for r in range(t.count)]
                if mark is not None:
                    texts.append(pa.array([_redacted(column[r].as_py(), found[r], mark) if r in found else column[r].as_py() for r in range(t.count)], pa.string()) if found else column.cast(pa.string()))
            flat = [x for rows in spans for x in rows]
            items = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())], ["kind", "start", "end"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in spans]))), pa.int32()), items)
            names = [f.name for f in b.schema if f.name != "text"]
            arrays = [b.column(n) for n in names]
            if mark is not None:
                arrays.append(pa.concat_arrays(texts) if texts else pa.array([], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays([*arrays, lists], [*names, "spans"])

    return run


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), redact: str | None = None, grammar: Grammar | None = None) -> DataFrame:
    """Spans of secrets in every whole text: doc_id, the columns in ``keep`` and spans.

    ``spans`` holds kind (assign, access, hex, grammar), start and end (exclusive) in code points, by
    start and then in the order of the kinds; base spans may overlap each other, grammar spans overlap
    none. With ``redact`` the text follows too, each covered stretch replaced by that mark. Without
    ``grammar`` the automata are learned from ``docs`` itself; with too few credentials there, only
    the base patterns apply. NULL or empty text has no spans. Rows are independent of each other, so
    repeated rows give equal results. An empty table gives no rows; other columns are ignored.
    """
    grammar = grammar or learn_grammar(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # a few automata
    carry = {f"keep_{i}": c for i, c in enumerate(keep)}
    base = docs.select(F.col(key).alias("doc_id"), *[F.col(c).alias(a) for a, c in carry.items()], F.col(text).alias("text"))
    fields = [f"{c} {base.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry)] + ["text string"] * (redact is not None) + [f"spans {SPANS}"]
    out = base.mapInArrow(_scan(shared, redact), ", ".join(fields))
    return out.select("doc_id", *[F.col(a).alias(c) for a, c in carry.items()], *["text"] * (redact is not None), "spans")


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
