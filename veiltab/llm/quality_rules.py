"""Quality rules as a short-circuit cascade.

A rule rejects texts. On a bounded sample each rule's cost per text and its share of rejections are
measured; rules run in descending order of rejections per cost, each only over the texts that all rules
before it let pass. The order changes the work, never the verdict: a text is kept if no rule rejects it.

Features are computed by array passes over a batch, only when a rule asks for them. Windows and lines
are compared by 64-bit hashes within a text.

Defined cases: NULL and empty texts have no words and are rejected; rows that repeat get the same
verdict; an empty table has the given order of rules; other columns may have any name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.llm.fragments import gather
from veiltab.llm.shared import plain
from veiltab.llm.text import SPACE, column_bytes, follow, hash_ranges, row_chunks, same_as, window_hashes, words

SAMPLE_ROWS = 2000  # texts on which cost and selectivity are measured
WINDOW = 5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _row_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Texts:
    """Texts of a batch and their features, each computed on first use."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def only(self, keep: np.ndarray) -> Texts:
        size = np.diff(self.bounds)
        data, at = gather(self.data, self.bounds[:-1], size, np.flatnonzero(keep))
        return Texts(data, at)

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words(self.data, self.bounds)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self._words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return _row_sums(~SPACE[self.data] & ((self.data & 0xC0) != 0x80), self.bounds)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return _row_sums(SYMBOL[self.data], self.bounds)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the lines that hold a word, and whether they equal an earlier one."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        cut = self.data == 10
        starts = np.unique(np.concatenate([self.bounds[:-1], np.flatnonzero(cut) + 1]))
        starts = starts[starts < len(self.data)]
        ends = np.append(starts[1:], len(self.data))
        ends = ends - cut[ends - 1]
        solid = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~SPACE[self.data], out=solid[1:])
        some = solid[ends] > solid[starts]
        starts, ends = starts[some], ends[some]
        row = np.searchsorted(self.bounds, starts, "right") - 1
        held = same_as(follow(hash_ranges(self.data, starts, ends), row.astype(np.uint64)))
        return row, held != np.arange(len(held))

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[0], minlength=len(self))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        row, again = self._lines
        return np.bincount(row[again], minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        starts, ends, at = self._words
        windows = window_hashes(hash_ranges(self.data, starts, ends), WINDOW)
        row = np.repeat(np.arange(len(self)), self.n_words)
        inside = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
        held = same_as(follow(windows[inside], row[inside].astype(np.uint64)))
        often = inside[np.bincount(held, minlength=len(held))[held] >= 2] if len(held) else inside
        step = np.zeros(len(starts) + 1, np.int64)
        np.add.at(step, often, 1)
        np.add.at(step, often + WINDOW, -1)
        return _row_sums(np.cumsum(step[:-1]) > 0, at)

    @cached_property
    def n_shouted(self) -> np.ndarray:
        """Words with two ASCII capitals and no small ASCII letter."""
        starts, ends, at = self._words
        large, small = (np.concatenate([[0], np.cumsum((self.data >= a) & (self.data <= z))]) for a, z in ((65, 90), (97, 122)))
        return _row_sums((large[ends] - large[starts] >= 2) & (small[ends] == small[starts]), at)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


def few_words(t: Texts) -> np.ndarray:
    return t.n_words < 10


def repeated_words(t: Texts) -> np.ndarray:
    return 100 * t.n_repeat_words > 20 * t.n_words


BASE = (Rule("few_words", few_words), Rule("repeated_words", repeated_words))
RULES = (
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 20 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 5 * t.n_lines),
    Rule("shouted", lambda t: 10 * t.n_shouted > 4 * t.n_words),
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds per text, share of texts it rejects) over a hashed sample of about ``rows`` texts."""
    texts = plain(docs, text=text)
    every = max(1, docs.count() // rows)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).limit(2 * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(0))
            for rule in rules:
                began = time.perf_counter()
                rejected = int(rule.rejects(Texts(data, bounds)).sum()) if len(bounds) > 1 else 0
                took = time.perf_counter() - began
                yield pa.RecordBatch.from_pydict({"rule": [rule.name], "s": [took], "rejected": [rejected], "texts": [len(bounds) - 1]})

    got = sample.mapInArrow(run, "rule string, s double, rejected long, texts long").groupBy("rule").agg(
        (F.sum("s") / F.sum("texts")).alias("s"), (F.sum("rejected") / F.sum("texts")).alias("share")
    )
    return [(r["rule"], r["s"] or 0.0, r["share"] or 0.0) for r in got.collect()]


def ordered(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> list[Rule]:
    """Rules by rejections per cost, the best first."""
    gain = {name: share / max(s, 1e-9) for name, s, share in measure(docs, rules, text)}
    return sorted(rules, key=lambda r: -gain.get(r.name, 0.0))


def passes(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """Numbers of the texts no rule rejects; each rule runs over what those before it let pass."""
    kept = np.arange(len(texts))
    for rule in rules:
        if not len(kept):
            break
        ok = ~rule.rejects(texts)
        if not ok.all():
            kept, texts = kept[ok], texts.only(ok)
    return kept


def _verdicts(data: np.ndarray, bounds: np.ndarray, rules: Sequence[Rule]) -> np.ndarray:
    verdict = np.zeros(len(bounds) - 1, bool)
    for a, b in row_chunks(bounds):
        own = Texts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        verdict[a + passes(own, rules)] = True
    return verdict


def assess(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features, base_failed, kept) of every row. The base rules come first as their features are
    returned for all rows; the cascade runs over what they let pass."""
    order = ordered(docs, rules, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(1))
            for a, b in row_chunks(bounds):
                texts = Texts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                failed = np.logical_or.reduce([r.rejects(texts) for r in BASE])
                kept = np.zeros(len(texts), bool)
                good = np.flatnonzero(~failed)
                kept[good[passes(texts.only(~failed), order)]] = True
                cols = [batch.column(0).slice(a, b - a)] + [pa.array(getattr(texts, f), pa.int64()) for f in FEATURES]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(kept)], ["key", *FEATURES, "base_failed", "kept"])

    schema = "key long, " + ", ".join(f"{f} long" for f in FEATURES) + ", base_failed boolean, kept boolean"
    return plain(docs, key=key, text=text).mapInArrow(run, schema).withColumnRenamed("key", key)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), text: str = "text") -> DataFrame:
    """The rows, all columns, whose text no rule rejects."""
    order = ordered(docs, rules, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_verdicts(*column_bytes(batch.column(at)), order)))

    return docs.mapInArrow(run, docs.schema)
