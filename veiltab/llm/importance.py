"""Quality by importance resampling.

Two generative models over hashed n-grams (words and pairs of words): of the target, from half of all
labelled rows, and of the raw text, from all rows. A text's weight is the ratio of its
probabilities under the two; its key is the log weight plus Gumbel noise, and the k largest keys are a
sample without replacement in proportion to the weights. k is given, or taken such that the sample
holds all but ``miss`` of the target rows that were held out of the fit.

Rows to avoid (toxic ones) can look like the target in all but a few words, so they have a model of their
own against the raw text: how many rows hold each word, over all rows. A text's score is the sum of its few
strongest log ratios, and the cut is the one that loses the share ``loss`` of the target rows. Both cuts
are quantiles of rows that the model in question has not learnt from, on the side that keeps more.

The noise is a hash of key, text and seed: another run or partitioning draws the same sample.

Defined cases: NULL and empty texts have log weight 0; rows that repeat have equal keys, and ties at the
k-th key all belong to the sample; without target rows all weights are equal and, without k, all rows
belong to it; an empty table has an empty sample. Without
rows to avoid that occur, nothing is avoided. Very long texts are whole; memory follows the longest. Only the
named columns are read, so other columns may have any names; ``keep_sampled`` passes them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab import session
from veiltab.llm.shared import narrow_batches, plain, workspace
from veiltab.llm.text import column_bytes, follow, hash_ranges, mix, row_chunks, words
from veiltab.session import lookup

BITS = 16
PRIOR = 32  # n-grams of the raw text that each bucket of the target model starts with
PIECES = 1 << 12  # parts of a range of keys that are counted at once
FEW_KEYS = 20_000
WORD_BITS = 20  # of the hash buckets of single words, for rows to avoid
WORD_PRIOR = 1  # rows
STRONGEST = 3  # words of a row that its score is made of
SLICE = 1 << 12  # buckets whose counts travel as one row
CHUNK = 1 << 19  # bytes of text at once


def buckets_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of rows (pairs right after their first word), and the rows' bounds."""
    starts, ends, at = words(data, bounds)
    one = hash_ranges(data, starts, ends)
    grams = np.empty(2 * len(one), np.uint64)
    grams[::2] = one
    grams[1::2] = follow(one, np.append(one[1:], np.uint64(0))) if len(one) else one
    last = at[1:][np.diff(at) > 0] - 1  # the last word of a text starts no pair
    keep = np.ones(len(grams), bool)
    keep[2 * last + 1] = False
    count = np.diff(at)
    return (grams[keep] >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(2 * count - (count > 0))])


def gumbel(keys: pa.Array, data: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """Noise of each row."""
    own = pc.fill_null(keys.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).view(np.uint64)
    h = mix(hash_ranges(data, bounds[:-1], bounds[1:]) + mix(own + np.uint64(seed)))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


@dataclass
class Weights:
    """log of target over raw probability of each bucket."""

    log_ratio: np.ndarray
    seed: int

    def rows(self, keys: pa.Array, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log weight and key of each row. Weights are summed as integers, so their order doesn't matter."""
        weight = np.zeros(len(bounds) - 1)
        noise = np.zeros(len(bounds) - 1)
        for a, b in row_chunks(bounds, CHUNK):
            own, local = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            bucket, at = buckets_of(own, local)
            total = np.zeros(len(bucket) + 1, np.int64)
            np.cumsum(self.log_ratio[bucket], out=total[1:])
            weight[a:b] = (total[at[1:]] - total[at[:-1]]) / 1e6
            noise[a:b] = gumbel(keys.slice(a, b - a), own, local, self.seed)
        return weight, weight + noise


def target_sample(target: DataFrame, key: str) -> DataFrame:
    """(key, fit): all target keys; fit marks the half, by hash, that the model learns from."""
    own = plain(target, key=key).where("key is not null").distinct()
    return own.select("key", (F.xxhash64("key", F.lit("target")) % 2 == 0).alias("fit"))


def marked(docs: DataFrame, sample: DataFrame, how: str = "left") -> DataFrame:
    """Rows with what the sample has on their key: by broadcast, or by shuffle if the sample is large."""
    return lookup(docs, sample, ["key"], sample.count(), how)


class Known:
    """Which rows a sample (key, ...) of distinct keys has: its sorted keys go with the tasks, 8 bytes each, as a table of
    rows costs the driver some hundred bytes a key. Past half of what may be broadcast rows meet it by shuffle."""

    def __init__(self, sample: DataFrame):
        self.sample, self.keys = sample.select("key"), None
        if sample.count() * 16 <= session.BROADCAST_BYTES:
            own = sample.select(F.col("key").cast("long").alias("key")).toArrow().column("key").to_numpy()
            self.keys = np.sort(own)

    def rows(self, docs: DataFrame, value: str, how: str = "left") -> DataFrame:
        """(value, mark) of docs (key, ...), where ``has`` reads the mark; inner: rows of others may be missing."""
        if self.keys is not None:
            return docs.select(value, F.col("key").cast("long").alias("mark"))
        return marked(docs, self.sample.withColumn("mark", F.lit(True)), how).select(value, "mark")

    @property
    def has(self):
        """Rows of a batch's marks that are in the sample."""
        keys = self.keys

        def of(mark: pa.Array) -> np.ndarray:
            if keys is None or not len(keys):
                flags = mark if keys is None else pa.nulls(len(mark), pa.bool_())
                return pc.fill_null(flags, False).to_numpy(zero_copy_only=False).astype(bool)
            own = pc.fill_null(mark, 0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            return (keys[at] == own) & mark.is_valid().to_numpy(zero_copy_only=False)

        return of


def _sliced(total: np.ndarray) -> pa.RecordBatch:
    """A task's counts of buckets, raw and own, as a row per slice: byte plane by byte plane, as most planes are zeros."""
    parts = np.flatnonzero(total[0].reshape(-1, SLICE).any(1))
    cols = [pa.array([t[k * SLICE : (k + 1) * SLICE].view(np.uint8).reshape(-1, 8).T.tobytes() for k in parts], pa.binary()) for t in total]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *cols], ["part", "raw", "own"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of slices; what a task holds doesn't grow with the rows."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, *blocks in zip(*(c.to_pylist() for c in batch.columns)):
            own = held.setdefault(part, np.zeros((2, SLICE), np.int64))
            for t, block in zip(own, blocks):
                t += np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    for part, own in held.items():
        some = np.flatnonzero(own[0])
        yield pa.RecordBatch.from_arrays([pa.array((part * SLICE + some).astype(np.int32)), *(pa.array(t[some]) for t in own)], ["b", "raw", "own"])


def _counted(rows: DataFrame, count) -> DataFrame:
    """(b, raw, own) of what ``count`` hands on in slices."""
    return rows.mapInArrow(count, "part int, raw binary, own binary").repartition("part").mapInArrow(_summed, "b int, raw long, own long")


def fit(docs: DataFrame, sample: DataFrame, seed: int) -> Weights:
    """docs (key, text); sample (key, fit)."""
    known = Known(sample.where("fit"))
    has = known.has

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            data, bounds = column_bytes(batch.column(0))
            learn = has(batch.column(1))
            for a, b in row_chunks(bounds, CHUNK):
                bucket, at = buckets_of(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                total[0] += np.bincount(bucket, minlength=1 << BITS)
                total[1] += np.bincount(bucket[np.repeat(learn[a:b], np.diff(at))], minlength=1 << BITS)
        yield _sliced(total)

    got = _counted(known.rows(docs, "text"), count).toArrow()  # a row per bucket at most
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = got.column("b").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("own").to_numpy()
    if not target.sum():
        return Weights(np.zeros(1 << BITS, np.int64), seed)
    expected = target.sum() * (raw + 1) / (raw.sum() + len(raw))
    return Weights(np.round(1e6 * np.log((target + PRIOR) / (expected + PRIOR))).astype(np.int64), seed)


@dataclass
class Avoided:
    """Words that are more frequent in rows to avoid than in the raw text, and the score beyond which a row goes.

    A row's score is the sum of its ``STRONGEST`` largest log ratios: a few words mark such a row, however
    long it is.
    """

    log_ratio: np.ndarray
    cut: float = float("inf")

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bounds) - 1)
        for a, b in row_chunks(bounds, CHUNK):
            row, bucket = _words_once(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            ratio = self.log_ratio[bucket]
            some = ratio > 0
            row, ratio = row[some], ratio[some]
            order = np.lexsort((-ratio, row))
            row, ratio = row[order], ratio[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            out[a:b] = np.bincount(row, np.where(place < STRONGEST, ratio, 0), b - a)
        return out


def _words_once(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the distinct words of rows."""
    starts, ends, at = words(data, bounds)
    bucket = (hash_ranges(data, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    both = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) << WORD_BITS | bucket)
    return both >> WORD_BITS, both & ((1 << WORD_BITS) - 1)


def fit_avoided(docs: DataFrame, avoid: DataFrame, clean: DataFrame, loss: float) -> Avoided:
    """docs (key, text); avoid and clean (key, fit).

    Rows that hold a word are counted over all docs. The cut loses the share ``loss`` of the clean rows,
    which the model doesn't learn from.
    """
    known = Known(avoid.where("fit"))
    has = known.has

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (1 << WORD_BITS) + SLICE), np.int64)  # the rows themselves follow the buckets
        for batch in batches:
            data, bounds = column_bytes(batch.column(0))
            learn = has(batch.column(1))
            total[:, 1 << WORD_BITS] += len(learn), int(learn.sum())
            for a, b in row_chunks(bounds, CHUNK):
                row, bucket = _words_once(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                np.add.at(total[0], bucket, 1)
                np.add.at(total[1], bucket[learn[a:b][row]], 1)
        yield _sliced(total)

    got = _counted(known.rows(docs, "text"), count).where("own > 0").toArrow()  # a row per bucket at most
    b, raw, own = (got.column(c).to_numpy() for c in ("b", "raw", "own"))
    model = Avoided(np.zeros(1 << WORD_BITS, np.float32))
    rows = b >> WORD_BITS > 0
    if not own[rows].sum():
        return model
    share = own[rows].sum() / raw[rows].sum()
    ratio = np.log((own + WORD_PRIOR) / (share * raw + WORD_PRIOR))
    model.log_ratio[b[~rows]] = np.maximum(ratio[~rows], 0)

    spared = Known(clean)
    held_out = spared.has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).filter(pa.array(held_out(batch.column(1))))
            yield pa.RecordBatch.from_arrays([pa.array(model.scores(*column_bytes(own)))], ["key"])

    held = spared.rows(docs, "text", "inner").mapInArrow(run, "key double")
    held = workspace(docs.sparkSession, "avoided").write(held, "held")
    if rows := held.count():
        model.cut = kth_largest(held, rows - math.ceil((rows - 1) * (1 - loss)))
    return model


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column ``key``: ranges are counted, and the one that holds it split."""
    of = keys.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("key").alias("n")).first()
    if not of["n"] or k <= 0:
        return float("inf")
    if k >= of["n"]:
        return of["low"]
    low, high, above = of["low"], of["high"], 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / PIECES
        if width <= 0 or low + width == low:
            return high
        piece = F.least(F.floor((F.col("key") - low) / width), F.lit(PIECES - 1)).cast("int").alias("piece")
        parts = inside.groupBy(piece).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for part in sorted(parts.collect(), key=lambda r: -r["piece"]):  # PIECES rows at most
            if above + part["n"] >= k:
                break
            above += part["n"]
        if part["low"] == part["high"]:
            return part["low"]
        if part["n"] <= FEW_KEYS:
            own = inside.where((F.col("key") >= part["low"]) & (F.col("key") <= part["high"]))
            return sorted((r["key"] for r in own.collect()), reverse=True)[k - above - 1]
        low, high = part["low"], part["high"]


def resample(
    docs: DataFrame, target: DataFrame, k: int | None = None, miss: float = 0.004, key: str = "doc_id", text: str = "text",
    target_key: str = "doc_id", seed: int = 7, avoid: DataFrame | None = None, loss: float = 0.002,
) -> tuple[DataFrame, Weights, float]:
    """(key, log_weight, key_value, selected) of every row; the weights; the smallest selected key value.

    With rows to ``avoid`` there is also avoid_score, and rows beyond its cut are not selected.
    """
    out, weights, least, _ = _resampled(docs, target, k, miss, key, text, target_key, seed, avoid, loss)
    return out, weights, least


def _resampled(docs, *others) -> tuple[DataFrame, Weights, float, Avoided | None]:
    with narrow_batches(docs.sparkSession):
        return _resampled_narrow(docs, *others)


def _resampled_narrow(docs, target, k, miss, key, text, target_key, seed, avoid, loss) -> tuple[DataFrame, Weights, float, Avoided | None]:
    ws = workspace(docs.sparkSession, "importance")
    rows = plain(docs, key=key, text=text)
    sample = ws.write(target_sample(target, target_key), "target")
    weights = fit(rows, sample, seed)
    avoided = None
    if avoid is not None:
        avoided = fit_avoided(rows, ws.write(target_sample(avoid, target_key), "avoid"), sample, loss)
    names = ["id", "log_weight", "key", *(["avoid_score"] if avoided else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(1))
            made = [batch.column(0), *map(pa.array, weights.rows(batch.column(0), data, bounds))]
            if avoided:
                made.append(pa.array(avoided.scores(data, bounds)))
            yield pa.RecordBatch.from_arrays(made, names)

    scored = ws.write(rows.mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names[1:])), "scored")
    if k is not None:
        least = kth_largest(scored, k)
    else:
        unseen = Known(sample.where("not fit"))
        has = unseen.has

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(has(batch.column(1))))], ["key"])

        values = scored.select(F.col("id").alias("key"), F.col("key").alias("value"))
        held = ws.write(unseen.rows(values, "value", "inner").mapInArrow(own, "key double"), "held")
        rows = held.count()
        least = kth_largest(held, rows - math.floor((rows - 1) * miss)) if rows else float("-inf")
    taken = F.col("key") >= least
    extra = []
    if avoided:
        taken, extra = taken & (F.col("avoid_score") <= avoided.cut), ["avoid_score"]
    out = scored.select(F.col("id").alias(key), "log_weight", F.col("key").alias("key_value"), *extra, taken.alias("selected"))
    return out, weights, least, avoided


def keep_sampled(
    docs: DataFrame, target: DataFrame, k: int | None = None, miss: float = 0.004, key: str = "doc_id", text: str = "text",
    target_key: str = "doc_id", seed: int = 7, avoid: DataFrame | None = None, loss: float = 0.002,
) -> DataFrame:
    """The sampled rows, all columns."""
    _, weights, least, avoided = _resampled(docs, target, k, miss, key, text, target_key, seed, avoid, loss)
    at, own = docs.columns.index(text), docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(at))
            for a, b in row_chunks(bounds):  # what is handed on is small, however large the batch
                part, local = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                keep = weights.rows(batch.column(own).slice(a, b - a), part, local)[1] >= least
                if avoided:
                    keep &= avoided.scores(part, local) <= avoided.cut
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
