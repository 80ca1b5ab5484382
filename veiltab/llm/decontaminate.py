"""Benchmark decontamination with DataFrame functions only.

Windows of ``n`` consecutive words of the benchmark form a hash set; an item of fewer words is one
window. Every window of every training text is hashed and looked up in a bit map of the set, which has
a fixed size and travels in the plan. What passes is verified word by word: a join on the window text,
with the benchmark's windows broadcast if their counted bytes allow and shuffled else.

Defined cases: NULL texts have no words and are clean; rows that repeat are judged alike and all
returned; ties (a window of several items) count for each item; without windows all is clean; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.llm.shared import lower_az, plain, workspace
from veiltab.session import BROADCAST_BYTES

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"  # between lower-cased words
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # the same before A-Z are lower-cased
RAW_PIECE = RAW_SEPARATORS + r"*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MIN_WORDS, MAX_WORDS = 64, 1 << 14  # size of the bit map in 64-bit words


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS + "+"), "")


def starts(words: Column, n: int) -> Column:
    """1-based places where a window of n words starts."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))


def window_hash(hashes: Column, place: Column, n: Column | int) -> Column:
    return F.xxhash64(F.slice(hashes, place, n))


def benchmark_windows(items: DataFrame, n: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, len, window, h) of every window."""
    words = plain(items, item=key, text=text).select("item", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = words.withColumn("len", F.least(F.size("w"), F.lit(n))).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1))
    )
    own = F.slice("w", F.col("at"), F.col("len"))
    return rows.select("item", "len", F.array_join(own, " ").alias("window"), F.xxhash64(F.transform(own, lambda w: F.xxhash64(w))).alias("h"))


class WindowSet:
    """The benchmark's windows: lengths, a bit map of their hashes, and the table to verify with."""

    def __init__(self, items: DataFrame, n: int, key: str, text: str):
        ws = workspace(items.sparkSession, "benchmark")
        rows = ws.write(benchmark_windows(items, n, key, text), "windows")
        self.table = ws.write(rows.groupBy("window").agg(F.collect_set(F.col("item").cast("string")).alias("items")), "set")
        of = self.table.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("window") + 32 + 40 * F.size("items")).alias("bytes")
        ).first()
        self.small = (of["bytes"] or 0) <= BROADCAST_BYTES
        self.lengths = sorted(r["len"] for r in rows.select("len").distinct().collect())  # at most n
        self.words = MIN_WORDS
        while self.words < MAX_WORDS and 2 * self.words < of["n"]:
            self.words *= 2
        place = (F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(self.words - 1))).cast("int")
        one = F.expr("shiftleft(1L, cast(h & 63 as int))")
        bits = rows.groupBy(place.alias("k")).agg(F.bit_or(one).alias("b")).collect()  # at most `words` rows
        held = {r["k"]: r["b"] for r in bits}
        # the smallest long has no literal of its own
        one_of = [f"{held.get(k, 0)}L" if held.get(k, 0) != -(1 << 63) else "(-9223372036854775807L - 1L)" for k in range(self.words)]
        self.bits = F.expr(f"array({','.join(one_of)})")

    def may_hold(self, h: Column) -> Column:
        word = F.get(self.bits, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(self.words - 1)).cast("int"))
        return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    def candidates(self, words: Column) -> Column:
        """Places, lengths and texts of the windows that pass the bit map."""

        def passed(hashes: Column, n: int) -> Column:
            return let(
                F.transform(starts(hashes, n), lambda i: window_hash(hashes, i, n)),
                lambda h: F.filter(starts(hashes, n), lambda i: self.may_hold(F.get(h, i - 1))),
            )

        def shown(hashes: Column, n: int) -> Column:
            return F.transform(
                passed(hashes, n),
                lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(words, i, n), " ").alias("window")),
            )

        if not self.lengths:
            return F.array().cast("array<struct<pos:int,len:int,window:string>>")
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(*[shown(h, n) for n in self.lengths]))


def covered(spans: Column) -> Column:
    """Number of places in the union of spans (pos, len)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["len"] - 1
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"] - 1))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def find(
    docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, text_hash, n_words, n_hit, items, spans) of every row: words inside occurrences of windows,
    the items with occurring windows as sorted strings, and the occurrences (pos, len), pos from 1."""
    ws = workspace(docs.sparkSession, "decontaminate")
    known = WindowSet(items, n, item, item_text)
    seen = let(
        words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), known.candidates(w).alias("found"))
    )
    rows = plain(docs, key=key, text=text).select(
        F.monotonically_increasing_id().alias("row"), "key", F.xxhash64("text").alias("text_hash"), seen.alias("seen")
    )
    rows = ws.write(rows.select("row", "key", "text_hash", "seen.*"), "scanned")
    candidates = rows.select("row", F.inline("found"))
    windows = F.broadcast(known.table) if known.small else known.table
    hits = candidates.join(windows, "window").groupBy("row").agg(
        F.collect_list(F.struct("pos", "len")).alias("spans"), F.collect_set("items").alias("items")
    )
    hits = hits.select("row", "spans", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    none = F.array().cast("array<string>"), F.array().cast("array<struct<pos:int,len:int>>")
    return rows.drop("found").join(hits, "row", "left").select(
        F.col("key").alias(key), "text_hash", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"),
    )


def clean(
    docs: DataFrame, items: DataFrame, n: int = 10, mode: str = "documents", key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The documents, all columns, without contaminated ones (``mode="documents"``) or without the
    words that windows cover and the separators before them (``mode="spans"``)."""
    found = find(docs, items, n, key, text, item, item_text).where("n_hit > 0")
    own = found.select(F.col(f"`{key}`").alias("_key"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_key")) & (F.xxhash64(f"`{text}`") == F.col("_hash"))
    own = own.dropDuplicates(["_key", "_hash"]) if mode == "spans" else own.select("_key", "_hash").distinct()
    own = workspace(docs.sparkSession, "contaminated").write(own, "rows")
    size = F.lit(64) + F.coalesce(F.octet_length(F.col("_key").cast("string")), F.lit(0))
    size = size + 8 * F.size("_spans") if mode == "spans" else size
    if (own.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        own = F.broadcast(own)
    if mode == "documents":
        return docs.join(own, same, "left_anti")
    pieces = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RAW_PIECE), F.lit(0))
    tail = F.regexp_extract(F.col(f"`{text}`"), RAW_SEPARATORS + "*$", 0)
    hit = lambda i: F.exists("_spans", lambda s: (s["pos"] <= i + 1) & (i + 1 < s["pos"] + s["len"]))
    left = F.concat(F.array_join(F.filter(pieces, lambda p, i: ~hit(i)), ""), tail)
    cut = F.when(F.col("_spans").isNull(), F.col(f"`{text}`")).otherwise(left)
    joined = docs.join(own, same, "left")
    return joined.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
