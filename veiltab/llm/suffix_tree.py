"""Language-model scores from a probabilistic suffix tree over words.

Tokens are the words (A-Z lower-cased, between ASCII white space) and one end per text. The tree's
states are contexts of up to ``order`` preceding tokens (the depth of the tree):

* Order 0 holds the count of every training token. Counts are discounted; the discount goes to one
  symbol for all unseen tokens.
* Candidates of order 1 are all tokens and the begin of a text. A context of order k + 1 is a candidate if its
  last token is listed in the context before it, and the context without its first token is a candidate too.
* A candidate lists a next token seen ``least`` times in it whose occurrences there are ``evidence`` nats more
  likely than by what its suffix state gives them: n ln(p / q), its share of the divergence of the two
  distributions times the context's size. The other next tokens get the rest, in proportion to what the
  suffix state gives them. A candidate that lists nothing does not diverge and is no state.

All of these are absolute counts, the same at every size, so a pattern is learnt wherever it was seen often
enough and the tree grows with the corpus. Its tables are written and joined by shuffle.

A text's score uses the longest suffix state at each token. It is a sum: order 0 of each token, and for each
order the log weight of the state's rest and, if the token is listed, what it has beyond that. So a
text is a bag of keys (states and listed pairs) and the tree a table (key, value). The ``held`` keys seen most
and the tokens that make up ``share`` of all are looked up in broadcast tables. The others go through a bit map of bounded size, which
only spares rows, and those it lets pass are joined by shuffle; none of them is hot in the training texts, as
``held`` others are seen at least as often.

Words are identified by a mixed 64-bit hash, contexts by a hash of those; among 10^9 different words a
collision has odds of 1 in 37, among 10^8 keys of 1 in 3,700. A collision joins the counts of the two.

Defined cases: NULL and empty texts are one end; NULL keys count as training; rows that repeat are
counted and scored each; without training tokens every token has probability 1; a very long text is one
array of its own in a task; columns other than the two named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.llm.shared import plain, workspace
from veiltab.llm.text import LOWER, column_bytes, follow, hash_ranges, row_chunks, signed, words
from veiltab.session import small_side

BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA0761D6478BD642F)
HELD_COUNTS = 1 << 20  # counts a task holds before it hands them on
COUNTS = "h long, n long"
NAMES = ["back", "ctx", "h"]
STATE = np.uint64(0x9FB21C651E98DF24)  # tells the key of a state from that of the pair with the same hash
MAP_WORDS = 1 << 22  # words of a bit map at most (32 MB): it lets more pass in larger trees, nothing is lost


class Lookup:
    """Places of 64-bit hashes among sorted ones."""

    def __init__(self, keys: np.ndarray):
        """keys: sorted and distinct."""
        self.bits = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        slots = np.arange(1 << (64 - int(self.bits)), dtype=np.uint64) << self.bits
        self.first = np.searchsorted(keys, slots).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for those that are not there."""
        at = self.first[h >> self.bits]
        todo = np.flatnonzero(self.keys[at] < h)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < h[todo]]
        known = (self.keys[at] == h) & (at < len(self.keys) - 1)
        return np.where(known, at, -1)


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of rows, an end after each, and the bounds of the rows in them."""
    data = LOWER[data]
    starts, ends, at = words(data, bounds)
    h = hash_ranges(data, starts, ends)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def contexts_of(tokens: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1 the hash of the context of each token, 0 where the text is shorter."""
    out = [np.append(BEGIN, tokens[:-1])]
    out[0][at[:-1]] = BEGIN
    place = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
    for k in range(2, order + 1):
        ctx = np.append(np.uint64(0), follow(out[-1][:-1], tokens[:-1]))
        ctx[place < k - 1] = 0
        out.append(ctx)
    return out


def bit_mask(key: np.ndarray) -> np.ndarray:
    """The four bits (some may be equal) of a key in its word of the bit map. The word is told by the upper
    22 bits at most; none of the lowest 18 has a part in it."""
    one = np.uint64(1)
    mask = np.zeros(len(key), np.uint64)
    for k in range(4):
        mask |= one << ((key >> np.uint64(18 + 6 * k)) & np.uint64(63))
    return mask


class BitMap:
    """Which 64-bit keys may be in a table (at most MAP_WORDS words): never wrong about one that is."""

    def __init__(self, table: DataFrame, key: str):
        rows = table.count()
        self.size = min(MAP_WORDS, max(16, 1 << int(rows // 4).bit_length()))  # about 16 bits a key
        self.shift = np.uint64(64 - (self.size.bit_length() - 1))
        mask = F.lit(0).cast("long")
        for k in range(4):
            mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftright(`{key}`, {18 + 6 * k}) & 63 as int))"))
        place = F.shiftrightunsigned(key, int(self.shift)).alias("place")
        at, bits = _collect(table.groupBy(place).agg(F.bit_or(mask).alias("bits")), "place", "bits")  # at most MAP_WORDS rows
        self.words = np.zeros(self.size, np.uint64)
        self.words[at] = bits.view(np.uint64)

    def may_hold(self, key: np.ndarray) -> np.ndarray:
        mask = bit_mask(key)
        return (self.words[key >> self.shift] & mask) == mask


@dataclass
class Model:
    total: int  # training tokens, ends included
    kinds: int
    discount: float
    order: int  # of the longest states
    common: Lookup  # tokens seen most
    counts: np.ndarray
    keys: Lookup | None = None  # states and listed pairs seen most
    values: np.ndarray | None = None
    others: BitMap | None = None  # of the other states and pairs

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.total + 1.0 * (self.kinds + 1)))

    def log_root(self, c: np.ndarray) -> np.ndarray:
        """Order 0, of a token seen c times."""
        return np.log10((c - self.discount) / self.total)

    def log_unseen(self) -> float:
        return float(np.log10(self.discount * self.kinds / self.total)) if self.total else 0.0

    def deepen(self, log_p: np.ndarray, tokens: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log_p by order 0 to log_p by the broadcast part of the tree; places and keys for its other part."""
        log_p, places, keys = log_p.copy(), [], []

        def add(at: np.ndarray, key: np.ndarray) -> np.ndarray:
            """Which of the keys may be in the tree."""
            found = self.keys.find(key)
            log_p[at] += np.where(found >= 0, self.values[found] if len(self.values) else 0.0, 0.0)
            rest = (found < 0) & self.others.may_hold(key)
            places.append(at[rest])
            keys.append(key[rest])
            return (found >= 0) | rest

        for ctx in contexts:
            at = np.flatnonzero(ctx)
            at = at[add(at, ctx[at] ^ STATE)]
            add(at, follow(ctx[at], tokens[at]))
        if not keys:
            return log_p, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        place, key = np.concatenate(places), np.concatenate(keys)
        by = np.argsort(place, kind="stable")
        return log_p, place[by], key[by]


class _Counter:
    """Counts of a task, handed on before they become many."""

    def __init__(self, rows=None):
        """rows: batches from the parts and the counts, ordered by key."""
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.rows = 0, rows or _count_rows

    def add(self, key: np.ndarray, parts: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        self.held.append((key[first], n, *(p[first] for p in parts)))
        self.size += len(first)
        if self.size > 2 * HELD_COUNTS:
            yield from self.flush(HELD_COUNTS)

    def flush(self, keep: int = 0) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        key, n, *parts = (np.concatenate(x) for x in zip(*self.held))
        _, first, kind = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(kind, n, len(first)).astype(np.int64)
        self.held, self.size = [(key[first], n, *(p[first] for p in parts))], len(first)
        if len(first) > keep:
            yield from self.rows([p[first] for p in parts], n)
            self.held, self.size = [], 0


def _count_rows(parts: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    cols = [pa.array(signed(p)) for p in parts] + [pa.array(n)]
    for a in range(0, len(n), 1 << 18):
        yield pa.RecordBatch.from_arrays([c.slice(a, 1 << 18) for c in cols], [*NAMES[-len(parts) :], "n"])


class _Packed:
    """Counts of 64-bit keys as blocks of bytes, one a bucket of keys: 40 bits of a key beyond the bucket's, plane
    by plane, and a count of at most 255. A quarter of the bytes that rows of keys would shuffle."""

    SCHEMA = "bucket int, keys binary, n binary"

    def __init__(self, keys: int):
        """keys: at most so many; a bucket gets a million or less, so one task can hold it."""
        self.bits = max(6, min(24, (keys >> 20).bit_length()))

    def __call__(self, parts: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = parts[0]
        planes = np.ascontiguousarray((key >> np.uint64(24 - self.bits)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        few = np.minimum(n, 255).astype(np.uint8)
        bucket, first = np.unique(key >> np.uint64(64 - self.bits), return_index=True)
        cuts = [*zip(first, np.append(first[1:], len(key)))]
        cols = [pa.array(bucket.astype(np.int32)), pa.array([planes[a:b].T.tobytes() for a, b in cuts]), pa.array([few[a:b].tobytes() for a, b in cuts])]
        yield pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "n"])

    def often(self, blocks: DataFrame, least: int) -> DataFrame:
        """(key) of those counted ``least`` times, the bits beyond those kept being zero."""
        bits = self.bits

        def merge(block: pa.Table) -> pa.Table:
            keys, ns = [], []
            for planes, n in zip(block.column("keys"), block.column("n")):
                few = np.frombuffer(n.as_py(), np.uint8)
                low = np.zeros((len(few), 8), np.uint8)
                low[:, :5] = np.frombuffer(planes.as_py(), np.uint8).reshape(5, -1).T
                keys.append(low.view("<u8").ravel())
                ns.append(few)
            key, kind = np.unique(np.concatenate(keys), return_inverse=True)
            key = key[np.bincount(kind, np.concatenate(ns), len(key)) >= least]
            top = np.uint64(block.column("bucket")[0].as_py() << (64 - bits))
            return pa.table({"key": signed(top | (key << np.uint64(24 - bits)))})

        return blocks.groupBy("bucket").applyInArrow(merge, "key long")


def _token_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, bounds = column_bytes(batch.column(column))
        for a, b in row_chunks(bounds):
            yield batch, a, b, *tokens_of(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])


def _collect(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table whose rows are bounded."""
    got = df.select(*names).toArrow()
    return [got.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]


@dataclass
class Suffixes:
    """The parameters; see the module's text."""

    order: int = 3
    least: int = 4  # 255 at most
    evidence: float = 16.0
    discount: float | None = None  # None: by how many tokens were seen once and twice
    held: int = 1 << 21  # entries of a broadcast table at most (16 bytes each); changes no result
    share: float = 2.0**-20  # of the training tokens: those that are broadcast, at most 1/share; changes no result

    def fit(self, texts: DataFrame, ws) -> tuple[Model, DataFrame, DataFrame]:
        """The model of a table (text), the counts of all its tokens (h, n), and all states and listed
        pairs of its tree (order, key, value, n)."""

        def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = _Counter()
            for _, _, _, tokens, _ in _token_batches(batches, 0):
                yield from counter.add(tokens, (tokens,))
            yield from counter.flush()

        counts = ws.write(texts.mapInArrow(ones, COUNTS).groupBy("h").agg(F.sum("n").alias("n")), "counts")
        of = counts.agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")
        ).first()
        total, n1, n2 = of["n"] or 0, of["n1"], of["n2"]
        discount = self.discount or (n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
        h, n = _collect(counts.where(F.col("n") >= self.share * total), "h", "n")
        by = np.argsort(h.view(np.uint64))
        model = Model(total, of["v"], discount, 0, Lookup(h.view(np.uint64)[by]), n[by])
        tree = ws.write(self._grow(texts, ws, model, counts), "tree")
        most = self._seen_most(tree)
        key, value = _collect(tree.where(most), "key", "value")
        by = np.argsort(key.view(np.uint64))
        model.keys, model.values = Lookup(key.view(np.uint64)[by]), value[by]
        others = tree.where(~most)
        model.others = BitMap(others, "key")
        return model, counts, others

    def _seen_most(self, table: DataFrame) -> Column:
        """A condition that ``held`` rows of (n) at most meet, those with the largest n."""
        size = F.floor(F.log2("n") * 4).cast("int")
        cut, rows = 1 << 10, 0
        for r in sorted(table.groupBy(size.alias("size")).count().collect(), reverse=True):  # below 256 rows
            rows += r["count"]
            if rows > self.held:
                break
            cut = r["size"]
        return size >= cut

    def _grow(self, texts: DataFrame, ws, model: Model, counts: DataFrame) -> DataFrame:
        """(order, key, value, n) of the states and listed pairs, order by order."""
        tree = texts.sparkSession.createDataFrame([], "order int, key long, value double, n long")
        begin, end = (F.lit(int(signed(np.array([x]))[0])) for x in (BEGIN, END))
        again = counts.where(F.col("n") >= self.least)  # a pair is not seen more often than its tokens
        contexts = again.select(F.when(F.col("h") == end, begin).otherwise(F.col("h")).alias("ctx"), F.col("n").alias("size"))
        before = again.select(F.col("h").alias("back"), F.log10((F.col("n") - model.discount) / float(model.total or 1)).alias("log_q"))
        for k in range(1, self.order + 1):
            if k == 1:
                found = self._first_pairs(texts, ws, model, again)
            else:
                found = self._longer_pairs(texts, ws, model, k, BitMap(contexts, "ctx"), BitMap(pairs, "pair"))
            found = found.join(_sized(contexts), "ctx").join(_sized(before), "back")
            pairs = ws.write(found.mapInArrow(_name, PAIR), f"pairs{k}").withColumn("p", (F.col("n") - model.discount) / F.col("size"))
            pairs = pairs.withColumn("listed", F.col("n") * (F.log10("p") - F.col("log_q")) >= self.evidence / np.log(10))
            listed = pairs.where("listed")
            states = listed.groupBy("ctx").agg(
                F.max("size").alias("n"), F.log10((1 - F.sum("p")) / (1 - F.sum(F.pow(F.lit(10.0), "log_q")))).alias("rest")
            )
            states = ws.write(states, f"states{k}")
            rests = _sized(states.select("ctx", "rest"))
            tree = tree.unionByName(
                states.select(F.lit(k).alias("order"), F.col("ctx").bitwiseXOR(F.lit(int(STATE) - 2**64)).alias("key"), F.col("rest").alias("value"), "n")
            ).unionByName(
                listed.join(rests, "ctx").select(
                    F.lit(k).alias("order"), F.col("pair").alias("key"), (F.log10("p") - F.col("log_q") - F.col("rest")).alias("value"), "n"
                )
            )
            if states.isEmpty():
                break
            model.order = k
            if k == self.order:
                break
            longer = listed.where("not ends")
            if k > 1:
                longer = longer.join(_sized(contexts.select(F.col("ctx").alias("back"))), "back", "left_semi")
            # a pair that is listed is the hash of the context one longer
            contexts = ws.write(longer.select(F.col("pair").alias("ctx"), F.col("n").alias("size")), f"contexts{k + 1}")
            own = F.when(F.col("listed"), F.log10("p")).otherwise(F.coalesce("rest", F.lit(0.0)) + F.col("log_q"))
            before = pairs.join(rests, "ctx", "left").select(F.col("pair").alias("back"), own.alias("log_q"))
        return tree

    def _first_pairs(self, texts: DataFrame, ws, model: Model, again: DataFrame) -> DataFrame:
        """(ctx, h, back, n) of the pairs of two tokens seen often enough; back is the token.

        Most pairs are seen once. A first pass counts packed hashes of them and tells which may be seen often
        enough, a second one counts those exactly."""
        sc = texts.sparkSession.sparkContext
        packed = _Packed(model.total)
        tokens_map = sc.broadcast(BitMap(again, "h"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, counter = tokens_map.value, _Counter(packed)
            for _, _, _, tokens, at in _token_batches(batches, 0):
                own, go = contexts_of(tokens, at, 1)[0], wanted.may_hold(tokens)
                go[1:] &= go[:-1] | (own[1:] == BEGIN)
                pair = follow(own[go], tokens[go])
                yield from counter.add(pair, (pair,))
            yield from counter.flush()

        often = ws.write(packed.often(texts.mapInArrow(pack, packed.SCHEMA), self.least), "often")
        shared = sc.broadcast(BitMap(often, "key"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, counter = shared.value, _Counter()
            for _, _, _, tokens, at in _token_batches(batches, 0):
                own = contexts_of(tokens, at, 1)[0]
                pair = follow(own, tokens)
                go = np.flatnonzero(wanted.may_hold(pair))
                yield from counter.add(pair[go], (own[go], tokens[go]))
            yield from counter.flush()

        rows = texts.mapInArrow(count, "ctx long, h long, n long").groupBy("ctx", "h").agg(F.sum("n").alias("n"))
        return rows.where(F.col("n") >= self.least).withColumn("back", F.col("h"))

    def _longer_pairs(self, texts: DataFrame, ws, model: Model, k: int, contexts: BitMap, shorter: BitMap) -> DataFrame:
        """(ctx, h, back, n) of the pairs of a context and its next token seen often enough; back is the pair
        of the context's suffix, which was then seen often enough too. Contexts and backs are as the maps tell.

        After contexts of two tokens most pairs are seldom seen, so a first pass counts packed hashes, like that of
        two tokens. After longer ones it would spare few rows."""
        sc = texts.sparkSession.sparkContext
        maps = sc.broadcast((contexts, shorter))

        def candidates(tokens: np.ndarray, at: np.ndarray, maps: tuple[BitMap, BitMap]) -> tuple[np.ndarray, ...]:
            """Pair, back, context and next token of those that the maps let pass."""
            own = contexts_of(tokens, at, k)
            go = np.flatnonzero(own[-1])
            go = go[maps[0].may_hold(own[-1][go])]
            back = follow(own[-2][go], tokens[go])
            held = maps[1].may_hold(back)
            go, back = go[held], back[held]
            return follow(own[-1][go], tokens[go]), back, own[-1][go], tokens[go]

        often = None
        if k == 2:
            packed = _Packed(model.total)

            def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held, counter = maps.value, _Counter(packed)
                for _, _, _, tokens, at in _token_batches(batches, 0):
                    pair = candidates(tokens, at, held)[0]
                    yield from counter.add(pair, (pair,))
                yield from counter.flush()

            often = sc.broadcast(BitMap(ws.write(packed.often(texts.mapInArrow(pack, packed.SCHEMA), self.least), f"often{k}"), "key"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, counter = maps.value, _Counter()
            for _, _, _, tokens, at in _token_batches(batches, 0):
                pair, *parts = candidates(tokens, at, held)
                if often is not None:
                    go = often.value.may_hold(pair)
                    pair, parts = pair[go], [p[go] for p in parts]
                yield from counter.add(pair, tuple(parts))
            yield from counter.flush()

        rows = texts.mapInArrow(count, "back long, ctx long, h long, n long")
        return rows.groupBy("ctx", "h").agg(F.sum("n").alias("n"), F.max("back").alias("back")).where(F.col("n") >= self.least)


PAIR = "ctx long, back long, n long, size long, log_q double, pair long, ends boolean"


def _sized(table: DataFrame) -> DataFrame:
    """To be broadcast if its rows, which are counted, fit."""
    return small_side(table, table.count())


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the hash of the context and its next token, and whether that is the end."""
    names = [c.split()[0] for c in PAIR.split(", ")]
    for batch in batches:
        ctx, h = (batch.column(n).to_numpy().view(np.uint64) for n in ("ctx", "h"))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-2]), pa.array(signed(follow(ctx, h))), pa.array(h == END)], names)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", parameters: Suffixes | None = None) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``train`` (over the column ``key``) marks the rows to learn from. score is the log10 probability of
    the text, base_score that of its tokens by their training counts plus one."""
    spark = docs.sparkSession
    ws = workspace(spark, "suffixtree")
    rows = plain(docs, key=key, text=text).withColumn("train", train)
    model, counts, others = (parameters or Suffixes()).fit(rows.where("train").select("text"), ws)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, a, b, tokens, at in _token_batches(batches, 3):
            place = model.common.find(tokens)
            common = place >= 0
            c = model.counts[place] if len(model.counts) else np.zeros(len(tokens))
            log_p = np.where(common, model.log_root(np.where(common, c, 1)), 0.0) if model.total else np.zeros(len(tokens))
            log_p, to_join, keys = model.deepen(log_p, tokens, contexts_of(tokens, at, model.order) if model.order else [])
            base = np.where(common, model.base(c), 0.0)
            rare = np.flatnonzero(~common)
            cols = [batch.column(k).slice(a, b - a) for k in range(3)] + [
                pa.array(np.diff(at)),
                pa.array(np.add.reduceat(common.astype(np.int64), at[:-1])),
                pa.array(np.add.reduceat(base, at[:-1])),
                pa.array(np.add.reduceat(log_p, at[:-1])),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, at), pa.int32()), pa.array(signed(tokens[rare]))),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(to_join, at), pa.int32()), pa.array(signed(keys))),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["row", "key", "train", "n_tokens", "n_known", "base", "score", "rare", "keys"])

    schema = "row long, key long, train boolean, n_tokens long, n_known long, base double, score double, rare array<long>, keys array<long>"
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "key", "train", "text")
    scored = ws.write(numbered.mapInArrow(run, schema), "scored")
    c, total = F.coalesce("n", F.lit(0)), float(model.total)
    seen = F.log10((c - F.lit(model.discount)) / F.lit(max(total, 1.0)))
    rare = scored.select("row", F.explode("rare").alias("h")).join(counts, "h", "left").select(
        "row",
        F.col("n").isNotNull().cast("long").alias("more"),
        F.log10((c + 1.0) / F.lit(total + model.kinds + 1)).alias("rare_base"),
        F.when(F.col("n").isNull(), F.lit(model.log_unseen())).otherwise(seen).alias("rare_score"),
    )
    deep = scored.select("row", F.explode("keys").alias("key")).join(others, "key").select(
        "row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("rare_base"), F.col("value").alias("rare_score")
    )
    joined = rare.unionByName(deep).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "rare_base", "rare_score")])
    zero = F.lit(0.0)
    return scored.drop("rare", "keys").join(joined, "row", "left").select(
        F.col("key").alias(key), "train", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", zero)).alias("score"),
    )
