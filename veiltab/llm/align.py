"""Alignment of two tokenizers over a corpus, each distinct text once.

1. Rows are shuffled by their full text, counted before the shuffle, so a text that holds a third of all
   rows is one row with a multiplicity.
2. Each distinct text, with a space in front, is encoded by both tokenizers and cut where a token of either
   ends at the same byte. A cut is certain before a space that follows a character which is no white space:
   no pre-token and no merge of either reaches over it (the second vocabulary is checked for that). So the
   fragments between are aligned on their own, equal ones of a chunk once.
3. Pair counts are sums over distinct texts of occurrences times multiplicity. Each text's links are joined
   to them and summed, and the measures are joined to the rows by the text's SHA-256.

Pair counts are broadcast up to 64 MB and joined by a salted shuffle beyond it.

Defined cases: texts that are NULL or empty, or whose joined token bytes differ from space and text (U+2581
in the text, for one), have no tokens: zeros and ''. Very long texts are whole; memory follows the longest.
Repeated rows and rows that share a key, or have none, are rows of their own; ties for the highest count
all count as best; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.bpe import byte_letters
from veiltab.llm.fragments import certain_cuts, distinct, gather, once, ranges
from veiltab.llm.shared import plain, workspace
from veiltab.llm.text import column_bytes, row_chunks
from veiltab.session import lookup

SPACE_MARK = "▁"
MARK_BYTES = SPACE_MARK.encode()
JOINED = 4096  # fragments that are encoded and aligned as one text
FRAGMENTS = 200_000  # aligned fragments kept between chunks; emptied when full
KEPT_BYTES = 64  # of a fragment that is kept
MEASURES = (
    "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
)

Aligned = tuple[int, int, int, bytes, bytes]  # tokens of A and of B, groups, their text, the linked pairs
Ids = tuple[np.ndarray, np.ndarray]  # of many fragments, and how many each has


class Strings:
    """A list of byte strings as one array, to concatenate picks of them."""

    def __init__(self, items: list[bytes]):
        self.size = np.array([len(x) for x in items], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(items), np.uint8)

    def concat(self, picks: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.begin, self.size, picks)[0]


class Aligner:
    """Aligns a byte-level BPE (A, a tokenizers file) with a piece model (B, a sentencepiece file)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        with open(path_a, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        letters = byte_letters()
        words = self.a.get_vocab(with_added_tokens=True)
        tokens = [b""] * (1 + max(words.values()))
        for word, k in words.items():
            tokens[k] = word.encode() if word in added else bytes(letters[c] for c in word)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece holds a space inside: texts cannot be cut before spaces")
        own = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = Strings(tokens), Strings(own)
        # an id as it is written: within a group, and as the last of A or of B in it
        size_a, size_b = len(tokens), len(pieces)
        shown = [f"{k}{end}".encode() for end, n in ((",", size_a), ("|", size_a), (",", size_b), (";", size_b)) for k in range(n)]
        self.shown, self.from_b = Strings(shown), 2 * size_a
        self.alone = self.b.piece_to_id(SPACE_MARK)
        self.known: dict[bytes, Aligned | None] = {}

    def _apart_a(self, fragments: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast([f.decode() for f in fragments], add_special_tokens=False)]

    def _apart_b(self, fragments: list[bytes]) -> list[list[int]]:
        """The model puts a space in front, but not before nothing."""
        return [x if len(f) > 1 else [self.alone] for f, x in zip(fragments, self.b.encode([f[1:].decode() for f in fragments], num_threads=1))]

    @staticmethod
    def _dealt(ids: np.ndarray, size: np.ndarray, fragments: list[bytes]) -> Ids | None:
        """Ids of joined fragments, dealt out by the bytes they cover; None if that doesn't work out."""
        at, want = np.cumsum(size[ids]), np.cumsum([len(f) for f in fragments])
        if not len(ids) or at[-1] != want[-1]:
            return None
        cut = np.searchsorted(at, want)
        return (ids, np.diff(cut, prepend=-1)) if (at[cut] == want).all() else None

    def _ids(self, fragments: list[bytes]) -> tuple[Ids, Ids]:
        """Ids of A and of B. Fragments that end in white space would run into the next one, so they are encoded apart."""
        if all(f[-1] > 0x20 and MARK_BYTES not in f for f in fragments):
            text = b"".join(fragments).decode()
            a = self._dealt(np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), self.bytes_a.size, fragments)
            b = self._dealt(np.array(self.b.encode(text[1:]), np.int64), self.bytes_b.size, fragments)
            if a is not None and b is not None:
                return a, b
        out = []
        for lists in (self._apart_a(fragments), self._apart_b(fragments)):
            count = np.array([len(x) for x in lists], np.int64)
            out.append((np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum())), count))
        return tuple(out)

    def _align(self, fragments: list[bytes]) -> list[Aligned | None]:
        """All of the fragments at once, as one run of bytes."""
        (ids_a, n_a), (ids_b, n_b) = self._ids(fragments)
        size = np.array([len(f) for f in fragments], np.int64)
        number = np.arange(len(size))
        row_a, row_b = np.repeat(number, n_a), np.repeat(number, n_b)
        same = np.bincount(row_a, self.bytes_a.size[ids_a], len(size)) == size
        same &= np.bincount(row_b, self.bytes_b.size[ids_b], len(size)) == size
        keep_a, keep_b = same[row_a], same[row_b]
        ids_a, row_a, ids_b, row_b = ids_a[keep_a], row_a[keep_a], ids_b[keep_b], row_b[keep_b]
        want = np.frombuffer(b"".join(f for f, s in zip(fragments, same.tolist()) if s), np.uint8)
        byte_row = np.repeat(number[same], size[same])
        for found in (self.bytes_a.concat(ids_a), self.bytes_b.concat(ids_b)):
            same[byte_row[found != want]] = False  # what else is computed for these is not used
        to_a, to_b = np.cumsum(self.bytes_a.size[ids_a]), np.cumsum(self.bytes_b.size[ids_b])
        last_a, last_b = np.isin(to_a, to_b), np.isin(to_b, to_a)
        pairs = ids_a[last_a] << 32 | ids_b[last_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # in each group the ids of A, then those of B
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        entry = np.concatenate([ids_a + last_a * (self.from_b // 2), ids_b + self.from_b + last_b * len(self.bytes_b.size)])[order]
        text = self.shown.concat(entry).tobytes()
        chars = np.bincount(np.concatenate([row_a, row_b])[order], self.shown.size[entry], len(size)).astype(np.int64)
        groups = np.bincount(row_a[last_a], minlength=len(size))
        text_at, pair_at = np.cumsum(chars).tolist(), np.cumsum(8 * groups).tolist()
        raw = pairs.tobytes()
        numbers = zip(same.tolist(), n_a.tolist(), n_b.tolist(), groups.tolist(), [0, *text_at], text_at, [0, *pair_at], pair_at)
        return [(x, y, g, text[s : e - 1], raw[p:q]) if ok else None for ok, x, y, g, s, e, p, q in numbers]

    def aligned(self, fragments: list[bytes]) -> list[Aligned | None]:
        """Each fragment starts with a space. None: the bytes don't come back."""
        if len(self.known) > FRAGMENTS:
            self.known.clear()
        new: dict[bytes, Aligned | None] = {}
        missing = [f for f in fragments if f not in self.known]
        joined = [f for f in missing if f[-1] > 0x20 and MARK_BYTES not in f]
        apart = [f for f in missing if f[-1] <= 0x20 or MARK_BYTES in f]
        for own in (joined, apart):
            for k in range(0, len(own), JOINED):
                new.update(zip(own[k : k + JOINED], self._align(own[k : k + JOINED])))
        out = [new[f] if f in new else self.known[f] for f in fragments]
        self.known.update((f, x) for f, x in new.items() if len(f) <= KEPT_BYTES)
        return out

    def rows(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
        """Of each row n_a, n_b and groups (three columns) and the text of its groups; row, pair and times of its links."""
        size = np.diff(bounds)
        some = size > 0
        data = np.insert(data, bounds[:-1][some], 0x20)
        bounds = bounds + np.append(0, np.cumsum(some))
        starts, ends, row_at = ranges(data, bounds, certain_cuts(data) & (data == 0x20))
        first, kind = distinct(data, starts, ends)
        raw = data.tobytes()
        made = self.aligned([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
        lost = np.array([m is None for m in made], bool)
        numbers = np.array([(0, 0, 0) if m is None else m[:3] for m in made], np.int64).reshape(-1, 3)
        texts = [b"" if m is None else m[3] for m in made]
        total = np.zeros((len(kind) + 1, 4), np.int64)
        np.cumsum(np.column_stack([numbers, lost])[kind], axis=0, out=total[1:])
        found = total[row_at[1:]] - total[row_at[:-1]]
        good = some & (found[:, 3] == 0)
        found[~good] = 0
        kinds, at = kind.tolist(), row_at.tolist()
        groups = [b";".join([texts[k] for k in kinds[x:y]]) if g else None for g, x, y in zip(good.tolist(), at, at[1:])]
        flat = np.frombuffer(b"".join(b"" if m is None else m[4] for m in made), np.int64)
        links, link_at = gather(flat, np.cumsum(numbers[:, 2]) - numbers[:, 2], numbers[:, 2], kind)
        row = np.repeat(np.arange(len(size)), np.diff(link_at[row_at]))
        links, row = links[good[row]], row[good[row]]
        names, of = np.unique(links, return_inverse=True)
        both, times = np.unique(row * max(len(names), 1) + of, return_counts=True)
        return found[:, :3], groups, both // max(len(names), 1), names[both % max(len(names), 1)], times


def align_texts(texts: DataFrame, path_a: str, path_b: str, whole: bool) -> DataFrame:
    """Measures of distinct texts (digest, copies, text). groups: the text of the groups if ``whole``, its SHA-256 else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = once(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            data, bounds = column_bytes(batch.column(2))
            for x, y in row_chunks(bounds):
                found, groups, row, pair, times = own.rows(data[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x])
                shown = [("" if g is None else g.decode() if whole else hashlib.sha256(g).hexdigest()) for g in groups]
                at = pa.array(np.searchsorted(row, np.arange(y - x + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int64())) for v in (pair, times)]
                numbers = [pa.array(found[:, k]) for k in (0, 1, 2, 2)]
                made = [batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), *numbers, pa.array(shown, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(made, ["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return texts.select("digest", "copies", "text").mapInArrow(run, MEASURES)


def align(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", whole: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row, and (a, b, count, best) of every linked pair."""
    ws = workspace(docs.sparkSession, "align")
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    rows = plain(docs, key=key, text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    own = ws.write(rows.select("key", digest), "digests")
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(digest, "copies", "text")
    measures = ws.write(align_texts(texts, path_a, path_b, whole), "measures")
    links = measures.select("digest", "copies", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("digest", "copies", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    pairs = links.groupBy("pair").agg(F.sum(F.col("copies") * F.col("times")).alias("count"))
    pairs = ws.write(pairs, "pairs")
    # the pairs of one b are at most as many as the first vocabulary has tokens
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = F.max("count").over(Window.partitionBy(b))
    pairs = ws.write(pairs.select("pair", "count", (F.col("count") == most).alias("best")), "counts")
    joined = lookup(links.select("digest", "pair", "times"), pairs, ["pair"], pairs.count())
    sums = joined.groupBy("digest").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    # one row per digest, written, so that the join below reads plain shuffles and a hot digest can be split
    known = ws.write(measures.drop("pairs", "times", "copies").join(sums, "digest", "left"), "known")
    done = own.join(known, "digest").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups",
    )
    return done, pairs.select(F.shiftright("pair", 32).alias("a"), b.alias("b"), "count", "best")
