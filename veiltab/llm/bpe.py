"""Byte-level BPE encoding by forced-boundary splitting, and decoding.

A merge joins two neighbouring parts into a vocabulary token, so a byte pair that lies inside no
vocabulary token can never be merged over: it marks a certain cut. Texts are split there first. Of the
certain cuts, those before white space are also invisible to the pre-token pattern, so they are applied
to whole byte arrays at once and equal fragments are encoded once; inside a fragment each pre-token is
cut at the remaining marked pairs, the pieces are merged independently and their ids concatenated.

Defined cases: NULL and empty texts have no ids and decode to the empty text; special strings in a
text become their special id, the longest where several start; a tokenizer file of another kind is
refused; a text of any length is one row of one task; other columns, also of the names used here, are
not read; repeated rows are rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veiltab.llm.fragments import FragmentEncoder, certain_cuts, cuts_around, gather, id_type, once, supported
from veiltab.llm.shared import plain
from veiltab.llm.text import column_bytes, row_chunks

# Fixed values of the byte-level format: white space as its pattern has it, and the pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
LONG_PIECE = 64  # bytes; from here on a heap finds the next merge
PRE_TOKENS = 200_000  # pre-tokens kept between batches; emptied when full
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if supported(spec) != "byte level":
            raise ValueError("forced boundaries are those of byte-level BPE")
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [b""] * self.size
        for word, k in vocab.items():
            if word not in self.special:
                self.token[k] = bytes(letters[c] for c in word)
        for word, k in self.special.items():
            self.token[k] = word.encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.merge_of: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge_of[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.pair = np.array(sorted(self.merge_of), np.int64)
        self.pair_rank = np.array([self.merge_of[k][0] for k in self.pair.tolist()] + [NEVER], np.int64)
        self.pair_made = np.array([self.merge_of[k][1] for k in self.pair.tolist()] + [0], np.int64)
        self.cut_pair = np.ones((256, 256), bool)
        for word in vocab:
            if word not in self.special and len(word) > 1:
                own = np.frombuffer(self.token[vocab[word]], np.uint8)
                self.cut_pair[own[:-1], own[1:]] = False
        self.pattern = regex.compile(PRE_TOKEN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.encoder = FragmentEncoder(self._fragments, id_type(self.size), cuts_around(list(self.special), self._cuts))
        self.pre: dict[str, list[int]] = {}
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.token_size = np.array([len(t) for t in self.token], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        cut = certain_cuts(data)
        cut[1:] &= self.cut_pair[data[:-1], data[1:]]
        return cut

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges, the last place if it has none."""
        key = left << 32 | right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, at, len(self.pair)) if len(self.pair) else np.zeros(len(key), np.int64)

    def _merged(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many short pieces at once: each round makes one merge, the lowest-ranked and leftmost,
        in each piece that still has one. ids: byte ids of all pieces, starts: where each begins.
        Returns the ids left and how many each piece has."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = np.diff(np.append(starts, len(ids)))
        piece = np.arange(len(starts))
        found = np.full(len(ids), len(self.pair))
        found[:-1] = self._found(ids[:-1], ids[1:])
        found[starts + size - 1] = len(self.pair)
        while len(piece):
            starts = np.cumsum(size) - size
            rank = self.pair_rank[found]
            least = np.minimum.reduceat(rank, starts)
            open_ = least < NEVER
            if not open_.all():
                rest = np.repeat(open_, size)
                done.append((piece[~open_], size[~open_], ids[~rest]))
                ids, found, rank = ids[rest], found[rest], rank[rest]
                piece, size, least = piece[open_], size[open_], least[open_]
                if not len(piece):
                    break
                starts = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(least, size))
            own = np.searchsorted(starts, hit, "right")
            hit = hit[np.append(True, own[1:] != own[:-1])]
            ids[hit] = self.pair_made[found[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, found, at = ids[keep], found[keep], hit - np.arange(len(hit))
            size = size - 1
            starts = np.cumsum(size) - size
            for where in (at, at[at > starts] - 1):
                inner = where[where + 1 < len(ids)]
                found[inner] = self._found(ids[inner], ids[inner + 1])
            found[starts + size - 1] = len(self.pair)
        order = np.argsort(np.concatenate([d[0] for d in done]), kind="stable")
        sizes = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        return gather(flat, np.cumsum(sizes) - sizes, sizes, order)[0], sizes[order]

    def _merged_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merge_of.get(parts[i] << 32 | parts[j])) is not None:
                heapq.heappush(heap, (m[0], i, parts[i], parts[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def _pre_tokens(self, words: list[str]) -> list[list[int]]:
        """Ids of pre-tokens: cut at the marked pairs, merged piece by piece, concatenated."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        cut = np.zeros(len(data), bool)
        cut[1:] = self.cut_pair[data[:-1], data[1:]]
        cut[0] = True
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, len(data)))
        ids = self.byte_id[data]
        long = size >= LONG_PIECE
        own = np.repeat(long, size)
        flat, got = self._merged(ids[~own], np.cumsum(size[~long]) - size[~long]) if not long.all() else (ids[:0], size[:0])
        sizes, parts = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        sizes[~long], parts[~long] = got, np.cumsum(got) - got
        for k in np.flatnonzero(long).tolist():
            merged = self._merged_long(ids[starts[k] : starts[k] + size[k]].tolist())
            sizes[k], parts[k] = len(merged), len(flat)
            flat = np.append(flat, merged)
        flat, at = gather(flat, parts, sizes, np.arange(len(sizes)))
        at = at[np.append(0, np.searchsorted(starts, ends))].tolist()
        flat = flat.tolist()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def _fragments(self, fragments: list[bytes]) -> list[list[int]]:
        if len(self.pre) > PRE_TOKENS:
            self.pre.clear()
        cut = []
        for f in fragments:
            text = f.decode()
            parts = [text] if self.at_special is None else self.at_special.split(text)
            cut.append([w for p in parts for w in ([p] if p in self.special else self.pattern.findall(p))])
        known = {w: [k] for w, k in self.special.items()}
        missing = list({w: None for ws in cut for w in ws if w not in self.pre and w not in known})
        if missing:
            new = dict(zip(missing, self._pre_tokens(missing)))
            known |= new
            self.pre.update((w, x) for w, x in new.items() if len(w) <= 32)
        pre = self.pre
        return [[k for w in ws for k in (known.get(w) or pre[w])] for ws in cut]

    def decode_rows(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Text of each row of ids; bytes that are no UTF-8 become U+FFFD."""
        flat, at = gather(self.token_bytes, self.token_at, self.token_size, ids)
        raw, ends = flat.tobytes(), at[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def model(path: str) -> ForcedBoundaryBPE:
    return once(("forced", path), lambda: ForcedBoundaryBPE(path))


ENCODED = T.StructType([T.StructField("key", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for first, ids, at in bpe.encoder.rows(*column_bytes(batch.column(1))):
                rows = len(at) - 1
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), lists], ["key", "ids"])

    return plain(docs, key=key, text=text).mapInArrow(run, ENCODED).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every list of ids; a NULL list decodes to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            col = batch.column(1)
            sizes = np.array([0 if v is None else v for v in col.value_lengths().to_pylist()], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in row_chunks(at * 4):
                own = flat[at[a] : at[b]]
                texts = bpe.decode_rows(own, at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string())], ["key", "text"])

    schema = "key long, text string"
    return plain(encoded, key=key, ids=ids).mapInArrow(run, schema).withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number and digest of its ids, and the digest of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for first, ids, at in bpe.encoder.rows(*column_bytes(batch.column(1))):
                raw, ends = ids.astype("<u4").tobytes(), (at * 4).tolist()
                sums = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
                back = [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode_rows(ids, at)]
                cols = [batch.column(0).slice(first, len(sums)), pa.array(np.diff(at)), pa.array(sums), pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return plain(docs, key=key, text=text).mapInArrow(run, schema).withColumnRenamed("key", key)
