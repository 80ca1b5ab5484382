"""Tokenize a batch by encoding each distinct fragment once.

Texts are cut where a cut is certain: before white space that follows a character which is not white
space, and between an ASCII letter and a mark of ``MARKS``. No pre-token spans such a place and no
look-ahead of the split patterns reaches over it, so the fragments' ids, concatenated, are the ids of
the text. Equal fragments of a chunk are found by hash
and verified by a second hash; a bounded dictionary keyed by the bytes carries ids between chunks.

The cuts hold for the split rules of ``SPLITS``; a tokenizer file with others is refused. Its added tokens
may hold any characters: no cut is made inside an occurrence of one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np

from veiltab.llm.text import SPACE, hash_ranges, row_chunks, same_as

JOINED = 4096  # fragments of one call to a library
CACHE_FRAGMENTS = 400_000  # emptied when full; a bound on memory, not on texts


LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?*#$%&")] = True  # none starts a contraction

# The normaliser and pre-tokenizer of the two supported kinds of file.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
LOWER_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPLITS = {
    "byte level": (None, BYTE_LEVEL),
    "lower-case words": (
        {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
        ]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": LOWER_WORDS}, "behavior": "Removed", "invert": True},
            BYTE_LEVEL | {"use_regex": False},
        ]},
    ),
}


def certain_cuts(data: np.ndarray) -> np.ndarray:
    """Marks bytes that start a fragment."""
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    at = np.flatnonzero(SPACE[data[1:]] & ~SPACE[data[:-1]]) + 1
    wide = at[data[at - 1] >= 0x80]
    tail = data[wide - 1]
    # U+0085 and U+00A0 end in these two bytes; all other white space has a lead byte E1, E2 or E3
    white = (data[wide - 2] == 0xC2) & ((tail == 0x85) | (tail == 0xA0))
    white |= np.isin(data[wide - 3], (0xE1, 0xE2, 0xE3))
    cut[at] = True
    cut[wide[white]] = False
    cut[1:] |= MARKS[data[1:]] & LETTER[data[:-1]]
    return cut


def _without_offsets(rule):
    """A rule of a tokenizer file without the setting that only moves offsets."""
    if isinstance(rule, dict):
        return {k: _without_offsets(v) for k, v in rule.items() if k != "trim_offsets"}
    return [_without_offsets(r) for r in rule] if isinstance(rule, list) else rule


def supported(spec: dict) -> str:
    """The kind of a tokenizers file, by name of ``SPLITS``; ValueError if its ids cannot be promised."""
    rules = _without_offsets(spec.get("normalizer")), _without_offsets(spec.get("pre_tokenizer"))
    kind = next((name for name, own in SPLITS.items() if own == rules), None)
    model = spec["model"]
    if kind is None or model.get("type", "BPE") != "BPE":
        raise ValueError("only byte-level BPE and lower-casing BPE with word ends are supported")
    suffix = "</w>" if kind == "lower-case words" else None
    if (model.get("end_of_word_suffix") or None) != suffix:
        raise ValueError("the end of a word is marked in another way than its kind of file does")
    for name in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback", "fuse_unk"):
        if model.get(name):
            raise ValueError(f"a model with {name} is not supported")
    for t in spec.get("added_tokens", []):
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or not t["content"]:
            raise ValueError(f"added token {t['content']!r} reaches beyond its own text")
        if t.get("normalized") and spec.get("normalizer") is not None:
            raise ValueError(f"added token {t['content']!r} is looked for in normalised text")
    return kind


def cuts_around(tokens: list[str], cuts: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """The same cuts but for those inside occurrences of added tokens."""
    torn = []
    for word in sorted({*tokens}):
        # letters before it, as a cut may look at bytes before the token
        own = np.frombuffer(b"aaa" + word.encode(), np.uint8)
        if cuts(own)[4:].any():
            torn.append(word.encode())
    if not torn:
        return cuts

    def cut(data: np.ndarray) -> np.ndarray:
        out, raw = cuts(data), data.tobytes()
        for word in torn:
            at = raw.find(word)
            while at >= 0:
                out[at + 1 : at + len(word)] = False
                at = raw.find(word, at + 1)
        return out

    return cut


def ranges(data: np.ndarray, bounds: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of fragments, and for each row bound the number of fragments before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    cut = cut.copy()
    cut[bounds[bounds < len(data)]] = True
    cut[0] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, bounds)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one fragment of each kind, and each fragment's kind."""
    held = same_as(hash_ranges(data, starts, ends))
    check = hash_ranges(data, starts, ends, 1)
    if (check != check[held]).any():  # a collision: compare the bytes themselves
        seen: dict[bytes, int] = {}
        held = np.array([seen.setdefault(data[s:e].tobytes(), k) for k, (s, e) in enumerate(zip(starts, ends))], np.int64)
    first = np.flatnonzero(held == np.arange(len(held)))
    number = np.zeros(len(held), np.int64)
    number[first] = np.arange(len(first))
    return first, number[held]


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate flat[begin[k] : begin[k] + size[k]] for each k of kind; bounds beside."""
    sizes = size[kind]
    bounds = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    at = np.repeat(begin[kind] - bounds[:-1], sizes)
    at += np.arange(bounds[-1])
    return flat[at], bounds


class FragmentEncoder:
    """Ids of whole texts by way of their distinct fragments.

    ``encode`` maps a list of fragments (bytes, valid UTF-8) to their ids, or to the bytes of an array of them.
    ``dtype`` holds any id.
    ``cut`` marks the certain cuts of a byte array.
    """

    def __init__(
        self,
        encode: Callable[[list[bytes]], list[Sequence[int] | bytes]],
        dtype: type = np.uint16,
        cut: Callable[[np.ndarray], np.ndarray] = certain_cuts,
    ):
        self.encode, self.dtype, self.cut = encode, np.dtype(dtype), cut
        self.known: dict[bytes, bytes] = {}

    def _ids(self, fragments: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE_FRAGMENTS:
            self.known.clear()
        got = [self.known.get(f) for f in fragments]
        missing = [f for f, g in zip(fragments, got) if g is None]
        if missing:
            new = {f: x if isinstance(x, bytes) else np.array(x, self.dtype).tobytes() for f, x in zip(missing, self.encode(missing))}
            got = [new[f] if g is None else g for f, g in zip(fragments, got)]
            self.known.update((f, x) for f, x in new.items() if len(f) <= 64)
        return got

    def _kinds(self, data, bounds):
        starts, ends, row_at = ranges(data, bounds, self.cut(data))
        first, kind = distinct(data, starts, ends)
        raw = data.tobytes()
        ids = self._ids([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        return ids, size, kind, row_at

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of ids of each row."""
        out = [np.zeros(0, np.int64)]
        for a, b in row_chunks(bounds):
            _, size, kind, row_at = self._kinds(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            total = np.zeros(len(kind) + 1, np.int64)
            np.cumsum(size[kind], out=total[1:])
            out.append(np.diff(total[row_at]))
        return np.concatenate(out)

    def rows(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a chunk of rows, bounds of the rows in them)."""
        for a, b in row_chunks(bounds):
            ids, size, kind, row_at = self._kinds(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            flat = np.frombuffer(b"".join(ids), self.dtype)
            begin = np.cumsum(size) - size
            got, at = gather(flat, begin, size, kind)
            yield a, got, at[row_at]


_held: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]):
    """One object per worker process and key."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def json_encoder(path: str) -> FragmentEncoder:
    """Encoder of a tokenizers file: the library encodes each distinct fragment.

    Special strings in texts are handled as the library's default does; nothing is added, truncated
    or padded. Files that ``supported`` doesn't know are refused.
    """
    return once(("json", path), lambda: _json_encoder(path))


def _json_encoder(path: str) -> FragmentEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    supported(spec)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    start = os.path.commonprefix(added).encode()  # where they have none in common each is looked for
    signs = [start] if start else [a.encode() for a in added]
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    words = tok.get_vocab(with_added_tokens=True)
    size = 1 + max(words.values())
    width = np.zeros(size, np.int64)  # bytes a token covers: one letter of the byte alphabet each
    for word, k in words.items():
        width[k] = len(word.removesuffix("</w>"))
    ends, kind = any(w.endswith("</w>") for w in words), id_type(size)

    def apart(fragments: list[bytes]) -> list[Sequence[int]]:
        texts = [f.decode() for f in fragments]
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(fragments: list[bytes]) -> list[bytes] | None:
        """One call for all; the ids are dealt out by the bytes they cover. None if that doesn't work out."""
        text = b"".join(fragments).decode()
        if ends:
            covered = [len(w.encode()) for w in tok.normalizer.normalize_str(text).split(" ")[1:]]
        else:
            covered = [len(f) for f in fragments]
        ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        at, want = np.cumsum(width[ids]), np.cumsum(covered)
        if len(want) != len(fragments) or not len(ids) or at[-1] != want[-1]:
            return None
        cut = np.searchsorted(at, want)
        if (at[cut] != want).any():
            return None
        raw, stop = ids.astype(kind).tobytes(), ((cut + 1) * kind().itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *stop], stop)]

    def encode(fragments: list[bytes]) -> list[Sequence[int] | bytes]:
        one = [k for k, f in enumerate(fragments) if SPACE[f[0]] and not SPACE[f[-1]] and not any(s in f for s in signs)]
        out: list[Sequence[int] | bytes] = [()] * len(fragments)
        for a in range(0, len(one), JOINED):
            own = [fragments[k] for k in one[a : a + JOINED]]
            for k, ids in zip(one[a : a + JOINED], joined(own) or apart(own)):
                out[k] = ids
        rest = sorted({*range(len(fragments))} - {*one})
        for k, ids in zip(rest, apart([fragments[k] for k in rest])):
            out[k] = ids
        return out

    return FragmentEncoder(encode, kind, cuts_around(added, certain_cuts))
