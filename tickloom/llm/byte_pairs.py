"""Byte-level BPE from a table of ranks, by a tree of joins: halves are encoded by themselves, and neighbours meet at a window around their border.

Encoding merges the pair of neighbours whose bytes have the lowest rank, the leftmost of equals, until none has any. Call two tokens sound next to each other
if their bytes, encoded alone, give just the two. Then:

* Neighbours in an encoding are sound: no merge crossed their border, so what became of their bytes is what becomes of them alone.
* A sequence whose neighbours are all sound is the encoding of its bytes: the first merge across a border would also happen in the two tokens' bytes alone.

So the encodings A and B of two halves are joined by encoding the last tokens of A and the first of B anew, together; if the result is sound next to what stays
of A and of B, all neighbours are, and what lies outside the window is proven stable. Else the window doubles on the side that is not. All joins of a level of all
trees of a batch are done at once, on arrays.

Texts are cut into pieces by a pattern first, and a piece that is a token is that token. Long texts are cut into segments, encoded in different tasks, and joined
in the same way: pieces that may look past the segment's end are cut anew, until a cut falls on one of the right segment's own; from there on both agree, as
the pattern never looks back. Decoding sets the bytes of tokens on end.
"""

from __future__ import annotations

import base64
import heapq
import sys
import types
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, steps, text_of, tidy, utf8
from .token_store import ENCODE_BYTES, Encoder

#: Bytes of a tree's leaf; tokens of a window on either side at first; bytes up to which sequences are merged on arrays, all at once.
LEAF, WINDOW, ON_ARRAYS = 16, 2, 64
#: Bytes of a segment; longer texts are encoded by segments.
SEGMENT = 1 << 20
#: Fixed value: the split pattern whose sure cuts are known (token_store.pieces).
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 30


class Vocabulary:
    """Tokens by rank, and which pairs of them make which token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        if any(bytes([k]) not in self.ranks for k in range(256)):
            raise ValueError("the ranks lack single bytes")
        self.longest = max(map(len, self.ranks))
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.body = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        made = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    made[a << 32 | b] = rank
        keys = np.fromiter(made.keys(), np.int64, len(made))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(made.values(), np.int64, len(made))[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of what pairs make, _NONE where they make nothing."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        return self.body[np.repeat(self.starts[ids], size) + ragged(size)]

    # ---- merging, for short sequences

    def merged(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The encodings of byte sequences that stand on end, none of them empty, and how many tokens each has."""
        number = np.repeat(np.arange(len(lengths)), lengths)
        far = lengths > ON_ARRAYS
        done = [(number[:0], self.single[:0])]
        for k in np.flatnonzero(far):
            at = int(lengths[:k].sum())
            ids = self._merged_long(raw[at : at + lengths[k]])
            done.append((np.full(len(ids), k), ids))
        near = ~far[number]
        where, ids = number[near], self.single[raw[near]]
        rank = np.full(len(ids), _NONE)
        inside = np.flatnonzero(where[1:] == where[:-1])
        rank[inside] = self.rank(ids[inside], ids[inside + 1])
        while len(ids):
            starts = np.flatnonzero(np.diff(where, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            live = best >> 32 < _NONE
            keep = np.repeat(live, np.diff(np.append(starts, len(ids))))
            done.append((where[~keep], ids[~keep]))
            at = best[live] & 0xFFFFFFFF
            ids[at] = best[live] >> 32
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            where, ids, rank = where[keep], ids[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                pair = np.minimum(left + 1, len(ids) - 1)
                rank[left] = np.where((pair > left) & (where[pair] == where[left]), self.rank(ids[left], ids[pair]), _NONE)
        where, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(where, kind="stable")], np.bincount(where, minlength=len(lengths))

    def _merged_long(self, raw: np.ndarray) -> np.ndarray:
        """The same for one sequence, with a heap of its pairs."""
        ids = self.single[raw].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = lambda k: self.ranks.get(self.tokens[ids[k]] + self.tokens[ids[after[k]]], _NONE) if after[k] < len(ids) else _NONE
        heap = [(r, k) for k in range(len(ids)) if (r := rank(k)) < _NONE]
        heapq.heapify(heap)
        gone = bytearray(len(ids))
        while heap:
            r, k = heapq.heappop(heap)
            if gone[k] or rank(k) != r:
                continue
            ids[k], gone[after[k]] = r, 1
            after[k] = after[after[k]]
            if after[k] < len(ids):
                before[after[k]] = k
            for left in (k, before[k]):
                if left >= 0 and (r := rank(left)) < _NONE:
                    heapq.heappush(heap, (r, left))
        return np.array([i for i, g in zip(ids, gone) if not g], np.int64)

    # ---- the tree

    def sound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether these tokens are sound next to each other."""
        both, back = np.unique(a << 32 | b, return_inverse=True)
        a, b = both >> 32, both & 0xFFFFFFFF
        ids, n = self.merged(self.bytes_of(np.stack([a, b], 1).ravel()), self.sizes[a] + self.sizes[b])
        at = np.cumsum(n) - n
        return ((n == 2) & (ids[at] == a) & (ids[np.minimum(at + 1, len(ids) - 1)] == b))[back]

    def joined(self, ids: np.ndarray, n: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins encodings (so many tokens each, on end) with the next ones; pair: the numbers of the left ones."""
        border = np.cumsum(n)[pair]
        have = np.stack([n[pair], n[pair + 1]])
        wide = np.minimum(have, WINDOW)
        made: list = [None] * len(pair)
        left = np.arange(len(pair))
        while len(left):
            lo, hi = border[left] - wide[0, left], border[left] + wide[1, left]
            old = ids[np.repeat(lo, hi - lo) + ragged(hi - lo)]
            size = np.add.reduceat(self.sizes[old], np.cumsum(hi - lo) - (hi - lo))
            new, count = self.merged(self.bytes_of(old), size)
            end = np.cumsum(count)
            first, last = new[end - count], new[end - 1]
            fits = np.stack([(wide[0, left] == have[0, left]) | (ids[lo] == first), (wide[1, left] == have[1, left]) | (ids[hi - 1] == last)])
            for side, (a, b) in enumerate(((ids[np.maximum(lo - 1, 0)], first), (last, ids[np.minimum(hi, len(ids) - 1)]))):
                ask = np.flatnonzero(~fits[side])
                if len(ask):
                    fits[side, ask] = self.sound(a[ask], b[ask])
            for k in np.flatnonzero(fits.all(0)):
                made[left[k]] = new[end[k] - count[k] : end[k]]
            for side in (0, 1):
                grow = left[~fits[side]]
                wide[side, grow] = np.minimum(2 * wide[side, grow], have[side, grow])
            left = left[~fits.all(0)]
        size = np.array([len(m) for m in made])
        keep = np.ones(len(ids), bool)
        keep[np.repeat(border - wide[0], wide.sum(0)) + ragged(wide.sum(0))] = False
        place = np.append(0, np.cumsum(keep))[border - wide[0]]
        out = n.copy()
        out[pair] = have.sum(0) - wide.sum(0) + size
        single = np.ones(len(n), bool)
        single[pair + 1] = False
        return np.insert(ids[keep], np.repeat(place, size), np.concatenate(made)), out[single]

    def encoded(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The encodings of byte strings that are not empty, by merges alone."""
        if not pieces:
            return []
        raw, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        depth = np.ceil(np.log2(np.maximum(size / LEAF, 1))).astype(np.int64)
        parts = 1 << depth
        piece, k = np.repeat(np.arange(len(size)), parts), ragged(parts)
        lengths = (size[piece] * (k + 1) >> depth[piece]) - (size[piece] * k >> depth[piece])
        ids, n = self.merged(raw, lengths)
        while depth.any():
            pair = np.flatnonzero(np.repeat(depth > 0, parts))[::2]
            ids, n = self.joined(ids, n, pair)
            parts = np.where(depth > 0, parts >> 1, parts)
            depth = np.maximum(depth - 1, 0)
        return np.split(ids, np.cumsum(n)[:-1])


class Library:
    """Encodes texts: pieces by the pattern, each piece by the tree."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.words, self.pattern = Vocabulary(path), regex.compile(pattern)

    def ids_of(self, pieces: list[str]) -> list[np.ndarray]:
        """Of each piece the ids; one that is a token is that token."""
        known = {p: p.encode() for p in pieces}
        made = {p: np.array([r]) for p, b in known.items() if (r := self.words.ranks.get(b)) is not None}
        rest = [p for p in known if p not in made]
        made |= zip(rest, self.words.encoded([known[p] for p in rest]))
        return [made[p] for p in pieces]

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[SimpleNamespace]:
        split = [self.pattern.findall(t) for t in texts]
        found = iter(self.ids_of([p for s in split for p in s]))
        return [SimpleNamespace(ids=[i for _ in s for i in next(found).tolist()]) for s in split]

    def encode(self, text: str, add_special_tokens: bool = False) -> SimpleNamespace:
        return self.encode_batch_fast([text])[0]

    # ---- segments of one text

    def segment(self, text: str) -> tuple[str, np.ndarray, list[np.ndarray]]:
        """The text, where its pieces end, and their ids."""
        pieces = self.pattern.findall(text)
        return text, np.cumsum([len(p) for p in pieces], dtype=np.int64), self.ids_of(pieces)

    def join(self, a: tuple, b: tuple) -> tuple:
        """The segment of both texts. Pieces of the left one that end with it, or begin in its last two characters, may look further: they are cut anew."""
        (left, ends, ids), (right, others, more) = a, b
        if not len(left) or not len(right):
            return a if len(left) else b
        begins = np.append(0, ends[:-1])
        open_ = min(len(ends) - 1, int(np.searchsorted(begins, len(left) - 2)))
        at, m = int(begins[open_]), 1
        tail = left[at:]
        while True:
            m = min(m, len(others))
            text = tail + right[: int(others[m - 1])]
            pieces = self.pattern.findall(text)
            cut = np.cumsum([len(p) for p in pieces], dtype=np.int64)
            sure = len(cut) if m == len(others) else min(len(cut) - 1, int(np.searchsorted(np.append(0, cut[:-1]), len(text) - 2)))
            meet = np.flatnonzero(np.isin(cut[:sure] - len(tail), np.append(0, others)))
            if len(meet):
                break
            m *= 2
        new = pieces[: int(meet[0]) + 1]
        skip = int(np.searchsorted(others, cut[meet[0]] - len(tail), "right"))
        over, rest = len(ids) - open_, ids[:open_]
        if len(new) == 1 and over == 1 and skip == 1 and min(len(tail), int(others[0])) > self.words.longest:  # one long piece runs on: its halves are encoded
            made = [self.words.joined(np.concatenate([ids[-1], more[0]]), np.array([len(ids[-1]), len(more[0])]), np.array([0]))[0]]
        else:
            made = self.ids_of(new)
        return left + right, np.concatenate([ends[:open_], at + cut[: len(new)], len(left) + others[skip:]]), rest + made + more[skip:]


class TreeEncoder(Encoder):
    """The memory of pieces between sure cuts, with the tree in place of the library."""

    def __init__(self, path: str, pattern: str) -> None:
        self.library, self.model, self.special = Library(path, pattern), None, []
        self.by_piece = pattern == USUAL
        self.dtype = np.uint16 if len(self.library.words.tokens) <= 1 << 16 else np.uint32
        self.forget()

    def _learn(self, raw: np.ndarray, eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, letters: np.ndarray) -> None:
        super()._learn(raw, eight, starts, sizes, hashes, np.zeros_like(letters))  # no piece is a plain word to the library


def _encoder(path: str, pattern: str) -> TreeEncoder:
    """One encoder a Python worker."""
    held = sys.modules.setdefault("_byte_pair_encoders", types.ModuleType("_byte_pair_encoders"))
    key = f"{path}\0{pattern}"
    if key not in vars(held):
        setattr(held, key, TreeEncoder(path, pattern))
    return getattr(held, key)


def _packed(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """The ids of each text as little-endian 32-bit numbers."""
    at = np.append(0, np.cumsum(n)) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())


def _short(path: str, pattern: str) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in steps(utf8(texts)[1], ENCODE_BYTES):
                ids, n = encoder.encode(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), _packed(ids, n)], ["doc_id", "n_tokens", "ids"])

    return run


def _cut(size: int) -> Callable:
    """Rows of one segment each; a character is never cut."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                body, at, number = batch.column("text")[k].as_py().encode(), 0, 0
                while at < len(body):
                    end = min(at + size, len(body))
                    while end < len(body) and body[end] & 0xC0 == 0x80:
                        end += 1
                    yield pa.RecordBatch.from_arrays([batch.column("uid").slice(k, 1), batch.column("doc_id").slice(k, 1), pa.array([number], pa.int32()), pa.array([body[at:end].decode()])], ["uid", "doc_id", "number", "text"])
                    at, number = end, number + 1

    return run


def _leaves(path: str, pattern: str) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _encoder(path, pattern).library
        for batch in batches:
            for k in range(batch.num_rows):
                _, ends, ids = library.segment(batch.column("text")[k].as_py())
                flat = np.concatenate(ids)
                made = [pa.array([x.tobytes()], pa.binary()) for x in (ends, np.array([len(i) for i in ids], np.int64), flat)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in ("uid", "doc_id", "number", "text")], *made], ["uid", "doc_id", "number", "text", "ends", "counts", "ids"])

    return run


def _tree(path: str, pattern: str) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        """All segments of a text, joined two by two. Repeated rows bring their segments again."""
        library = _encoder(path, pattern).library
        rows = rows.sort_by("number")
        number = rows.column("number").to_numpy()
        copies = int((number == 0).sum())
        level = []
        for k in range(0, len(number), copies):
            ends, counts, ids = (np.frombuffer(rows.column(c)[k].as_py(), np.int64) for c in ("ends", "counts", "ids"))
            level.append((rows.column("text")[k].as_py(), ends, np.split(ids, np.cumsum(counts)[:-1])))
        while len(level) > 1:
            level = [library.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        ids = np.concatenate(level[0][2])
        return pa.table({"doc_id": rows.column("doc_id").slice(0, copies), "n_tokens": pa.array([len(ids)] * copies, pa.int64()), "ids": pa.array([ids.astype("<u4").tobytes()] * copies, pa.binary())})

    return run


def encode(docs: DataFrame, ranks: str, pattern: str = USUAL, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian 32-bit numbers), as encoding by ranks gives them, without special tokens.

    A null or empty text has no ids. Rows that repeat come as often as they do; null identifiers stay null. An empty table gives an empty result. Other columns are
    not read. ranks: the path of a file of base64 tokens and ranks, the same on all executors. Texts of more than segment bytes are cut into segments, which
    tasks share; only what a text's ids are, is then gathered by text.
    """
    schema = "doc_id long, n_tokens long, ids binary"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    short = rows.filter(F.octet_length("text") <= segment).mapInArrow(_short(ranks, pattern), schema)
    long = rows.filter(F.octet_length("text") > segment).select(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text")).alias("uid"), "doc_id", "text")
    cut = long.mapInArrow(_cut(segment), "uid string, doc_id long, number int, text string").repartition("uid", "number")
    leaves = cut.mapInArrow(_leaves(ranks, pattern), "uid string, doc_id long, number int, text string, ends binary, counts binary, ids binary")
    return short.unionByName(leaves.groupBy("uid").applyInArrow(_tree(ranks, pattern), schema))


def _decoder(path: str) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _encoder(path, USUAL).library.words
        for batch in batches:
            ids = batch.column("ids")
            for lo, hi in steps(np.append(0, np.cumsum([len(i.as_buffer()) if i.is_valid else 0 for i in ids])), ENCODE_BYTES):
                got = [np.frombuffer(i.as_buffer(), "<u4").astype(np.int64) if i.is_valid else np.zeros(0, np.int64) for i in ids.slice(lo, hi - lo)]
                flat = np.concatenate(got)
                if len(flat) and (flat.max() >= len(words.sizes) or not words.sizes[flat].all()):
                    raise ValueError("ids that are no tokens")
                end = np.append(0, np.cumsum(words.sizes[flat]))[np.append(0, np.cumsum([len(g) for g in got]))]
                body = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(end.astype(np.int64).tobytes()), pa.py_buffer(words.bytes_of(flat).tobytes())]).cast(pa.binary())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, body], [*part.schema.names, "decoded"])

    return run


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """tokens (with ids as encode() writes them) and decoded: their bytes, on end. Null ids are none; ids that are no tokens are an error."""
    return tokens.mapInArrow(_decoder(ranks), ", ".join(f"`{n}` {t}" for n, t in tokens.dtypes) + ", decoded binary")
