"""A wavelet matrix over token ids: bit-planes with rank and select, in one file whose planes are compressed in chunks, so that a query inflates only those it touches."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WVMX"
#: Bits between two stored counts of a plane, and bytes of a plane that are compressed together.
BLOCK, CHUNK = 4096, 1 << 15


class Plane:
    """The bits of a plane, eight a byte, in compressed chunks; a chunk is inflated when it is first read."""

    def __init__(self, chunks: list[bytes]) -> None:
        self.chunks, self.open = chunks, {}

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Bytes [lo, hi) of one block."""
        k = lo // CHUNK
        if k not in self.open:
            self.open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.chunks[k]), np.uint8) if k < len(self.chunks) else np.zeros(0, np.uint8)
        return self.open[k][lo - k * CHUNK : hi - k * CHUNK]

    def all(self) -> np.ndarray:
        one = zstandard.ZstdDecompressor()
        return np.frombuffer(b"".join(one.decompress(c) for c in self.chunks), np.uint8)

    @classmethod
    def packed(cls, bits: np.ndarray) -> Plane:
        one, body = zstandard.ZstdCompressor(level=1), bits.tobytes()
        return cls([one.compress(body[k : k + CHUNK]) for k in range(0, len(body), CHUNK)])


class WaveletMatrix:
    """A sequence of token ids that can be read at any place, counted and searched without unpacking it.

    The alphabet is the sorted distinct ids; the codes' bits, highest first, make the planes. Each plane orders what follows: zeros first, ones after, both stably.
    """

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[Plane], counts: list[np.ndarray], zeros: list[int]) -> None:
        self.n, self.alphabet, self.planes, self.counts, self.zeros = n, alphabet, planes, counts, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        present = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        present[ids] = True
        alphabet = np.flatnonzero(present[: len(present) if len(ids) else 0]).astype(np.uint32)
        codes = (np.cumsum(present) - 1).astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)[ids] if len(ids) else np.zeros(0, np.uint16)
        planes, counts, zeros = [], [], []
        for shift in range(max(0, len(alphabet) - 1).bit_length() - 1, -1, -1):
            ones = (codes >> codes.dtype.type(shift)) & codes.dtype.type(1) != 0
            packed = np.packbits(ones, bitorder="little")
            planes.append(Plane.packed(packed))
            counts.append(cls._count(packed))
            low = codes[~ones]
            zeros.append(len(low))
            codes = np.concatenate([low, codes[ones]])
        return cls(len(ids), alphabet, planes, counts, zeros)

    @staticmethod
    def _count(packed: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        return np.append(0, np.cumsum(ones)).astype(np.uint32)

    # ---- the file

    def to_bytes(self) -> bytes:
        """Header, alphabet, zeros and counts of each plane, lengths of all chunks, chunks."""
        head = MAGIC + struct.pack("<QII", self.n, len(self.alphabet), len(self.planes))
        chunks = [c for p in self.planes for c in p.chunks]
        body = [self.alphabet, np.array(self.zeros, np.uint64), *self.counts, np.array([len(c) for c in chunks], np.uint32)]
        return head + b"".join(x.tobytes() for x in body) + b"".join(chunks)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, n_alphabet, n_planes = struct.unpack_from("<QII", data, 4)
        at = 20

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        alphabet, zeros = take(np.uint32, n_alphabet), [int(z) for z in take(np.uint64, n_planes)]
        size = -(-n // 8)
        blocks, per = -(-size // (BLOCK // 8)) + 1, -(-size // CHUNK)
        counts = [take(np.uint32, blocks) for _ in range(n_planes)]
        lengths = take(np.uint32, n_planes * per).astype(np.int64)
        ends = at + np.cumsum(lengths)
        chunks = [data[z - k : z] for z, k in zip(ends.tolist(), lengths.tolist())]
        return cls(n, alphabet, [Plane(chunks[p * per : (p + 1) * per]) for p in range(n_planes)], counts, zeros)

    # ---- queries

    def _rank(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        bits = self.planes[plane].read(block * BLOCK // 8, -(-i // 8)).copy()
        if i % 8 and len(bits):
            bits[-1] &= (1 << i % 8) - 1
        return int(self.counts[plane][block]) + int(np.bitwise_count(bits).sum())

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        before = self.counts[plane].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[plane].read(block * BLOCK // 8, (block + 1) * BLOCK // 8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p, zeros in enumerate(self.zeros):
            bit = self.planes[p].read(i // 8, i // 8 + 1)[0] >> (i % 8) & 1
            ones = self._rank(p, i)
            code, i = code << 1 | int(bit), zeros + ones if bit else i - ones
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for p, zeros in enumerate(self.zeros):
            a, b = self._rank(p, lo), self._rank(p, hi)
            lo, hi = (zeros + a, zeros + b) if code >> (len(self.planes) - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token occurs in [lo, hi)."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._range(code, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Where the token occurs for the k-th time, from 0."""
        code = self._code(token)
        lo, hi = self._range(code, 0, self.n) if code is not None else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane tells where its zeros and ones came from."""
        codes = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for p in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[p].all(), count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(codes)
            up[~ones] = codes[: self.zeros[p]]
            up[ones] = codes[self.zeros[p] :] | codes.dtype.type(1 << (len(self.planes) - 1 - p))
            codes = up
        return self.alphabet[codes] if self.n else np.zeros(0, np.uint32)
