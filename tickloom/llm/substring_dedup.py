"""Substring dedup with difference-cover anchors.

Two equal windows of WINDOW words, wherever they start, have a short window (an anchor) in common that starts at a cover position modulo
PERIOD in both documents, as every difference modulo the period is one of two cover positions. So only anchors at cover positions
are hashed and compared over the corpus. Where an anchor occurs twice, it is extended to all whole windows around it; these are
compared by a 96-bit digest of their words, and all occurrences but the earliest go, once their words have been compared with those of the earliest.

Both comparisons work on packed rows: each batch of documents sends one row a bucket, with one entry for each hash that it holds. What repeats inside a
batch is settled there, so a passage that a third of all documents share meets as one entry a batch.

Words are compared inside a batch where they lie, and between batches by sending each removed passage, in pieces, to the document that it repeats.
Should a digest stand for different words, its windows are told apart by the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, mix, packed, partitions, slices, stage, steps, text_of, tidy, unpacked, utf8, words
from .exact_dedup import passing

#: A window of 20 words has 13 places for an anchor of 8 words; the cover is a perfect difference set modulo 13.
WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
_SEEDS = (21, 22)
_HASH = "hashes binary, ids binary, ords binary, counts binary, at binary, leads binary, lead_at binary"
_POSITIONS = "id long, ord long, at binary, leads binary, lead_at binary"
#: Windows of a passage that are sent in one piece, by the place of the first in the earlier document.
PIECE = 128
#: Bytes of text that are one batch of its own to anchors and windows; what these take is some ten to twenty times as much.
BATCH_BYTES = 4 << 20
#: In place of the earlier occurrence's position: the words have been compared already.
_COMPARED = (1 << 32) - 1


def _by_document(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by bucket and row: where each document's part begins, its length, and how many parts each bucket has."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(row))), bucket[at]


def _sent(bucket: np.ndarray, hashes: np.ndarray | None, ids: np.ndarray, ords: np.ndarray, row: np.ndarray, at: np.ndarray, leads: np.ndarray | None = None, lead_at: np.ndarray | None = None) -> pa.RecordBatch:
    """One packed row a bucket; entries are sorted by bucket and row. Entries without hashes are settled and only pass through, with the place that they repeat."""
    begin, length, of = _by_document(row, bucket)
    names, n_docs = np.unique(of, return_counts=True)
    _, n = np.unique(bucket, return_counts=True)
    maybe = lambda values, kind: pa.nulls(len(names), pa.binary()) if values is None else packed(values.astype(kind), n)
    columns = [
        pa.array(names.astype(np.int64)), pa.nulls(len(names), pa.binary()) if hashes is None else packed(hashes, n),
        packed(ids[row[begin]], n_docs), packed(ords[row[begin]], n_docs), packed(length.astype(np.uint32), n_docs), packed(at.astype(np.uint32), n), maybe(leads, np.int64), maybe(lead_at, np.uint32),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "hashes", "ids", "ords", "counts", "at", "leads", "lead_at"])


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _entries(batch: pa.RecordBatch, kind: object) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, identifier, order, position, and the place repeated, of each entry of packed rows that all have hashes, or all have none."""
    hashes = unpacked(batch.column("hashes"), kind)[0] if not batch.column("hashes").null_count else None
    ids, ords, counts, at = (unpacked(batch.column(c), k)[0] for c, k in (("ids", np.int64), ("ords", np.int64), ("counts", np.uint32), ("at", np.uint32)))
    none = batch.column("leads").null_count == batch.num_rows
    leads, lead_at = (np.zeros(len(at), np.int64), np.full(len(at), _COMPARED, np.uint32)) if none else (unpacked(batch.column(c), k)[0] for c, k in (("leads", np.int64), ("lead_at", np.uint32)))
    return hashes, np.repeat(ids, counts), np.repeat(ords, counts), at, leads, lead_at


def _addressed(ids: np.ndarray, ords: np.ndarray, at: np.ndarray, leads: np.ndarray, lead_at: np.ndarray, n: int) -> pa.RecordBatch:
    """Positions on their way to their documents: one packed row for each bucket of identifiers, not one a document."""
    bucket = _bucket(mix(ids.view(np.uint64)), n)
    order = np.lexsort((ords, ids, bucket))
    row = np.cumsum(np.append(False, (ids[order[1:]] != ids[order[:-1]]) | (ords[order[1:]] != ords[order[:-1]])))
    first = order[np.append(True, row[1:] != row[:-1])]
    return _sent(bucket[order], None, ids[first], ords[first], row, at[order], leads[order], lead_at[order])


def _again(hashes: np.ndarray) -> np.ndarray:
    """The entries whose first bytes of the hash, eight at most, another entry has too."""
    size = min(8, hashes.dtype.itemsize)
    key = np.zeros((len(hashes), 8), np.uint8)
    key[:, :size] = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)[:, :size]
    key = key.view(np.uint64).ravel()
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return np.sort(order[np.append(False, same)[: len(order)] | np.append(same, False)[: len(order)]])


def _settle(kind: object, judge: Callable, n: int) -> Callable:
    """Of one bucket: the positions that judge picks from all entries with hashes, with the places that they repeat, and those that were settled before."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, settled = [], []
        for batch in batches:
            null = np.asarray(batch.column("hashes").is_null())
            for part in (batch.filter(pa.array(null)), batch.filter(pa.array(~null))):
                if part.num_rows:
                    hashes, *rest = _entries(part, kind)
                    if hashes is None:
                        settled.append(rest)
                    else:
                        found.append((hashes, *rest[:3]))
        if found:
            hashes, *places = (np.concatenate(x) for x in zip(*found))
            found.clear()
            again = _again(hashes)  # most stand alone, and are let go before anything is sorted by more than a hash
            hashes, (ids, ords, at) = hashes[again], (x[again] for x in places)
            places = again = None
            if len(hashes):
                picked, lead = judge(hashes, ids, ords, at)
                settled.append([ids[picked], ords[picked], at[picked], ids[lead], at[lead]])
        if settled:
            columns = [np.concatenate(x) for x in zip(*settled)]
            settled.clear()
            if len(columns[0]):
                yield _addressed(*columns, n)

    return run


@tidy
def _by_identifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket of identifiers: a row a document with all its positions."""
    found = [_entries(batch, None)[1:] for batch in batches]
    if found:
        ids, ords, at, leads, lead_at = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((at, ords, ids))
        ids, ords = ids[order], ords[order]
        begin = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (ords[1:] != ords[:-1])))
        n = np.diff(np.append(begin, len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[begin]), pa.array(ords[begin]), *(packed(x[order], n) for x in (at, leads, lead_at))], ["id", "ord", "at", "leads", "lead_at"])


# ---------------------------------------------------------------- anchors

_SIX = np.dtype((np.void, 6))


def _anchors(n_buckets: int, width: int, period: int, cover: tuple[int, ...]) -> Callable:
    size = width - period + 1
    covered = np.zeros(period, bool)
    covered[list(cover)] = True

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(_SEEDS[0])
        for batch in slices(batches, most=BATCH_BYTES):
            ids, ords = batch.column("id").to_numpy(), batch.column("ord").to_numpy()
            raw_all, offsets_all = utf8(batch.column("text"))
            hs, rows, ats = [], [], []
            for lo, hi in steps(offsets_all):
                starts, ends, first = words(raw := raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo])
                n = np.diff(first)
                row = np.repeat(np.arange(hi - lo), n)
                at = np.arange(len(starts)) - first[row]
                anchor = np.flatnonzero(covered[at % period] & (at + size <= n[row]) & (n[row] >= width))
                hs.append(hasher.window(hasher.word(raw, starts, ends), anchor, size))
                rows.append((row[anchor] + lo).astype(np.int32))
                ats.append(at[anchor].astype(np.uint32))
            h, row, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hs, rows, ats))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            new = np.append(True, h[order[1:]] != h[order[:-1]])
            group = np.cumsum(new) - 1
            again = np.bincount(group)[group] > 1
            one = np.sort(order[new])
            bucket = _bucket(h[one], n_buckets)
            one = one[np.argsort(bucket, kind="stable")]
            six = np.ascontiguousarray(h[one].view(np.uint8).reshape(-1, 8)[:, :6]).view(_SIX).ravel()
            yield _sent(_bucket(h[one], n_buckets), six, ids, ords, row[one], at[one])
            own = np.sort(order[again])
            if len(own):
                yield _sent(np.full(len(own), int(h[0] % np.uint64(n_buckets))), None, ids, ords, row[own], at[own])

    return run


def _twice(six: np.ndarray, ids: np.ndarray, ords: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.zeros((len(six), 8), np.uint8)
    h[:, :6] = six.view(np.uint8).reshape(-1, 6)
    h = h.view(np.uint64).ravel()
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = order[np.append(False, same) | np.append(same, False)]
    return twice, twice


# ---------------------------------------------------------------- windows

_TWELVE = np.dtype([("a", "<u8"), ("b", "<u4")])


def _window_places(first: np.ndarray, n: np.ndarray, row: np.ndarray, pos: np.ndarray, width: int, period: int) -> np.ndarray:
    """Where a window starts that lies around one of the anchors at word pos of its row, as numbers of words over all rows."""
    open_, shut = np.maximum(pos - period + 1, 0), np.minimum(pos, n[row] - width)
    fits = open_ <= shut
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(edge, (first[row] + open_)[fits], 1)
    np.add.at(edge, (first[row] + shut + 1)[fits], -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def _digests(hashers: list[Hasher], raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    d = np.zeros(len(at), _TWELVE)
    d["a"], d["b"] = (h.window(h.word(raw, starts, ends), at, width).astype(t) for h, t in zip(hashers, ("<u8", "<u4")))
    return d


def _alike(a: list[bytes], b: list[bytes], width: int) -> np.ndarray:
    """Of two equally long runs of words, which of the windows are equal."""
    differ = np.append(0, np.cumsum([x != y for x, y in zip(a, b)]))
    return differ[width:] == differ[:-width]


def _equal(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the windows at words a and b are the same words, run by run of windows that go on side by side."""
    order = np.lexsort((a, b - a))
    x, y = a[order], b[order]
    begin = np.flatnonzero(np.append(True, (np.diff(x) != 1) | (np.diff(y) != 1))[: len(a)])
    out = np.ones(len(a), bool)
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(a)]):
        p, q, more = x[lo], y[lo], hi - lo + width - 2
        one, other = raw[starts[p] : ends[p + more]].tobytes(), raw[starts[q] : ends[q + more]].tobytes()
        if one != other:
            out[order[lo:hi]] = _alike(one.split(), other.split(), width)
    return out


def _windows(n_buckets: int, width: int, period: int) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [Hasher(s) for s in _SEEDS]
        for batch in slices(batches, most=BATCH_BYTES):
            ids, ords = batch.column("id").to_numpy(), batch.column("ord").to_numpy()
            raw_all, offsets_all = utf8(batch.column("text"))
            ds, rows, ats, places, starts_all, ends_all, seen = [], [], [], [], [], [], 0
            for lo, hi in steps(offsets_all):
                starts, ends, first = words(raw := raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo])
                n = np.diff(first)
                pos, per = unpacked(batch.column("anchors").slice(lo, hi - lo), np.uint32)
                at = _window_places(first, n, np.repeat(np.arange(hi - lo), per), pos.astype(np.int64), width, period)
                ds.append(_digests(hashers, raw, starts, ends, at, width))
                row = np.searchsorted(first, at, "right") - 1
                rows.append((row + lo).astype(np.int32))
                ats.append((at - first[row]).astype(np.uint32))
                places.append(at + seen)
                starts_all.append((starts + offsets_all[lo]).astype(np.int32))
                ends_all.append((ends + offsets_all[lo]).astype(np.int32))
                seen += len(starts)
            if not ds or not sum(map(len, ds)):
                continue
            d, row, at, place, starts, ends = (np.concatenate(x) for x in (ds, rows, ats, places, starts_all, ends_all))
            later, lead = _later(d, ids[row], ords[row], at)
            later = later[_equal(raw_all, starts, ends, place[later], place[lead], width)]
            mine = np.ones(len(d), bool)
            mine[later] = False
            one = np.flatnonzero(mine)
            one = one[np.argsort(_bucket(d["a"][one], n_buckets), kind="stable")]
            yield _sent(_bucket(d["a"][one], n_buckets), d[one], ids, ords, row[one], at[one])
            own = np.sort(later)
            if len(own):
                yield _sent(np.full(len(own), int(d["a"][0] % np.uint64(n_buckets))), None, ids, ords, row[own], at[own])

    return run


def _later(d: np.ndarray, ids: np.ndarray, ords: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows whose words also start earlier, and the earliest with these words."""
    order = np.lexsort((at, ids, ords, d["b"], d["a"]))
    a, b = d["a"][order], d["b"][order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (ords[order] != ords[lead]) | (ids[order] != ids[lead]) | (at[order] != at[lead])
    return order[later], lead[later]


# ---------------------------------------------------------------- what goes, and the comparison of its words

_SENT = pa.list_(pa.struct([("lead", pa.int64()), ("piece", pa.int32()), ("skip", pa.int32()), ("body", pa.binary())]))


def _passages(own: list[bytes], at: np.ndarray, leads: np.ndarray, lead_at: np.ndarray, width: int) -> list[dict]:
    """The passages that repeat another document's, in pieces: whose, the piece of it, the words of it to skip, the words."""
    far = lead_at != _COMPARED
    at, leads, lead_at = at[far].astype(np.int64), leads[far], lead_at[far].astype(np.int64)
    new = np.append(True, (np.diff(at) != 1) | (np.diff(lead_at) != 1) | (leads[1:] != leads[:-1]) | (lead_at[1:] % PIECE == 0))[: len(at)]
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    return [
        {"lead": lead, "piece": q // PIECE, "skip": q % PIECE, "body": b" ".join(own[p : p + k + width - 1])}
        for p, lead, q, k in zip(at[begin].tolist(), leads[begin].tolist(), lead_at[begin].tolist(), n.tolist())
    ]


def _kept(width: int, with_starts: bool, digest: bool) -> Callable:
    """Without the windows at starts; add and drop, where given, correct these. The passages that have to be compared come along."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept, passages = [], [], [], []
            column = lambda name: batch.column(name).to_pylist() if name in batch.schema.names else [None] * batch.num_rows
            for text, at, leads, lead_at, add, drop in zip(batch.column("text"), *(column(c) for c in ("at", "leads", "lead_at", "add", "drop"))):
                own = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()  # at \x20 and \x09-\x0d
                n_words.append(len(own))
                sent = []
                if at or add:
                    at = np.frombuffer(at or b"", np.uint32)
                    if add is None and drop is None:
                        sent = _passages(own, at, np.frombuffer(leads, np.int64), np.frombuffer(lead_at, np.uint32), width)
                    at = np.union1d(np.setdiff1d(at, drop or []), add or []).astype(np.int64)
                    edge = np.zeros(len(own) + width + 1, np.int32)
                    edge[at] += 1
                    edge[at + width] -= 1
                    stay = np.cumsum(edge)[: len(own)] == 0
                    own = [w for w, s in zip(own, stay.tolist()) if s]
                passages.append(sent)
                n_removed.append(n_words[-1] - len(own))
                left = b" ".join(own)
                kept.append(hashlib.sha256(left).hexdigest().encode() if digest else left)
            columns = [batch.column("id"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            names = ["id", "doc_id", "n_words", "n_removed", "kept"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(passages, _SENT)] if with_starts else columns, [*names, "passages"] if with_starts else names)

    return run


def _pieces(width: int) -> Callable:
    """The words of a document in pieces that hold all windows which start there."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, number, body = [], [], []
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                own = text.as_buffer().to_pybytes().split()
                for k in range(-(-max(0, len(own) - width + 1) // PIECE)):
                    ids.append(ident)
                    number.append(k)
                    body.append(b" ".join(own[k * PIECE : (k + 1) * PIECE + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(body, pa.binary())], ["lead", "piece", "there"])

    return run


def _differing(width: int) -> Callable:
    """The digests of the windows whose words are not those of the window that they were taken to repeat."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [Hasher(s) for s in _SEEDS]
        for batch in batches:
            found = [np.zeros(0, _TWELVE)]
            for skip, body, there in zip(batch.column("skip").to_pylist(), batch.column("body").to_pylist(), batch.column("there").to_pylist()):
                own = body.split(b" ")
                other = (there or b"").split(b" ")[skip : skip + len(own)]
                if own != other:
                    wrong = np.flatnonzero(~_alike(own, other + [b""] * (len(own) - len(other)), width))
                    raw = np.frombuffer(body, np.uint8)
                    starts, ends, _ = words(raw, np.array([0, len(raw)]))
                    found.append(_digests(hashers, raw, starts, ends, wrong, width))
            d = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(d["a"].view(np.int64)), pa.array(d["b"].astype(np.int64))], ["a", "b"])

    return run


def _spelled(width: int, period: int) -> Callable:
    """A row for each window: its digest, place and words."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [Hasher(s) for s in _SEEDS]
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                raw, offsets = utf8(one.column("text"))
                starts, ends, first = words(raw, offsets)
                pos = unpacked(one.column("anchors"), np.uint32)[0].astype(np.int64)
                at = _window_places(first, np.diff(first), np.zeros(len(pos), np.int64), pos, width, period)
                d, own = _digests(hashers, raw, starts, ends, at, width), raw.tobytes().split()
                fixed = [pa.array(np.full(len(at), one.column(c)[0].as_py(), np.int64)) for c in ("id", "ord")]
                body = pa.array([b" ".join(own[p : p + width]) for p in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(d["a"].view(np.int64)), pa.array(d["b"].astype(np.int64)), *fixed, pa.array(at.astype(np.int32)), body], ["a", "b", "id", "ord", "at", "body"])

    return run


def _corrections(suspects: DataFrame, wrong: DataFrame) -> DataFrame:
    """(id, ord, drop, add): the windows whose digest stands for different words, and those of them whose words do start earlier."""
    spelled = suspects.select("id", "ord", "text", "anchors").mapInArrow(_spelled(WINDOW, PERIOD), "a long, b long, id long, ord long, at int, body binary").join(wrong, ["a", "b"], "left_semi")
    spelled, place = stage(spelled, "substring-spelled"), F.struct("ord", "id", "at")
    leads = spelled.groupBy("body").agg(F.min(place).alias("lead"))
    later = F.when(place > F.col("lead"), F.col("at"))
    return spelled.join(leads, "body").groupBy("id", "ord").agg(F.collect_set("at").alias("drop"), F.collect_set(later).alias("add"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, one space between; with digest, their SHA-256 in hex).

    A word goes if a window of WINDOW words over it also starts earlier: in a document of smaller identifier, or earlier in one of the same
    identifier. Identifiers are whole numbers; null comes after all others. Rows alike in identifier and text count as one document and lose the
    same words; other texts of one identifier come in an order of their own. Null, empty and short texts lose nothing. An empty table gives an empty
    result. Other columns are not read.
    """
    n = partitions(docs.sparkSession)
    text, ident = text_of(text_col), F.col(id_col).cast("long")
    rows = docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit((1 << 63) - 1)).alias("ord"), text.alias("text"), F.xxhash64(ident, text).alias("id"))
    packed_row, key = "bucket long, " + _HASH, ["id", "ord"]
    home = lambda df: df.repartitionById(n, F.col("bucket").cast("int"))
    anchors = rows.select("id", "ord", "text").mapInArrow(_anchors(n, WINDOW, PERIOD, COVER), packed_row)
    twice = home(home(anchors).mapInArrow(_settle(_SIX, _twice, n), packed_row)).mapInArrow(_by_identifier, _POSITIONS)
    twice = stage(twice.select("id", "ord", F.col("at").alias("anchors")), "substring-twice")
    suspects = stage(passing(rows, twice, "id").join(twice, key), "substring-suspects")
    windows = suspects.select("id", "ord", "text", "anchors").mapInArrow(_windows(n, WINDOW, PERIOD), packed_row)
    later = stage(home(home(windows).mapInArrow(_settle(_TWELVE, _later, n), packed_row)).mapInArrow(_by_identifier, _POSITIONS), "substring-later")
    schema = "id long, doc_id long, n_words long, n_removed long, kept string"
    found = suspects.select("id", "ord", "doc_id", "text").join(later, key, "left")
    sent = ", passages array<struct<lead:long,piece:int,skip:int,body:binary>>"
    cut = stage(found.select("id", "doc_id", "text", "at", "leads", "lead_at").mapInArrow(_kept(WINDOW, True, digest), schema + sent), "substring-cut")
    passages = cut.select(F.explode("passages").alias("p")).select("p.*")
    leads = stage(passages.select(F.col("lead").alias("id")).distinct(), "substring-leads")
    there = stage(passing(suspects.select("id", "text"), leads, "id").mapInArrow(_pieces(WINDOW), "lead long, piece int, there binary").dropDuplicates(["lead", "piece"]), "substring-pieces")
    wrong = passages.join(there, ["lead", "piece"], "left").select("skip", "body", "there").mapInArrow(_differing(WINDOW), "a long, b long")
    wrong = stage(wrong.distinct(), "substring-wrong")
    if not wrong.isEmpty():
        mended = found.join(_corrections(suspects, wrong), key, "left")
        cut = mended.select("id", "doc_id", "text", "at", "leads", "lead_at", "drop", "add").mapInArrow(_kept(WINDOW, True, digest), schema + sent)
    whole = rows.select("id", "doc_id", "text").mapInArrow(_kept(WINDOW, False, digest), schema).join(suspects.select("id").distinct(), "id", "left_anti")
    return cut.drop("passages").unionByName(whole).drop("id")
