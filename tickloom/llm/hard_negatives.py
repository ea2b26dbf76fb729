"""Hard negatives: of each anchor's nearest rows of its own label, the rows of other labels that score just below, by threshold joins over inverted blocks.

Rows are packed into blocks, anchors into batches: a row of a table holds the vectors of thousands. A block keeps its vectors by dimension, those of most weight last, in chunks
of dimensions. Given thresholds, a row's first chunks are
left out of the index as long as their norm times the anchors' largest norm is below the least threshold: they alone can't reach it. The indexed
chunks are taken from the last one on, each for the rows only that are indexed there, and partial scores add up; where a few rows of the block show that it pays, what the two
remaining norms could add at most rules out rows and anchors. What is left gets its exact score.

A window (the best scores of an anchor's own label, or scores up to a positive's) first asks a share of the blocks. The last of the places that these fill is a threshold that the
whole table reaches too; with it all blocks are asked. A window that the share does not fill asks with what the definition allows. A task raises thresholds as its blocks fill windows.
The anchors are a stated set. They pass over the blocks in groups of bounded size, a group after the other: neither rows nor anchors are shuffled for their meeting, and a task
holds one block, one batch and the best so far of a group's windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ragged, release, stage, tidy

#: Rows of a block, anchors of a batch, dimensions of a chunk.
BLOCK, BATCH, CHUNK = 4096, 2048, 16
#: Anchors that meet a block at once, rows of it that show whether bounds pay, and products a pair that they are to spare then.
AT_ONCE, SHOWN, SPARED = 256, 32, 32
#: Batches of a group, and bytes of vectors that a group has at most on average.
GROUP, GROUP_BYTES = 8, 8 << 20
#: One of so many blocks is asked first.
FIRST = 16
#: Labels that an anchor batch and a block share, up to which each is a product by itself.
APART = 32
LAST = (1 << 63) - 1
#: Scores up to which floats of either width hold every sum.
EXACT, EXACT_SINGLE = float(1 << 52), float(1 << 24)


def scaled(rows: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None = None) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles) of the rows that take part; rows alike in all three are one row."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    sound = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = label if label is not None else F.col(label_col)
    out = rows.filter(F.col(label_col).isNotNull()).filter(F.coalesce(sound, F.lit(False)))
    return out.select(F.col(id_col).cast("long").alias("vec_id"), own.cast("long").alias("label"), v.alias("vector")).distinct()


def shifted(id_col: str, label_col: str, every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one where the identifier is divisible by every."""
    label = F.col(label_col)
    return F.when(F.col(id_col) % every == 0, (label + 1) % labels).otherwise(label)


# ---------------------------------------------------------------- inside tasks


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _norms(m: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Of each row the norms of the first chunks: of none, of one, ..."""
    m = m.astype(np.float64)
    return np.sqrt(np.append(np.zeros((len(m), 1)), np.cumsum(np.add.reduceat(m * m, cut, axis=1), 1), axis=1)) * (1 + 1e-9)


class Block:
    """Rows (whole numbers as floats, a row a vector) by dimension, those of most weight last, and the norms of their first chunks."""

    def __init__(self, rows: np.ndarray, chunk: int = CHUNK) -> None:
        self.order = np.argsort((rows.astype(np.float64) ** 2).sum(0), kind="stable")
        self.cut = np.append(np.arange(0, rows.shape[1], chunk), rows.shape[1])
        self.x = rows[:, self.order]
        self.norm = _norms(self.x, self.cut[:-1])
        self.most = self.norm[:, -1].max()

    def _pays(self, q: np.ndarray, q_norm: np.ndarray, least: np.ndarray, omitted: np.ndarray) -> tuple[bool, list[int]]:
        """By a few rows: whether leaving chunks out of the index spares half of the products; and if not, the chunks after which bounds, applied from the last one on, spare some."""
        step = max(1, len(omitted) // SHOWN)
        x, norm, omitted = self.x[::step], self.norm[::step], omitted[::step]
        chunks, most = len(self.cut) - 1, q_norm.max(0)
        partial, indexed, stops, left = np.zeros((len(q), len(x))), np.zeros((len(q), len(x))), [], 1.0
        for c in range(chunks - 1, 0, -1):
            part = slice(self.cut[c], self.cut[c + 1])
            more = q[:, part] @ x[:, part].T
            partial += more
            indexed += more * (omitted <= c)
            share = ((partial - least[:, None]).max(0) + most[c] * norm[:, c] >= 0).mean()
            if (left - share) * self.cut[c] >= SPARED:
                stops.append(c)
                left = share
        ruled_out = (indexed - least[:, None]).max(0) + most[omitted] * norm[np.arange(len(x)), omitted] < 0
        return bool((self.cut[omitted] * ruled_out).mean() >= self.cut[-1] / 2), stops

    def reached(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all pairs whose inner product is least or more (by query)."""
        cut, chunks = self.cut, len(self.cut) - 1
        q = queries[:, self.order]
        q_norm = _norms(q, cut[:-1])
        size = q_norm[:, -1].max() * self.most
        if size > EXACT:
            raise ValueError("scores beyond 2**52")
        if size < EXACT_SINGLE:
            q, x = q.astype(np.float32), self.x.astype(np.float32, copy=False)
            bound = np.ceil(np.clip(least, -EXACT_SINGLE, EXACT_SINGLE)).astype(np.float32)
        else:
            q, x, bound = q.astype(np.float64), self.x.astype(np.float64, copy=False), least
        omitted, by, x_norm = np.zeros(len(x), np.int64), np.arange(len(x)), self.norm
        if least.min() > 0:  # chunks that are not indexed
            omitted = (x_norm * q_norm[:, -1].max() < least.min()).sum(1) - 1
        left_out, stops = self._pays(q, q_norm, least, omitted) if least.min() > -size else (False, [])
        if not left_out:
            omitted = np.where(omitted == chunks, chunks, 0)
        if omitted.any():
            by = np.argsort(omitted, kind="stable")[: int((omitted < chunks).sum())]  # rows that are wholly left out are never met
            x, x_norm, omitted = x[by], x_norm[by], omitted[by]
        live_q, live, partial, top = np.arange(len(q)), np.arange(len(x)), None, chunks
        for c in range(chunks - 1, -1, -1) if left_out else [*stops, 0]:
            if not len(live_q) or not len(live):
                break
            has = int(np.searchsorted(omitted[live], c, "right")) if left_out else len(live)
            part = slice(cut[c], cut[top])
            if partial is None:
                partial = np.zeros((len(q), len(x)), x.dtype) if left_out else q[:, part] @ x[:, part].T
            if left_out or top < chunks:
                partial[:, :has] += q[live_q, part] @ x[live[:has], part].T
            top = c
            if not c and not left_out:
                break
            open_ = np.maximum(omitted[live], c)  # of a row, the chunks before c are open, or all that are not indexed
            over, rest = partial - bound[live_q, None], x_norm[live, open_]  # whole numbers, rounded by 2 at most
            keep = over.max(0) + q_norm[live_q].max(0)[open_] * rest >= -2
            keep_q = over.max(1) + q_norm[live_q, open_.max()] * rest.max() >= -2
            if not keep_q.all() or not keep.all():
                live_q, live, partial = live_q[keep_q], live[keep], partial[np.ix_(keep_q, keep)]
        if partial is None or not partial.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for c in range(chunks if left_out else 0):  # the chunks that were left out
            lack, part = np.flatnonzero(omitted[live] > c), slice(cut[c], cut[c + 1])
            if len(lack):
                partial[:, lack] += q[live_q, part] @ x[live[lack], part].T
        some = np.flatnonzero(partial.max(1) >= bound[live_q])
        live_q, partial = live_q[some], partial[some]
        a, b = np.divmod(np.flatnonzero(partial >= bound[live_q, None]), len(live))
        return live_q[a], by[live[b]], partial[a, b].astype(np.float64)


def candidates(queries: np.ndarray, rows: np.ndarray, least: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs whose inner product is least or more (by query). Both: whole numbers as floats, a row a vector."""
    if not len(rows) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return Block(rows, chunk).reached(queries, least)


def _best(window: np.ndarray, score: np.ndarray, ident: np.ndarray, n: int) -> np.ndarray:
    """Of each window the places of its n best: highest score first, then smallest identifier."""
    order = np.lexsort((ident, -score, window))
    first = np.concatenate([[True], window[order][1:] != window[order][:-1]]) if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    return order[np.arange(len(order)) - start < n]


PACKED = "dims int, wide boolean, ident binary, label binary, vector binary"


def _packed(size: int, asked: bool) -> Callable:
    """Rows as blocks of at most so many, those of one length together. asked: with key and windows, an anchor's lists of most and least."""

    def pack(t: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = pc.list_value_length(t["vector"]).to_numpy()
        for d in np.unique(dims):
            part = t.take(np.flatnonzero(dims == d)).combine_chunks()
            m = _matrix(part["vector"].combine_chunks())
            wide = bool(np.abs(m).max() >= EXACT_SINGLE)
            raw = [part["vec_id"].fill_null(LAST).to_numpy(), part["label"].to_numpy(), m if wide else m.astype(np.float32)]
            names = ["ident", "label", "vector"]
            if asked:
                lists = [part[c].combine_chunks() for c in ("most", "least")]
                raw += [part["key"].to_numpy(), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64)] + [pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in lists]
                names += ["key", "windows", "most", "least"]
            columns = [pa.array([int(d)], pa.int32()), pa.array([wide])] + [pa.array([np.ascontiguousarray(r).tobytes()], pa.binary()) for r in raw]
            yield pa.RecordBatch.from_arrays(columns, ["dims", "wide", *names])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                t = pa.Table.from_batches(held)
                yield from pack(t.slice(0, size))
                held, n = t.slice(size).to_batches(), n - size
        if n:
            yield from pack(pa.Table.from_batches(held))

    return run


class _Batch:
    """Anchors and their windows, and of each window the n best rows that a task has met."""

    def __init__(self, row: dict, n: int) -> None:
        self.n, self.dims = n, row["dims"]
        self.ident, self.label, self.key, count, most, least = (np.frombuffer(row[c], np.int64) for c in ("a_ident", "a_label", "key", "windows", "most", "least"))
        self.vector = np.frombuffer(row["a_vector"], np.float64 if row["a_wide"] else np.float32).reshape(len(self.key), -1)
        self.first = np.cumsum(count) - count
        self.count, self.most, self.least = count, most, least.astype(np.float64)
        self.last = np.full(len(most), LAST)  # identifier of a filled window's last place: at the threshold, rows behind it are out
        self.best = self.waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # window, score, identifier
        self.lowest = np.minimum.reduceat(self.least, self.first)

    def add(self, anchor: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        times = self.count[anchor]
        window = np.repeat(self.first[anchor], times) + ragged(times)
        score, ident = np.repeat(score, times), np.repeat(ident, times)
        fits = (score <= self.most[window]) & ((score > self.least[window]) | (score == self.least[window]) & (ident <= self.last[window]))
        self.waiting = tuple(np.append(a, b[fits]) for a, b in zip(self.waiting, (window, score, ident)))
        if len(self.waiting[0]) > max(len(self.best[0]), 1 << 16):
            self.settle()

    def settle(self) -> None:
        window, score, ident = (np.append(a, b) for a, b in zip(self.best, self.waiting))
        top = _best(window, score, ident, self.n)
        self.best = window, score, ident = window[top], score[top], ident[top]
        self.waiting = tuple(a[:0] for a in self.best)
        end = np.flatnonzero(np.append(window[1:] != window[:-1], True)[: len(window)])
        end = end[np.bincount(window, minlength=len(self.most))[window[end]] == self.n]
        self.least[window[end]], self.last[window[end]] = score[end], ident[end]
        self.lowest = np.minimum.reduceat(self.least, self.first)

    def meet(self, ident: np.ndarray, label: np.ndarray, block: Callable, same: bool) -> None:
        """block: of the rows of a label, or with None of all rows, their places and Block."""
        common = np.intersect1d(self.label, label) if same else []
        for own in common if same and len(common) <= APART else [None] * (not same or len(common) > 0):
            mine = np.arange(len(self.key)) if own is None else np.flatnonzero(self.label == own)
            at, rows = block(own)
            for lo in range(0, len(mine), AT_ONCE):
                part = mine[lo : lo + AT_ONCE]
                a, b, score = rows.reached(self.vector[part], self.lowest[part])
                a, b = part[a], at[b]
                fits = (label[b] == self.label[a]) & (ident[b] != self.ident[a]) if same else label[b] != self.label[a]
                self.add(a[fits], score[fits].astype(np.int64), ident[b[fits]])

    def found(self) -> pa.RecordBatch:
        self.settle()
        window, score, ident = self.best
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(self.key, self.count)[window], self.most[window], ident, score)], ["key", "most", "found", "score"])


def _searched(n: int, same: bool) -> Callable:
    """Of each window of the anchors the n best of all rows that a task meets (a row: a block and a batch). same: rows of the anchor's label, but the anchor; else of other labels."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, _Batch] = {}
        seen, ident, label, block = None, None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("batch")[k].as_py()
                if number not in asked:
                    asked[number] = _Batch({c: batch.column(c)[k].as_py() for c in ("dims", "a_ident", "a_label", "a_vector", "a_wide", "key", "windows", "most", "least")}, n)
                raw = [batch.column(c)[k].as_buffer() for c in ("ident", "label", "vector")]
                if seen is None or not all(a.equals(b) for a, b in zip(raw, seen)):  # a block meets one batch after the other
                    seen = [pa.py_buffer(r.to_pybytes()) for r in raw]
                    ident, label = (np.frombuffer(r, np.int64) for r in seen[:2])
                    block = _apart(label, np.frombuffer(seen[2], np.float64 if batch.column("wide")[k].as_py() else np.float32).reshape(len(ident), -1))
                asked[number].meet(ident, label, block, same)
            batch = raw = None  # tens of MB, not to be held while the next ones come
            release()
        for one in asked.values():
            yield one.found()

    return run


def _apart(label: np.ndarray, rows: np.ndarray) -> Callable:
    known: dict[int | None, tuple[np.ndarray, Block]] = {}

    def block(own: int | None) -> tuple[np.ndarray, Block]:
        if own not in known:
            at = np.arange(len(rows)) if own is None else np.flatnonzero(label == own)
            known[own] = at, Block(rows[at])
        return known[own]

    return block


# ---------------------------------------------------------------- on DataFrames


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """rows (staged) in blocks of at most so many, one row each."""
    return stage(rows.select("vec_id", "label", "vector").mapInArrow(_packed(size, False), PACKED), "negatives-blocks")


def search(windows: DataFrame, anchors: DataFrame, index: DataFrame, n: int, same: bool) -> DataFrame:
    """key, most, found, score, rank: the n best of each window's rows with a score from least to most. windows: key, most, least; anchors: key, vec_id, label, vector; both staged."""
    lists = windows.groupBy("key").agg(F.collect_list(F.struct("most", "least")).alias("w")).select("key", F.col("w.most").alias("most"), F.col("w.least").alias("least"))
    rows, parts = lists.join(anchors, "key"), "key binary, windows binary, most binary, least binary"
    weight = anchors.agg(F.sum(F.size("vector").cast("long") * 8), F.avg(F.size("vector"))).first()
    groups = max(1, -(-(weight[0] or 0) // GROUP_BYTES))
    size = max(1, min(BATCH, int(GROUP_BYTES / GROUP / (8 * (weight[1] or 1)))))
    dealt = rows.select("vec_id", "label", "vector", "key", "most", "least").repartition(groups, "key").mapInArrow(_packed(size, True), f"{PACKED}, {parts}")
    dealt = stage(dealt.withColumn("batch", F.monotonically_increasing_id()).withColumnsRenamed({c: f"a_{c}" for c in ("ident", "label", "vector", "wide")}), "negatives-asked")
    order, out = W.partitionBy("key", "most").orderBy(F.col("score").desc(), "found"), None
    for group in range(groups):
        batches = dealt.filter(F.pmod(F.shiftright("batch", 33), F.lit(groups)) == group)
        met = index.join(F.broadcast(batches), "dims").mapInArrow(_searched(n, same), "key long, most long, found long, score long")
        found = stage(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n), "negatives-found")
        out = found if out is None else out.unionByName(found)
    return out


def filled(windows: DataFrame, anchors: DataFrame, index: DataFrame, n: int, same: bool) -> DataFrame:
    """search(), with the thresholds that a share of the blocks gives. windows: staged, with the definition's own least."""
    first = search(windows, anchors, index.filter(F.pmod(F.xxhash64("ident"), F.lit(FIRST)) == 0), n, same)
    reached = first.filter(F.col("rank") == n).select("key", "most", F.col("score").alias("reached"))
    raised = windows.join(reached, ["key", "most"], "left").select("key", "most", F.greatest("least", F.coalesce("reached", "least")).alias("least"))
    return search(stage(raised, "negatives-windows"), anchors, index, n, same)


def mine(
    rows: DataFrame, label: Column | None = None, anchors: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(256 * x); a score is an inner product of these, higher first, ties by the smaller identifier, null ones last. Of each anchor (anchors: over
    vec_id; else all rows) the first positives other rows of its label, and of each of these the first negatives rows of other labels that have low percent of its score or
    more, and no more than it. Rows with a null label, a null or empty vector or a component that is null or not finite take no part; nor do pairs of vectors of
    different lengths. Rows alike in identifier, label and vector are one row; rows that share an identifier alone are different ones, but none of them
    is a positive of the other. Null identifiers are no anchors if anchors is given. No rows, or no anchors, give an empty result. Other columns are not read.
    Scores above 2**52 are an error.
    """
    taken = stage(scaled(rows, id_col, vector_col, label_col, label), "negatives-rows")
    index = blocks(taken)
    chosen = taken.filter(anchors) if anchors is not None else taken
    chosen = stage(chosen.withColumn("key", F.xxhash64("vec_id", "label", "vector")), "negatives-anchors")
    near = filled(chosen.select("key", F.lit(LAST).alias("most"), F.lit(-LAST).alias("least")), chosen, index, positives, True)
    # a positive below zero has no scores between low percent of it and itself; equal positives of an anchor ask the same
    near = near.filter("score >= 0").select("key", F.col("score").alias("most"), F.col("found").alias("positive"))
    windows = stage(near.select("key", "most", F.expr(f"(most * {low} + 99) div 100").alias("least")).distinct(), "negatives-windows")
    hard = filled(windows, chosen, index, negatives, False).withColumnRenamed("score", "negative_score")
    ident = lambda c: F.when(F.col(c) != LAST, F.col(c))
    out = near.join(hard, ["key", "most"]).join(chosen.select("key", "vec_id"), "key")
    return out.select(F.col("vec_id").alias("anchor_id"), ident("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), ident("found").alias("negative_id"), F.col("most").alias("positive_score"), "negative_score")


ORACLE = """
WITH taken AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor, a.label AS own, b.vec_id AS other, b.label, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM taken a JOIN taken b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS nth FROM scored WHERE label = own) WHERE nth <= 5),
negatives AS (SELECT p.anchor, p.other AS positive, p.score AS positive_score, s.other AS negative, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, negative AS negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
