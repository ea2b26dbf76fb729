"""Line dedup with content-defined chunks of lines.

A rolling hash over the hashes of a line and the next one tells where a chunk begins: before all lines but one in EVERY, and before each line of a run of equal ones. A chunk is the LEAST lines from there on, so both its ends
depend on its own lines alone: whatever comes before or after a passage, the same lines hold the same chunks wherever they stand. Chunks overlap; those
that occurred before in the corpus are removed, after their bytes have been compared, and with them all of a repeated passage but a line at its end where no chunk begins.

Chunks are compared in two steps: their hashes with partial aggregation over the whole corpus (a chunk that all documents share meets as one row a task), then
the bytes of those chunks only whose hash repeats, again with partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, tidy
from .exact_dedup import passing

#: One line in EVERY, on average, begins no chunk; a chunk has LEAST lines.
EVERY, LEAST = 64, 2
#: Fixed values of the rolling hash: line hashes are below PRIME, and the next line counts BASE times.
PRIME, BASE = 2147483647, 1000003


def line_hashes(lines: list[bytes]) -> np.ndarray:
    heads = b"".join([hashlib.md5(line).digest()[:4] for line in lines])
    return np.frombuffer(heads, ">u4").astype(np.int64) % PRIME


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first, after last) of all chunks of the lines."""
    own = line_hashes(lines)
    begins = np.flatnonzero(((own[:-1] + own[1:] * BASE) % PRIME % EVERY != 0) | (own[:-1] == own[1:]))
    return [(a, a + LEAST) for a in begins.tolist()]


def _cut(text: pa.Scalar) -> tuple[list[bytes], list[tuple[int, int]]]:
    lines = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
    return lines, chunks(lines)


@tidy
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, firsts, halves = [], [], []
        for row, text in enumerate(batch.column("text")):
            lines, found = _cut(text)
            for a, b in found:
                rows.append(row)
                firsts.append(a)
                halves.append(hashlib.md5(b"\n".join(lines[a:b])).digest())
        h = np.frombuffer(b"".join(halves), np.int64).reshape(-1, 2)
        at = pa.array(rows, pa.int64())
        columns = [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("id").take(at), batch.column("ord").take(at), pa.array(firsts, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "id", "ord", "first"])


@tidy
def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks whose hash repeats."""
    for batch in batches:
        out = []
        for row, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("firsts").to_pylist())):
            lines, found = _cut(text)
            wanted = set(wanted)
            for a, b in found:
                if a in wanted:
                    body = b"\n".join(lines[a:b])
                    out.append((*np.frombuffer(hashlib.md5(body).digest(), np.int64).tolist(), row, a, body))
        cols = list(zip(*out)) or [[]] * 5
        columns = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), batch.column("ord").take(pa.array(cols[2], pa.int64())), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "ord", "first", "body"])


def _kept(with_firsts: bool, digest: bool) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            gone = batch.column("gone").to_pylist() if with_firsts else [None] * batch.num_rows
            for text, firsts in zip(batch.column("text"), gone):
                if firsts:
                    lines, found = _cut(text)
                    firsts = set(firsts)
                    out = {i for a, b in found if a in firsts for i in range(a, b)}
                    body = b"\n".join(x for i, x in enumerate(lines) if i not in out)
                    n.append(len(lines))
                    removed.append(len(out))
                else:
                    body = text.as_buffer().to_pybytes() if text.is_valid else b""
                    n.append(body.count(b"\n") + 1)
                    removed.append(0)
                kept.append(hashlib.sha256(body).hexdigest().encode() if digest else body)
            columns = [batch.column("id"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "doc_id", "n_lines", "n_removed", "kept"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept (the lines that stay; with digest, their SHA-256 in hex).

    Of equal chunks the one in the document of the smallest identifier stays, in one document the first. Identifiers are whole numbers; null comes after all
    others. Rows alike in identifier and text count as one document and lose the same lines. A null text is empty; an empty text is one empty line. An empty
    table gives an empty result. Other columns are not read.
    """
    text, ident = text_of(text_col), F.col(id_col).cast("long")
    rows = docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit((1 << 63) - 1)).alias("ord"), text.alias("text"), F.xxhash64(ident, text).alias("id"))
    found = stage(rows.select("id", "ord", "text").mapInArrow(_hashed, "h1 long, h2 long, id long, ord long, first int"), "line-chunks")
    repeated = stage(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "line-repeated")
    hits = stage(found.join(repeated, ["h1", "h2"]), "line-hits")
    wanted = hits.groupBy("id", "ord").agg(F.collect_set("first").alias("firsts"))
    suspects = stage(passing(rows, hits, "id").join(wanted, ["id", "ord"]), "line-suspects")
    bodies = suspects.select("ord", "text", "firsts").mapInArrow(_bytes_of, "h1 long, h2 long, ord long, first int, body binary")
    place = F.struct("ord", "first")
    classes = stage(bodies.groupBy("h1", "h2", "body").agg(F.min(place).alias("lead")), "line-classes")
    # written, so that nothing but shuffles stands below the joins and adaptive execution can split a chunk of very many documents
    alike = stage(classes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("bodies"), F.min("lead").alias("lead")), "line-alike")
    judged = hits.join(alike, ["h1", "h2"]).filter((F.col("bodies") == 1) & (place > F.col("lead"))).select("id", "ord", "first")
    collided = alike.filter("bodies > 1").select("h1", "h2")
    if not collided.isEmpty():  # equal hashes of different bytes: these occurrences find their class by the bytes
        apart = suspects.select("id", "ord", "text", "firsts").mapInArrow(_with_id(_bytes_of), "h1 long, h2 long, ord long, first int, body binary, id long").join(collided, ["h1", "h2"], "left_semi")
        judged = judged.unionByName(apart.join(classes, ["h1", "h2", "body"]).filter(place > F.col("lead")).select("id", "ord", "first"))
    gone = judged.groupBy("id", "ord").agg(F.collect_set("first").alias("gone"))
    schema = "id long, doc_id long, n_lines long, n_removed long, kept string"
    cut = suspects.select("id", "ord", "doc_id", "text").join(gone, ["id", "ord"], "left").mapInArrow(_kept(True, digest), schema)
    whole = rows.select("id", "doc_id", "text").mapInArrow(_kept(False, digest), schema).join(suspects.select("id").distinct(), "id", "left_anti")
    return cut.unionByName(whole).drop("id")


def _with_id(run: Callable) -> Callable:
    """run, row by row, with the row's id after each result."""
    @tidy
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                for out in run(iter([one])):
                    yield out.append_column("id", pa.array([one.column("id")[0].as_py()] * out.num_rows, pa.int64()))

    return again


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT % {PRIME} AS h FROM lines),
pairs AS (SELECT *, lead(h) OVER w AS next_h, line || chr(10) || lead(line) OVER w AS body FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
chunks AS (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1 AS gone FROM pairs WHERE (h + next_h * {BASE}) % {PRIME} % {EVERY} <> 0 OR h = next_h),
covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM chunks WHERE gone),
judged AS (SELECT l.*, c.i IS NOT NULL AS gone FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
