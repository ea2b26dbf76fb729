"""Audit of how far the sources of a language diverge in their terms, over hash-consed segment trees of term counts.

Counting is by document batch in Arrow (a term once a document, and all its occurrences), then by grouping with partial aggregation. The terms that are kept get
numbers within their language, frequent ones first, so that rare terms stand together and most of a group's counts there are alike. Over these numbers each group has a segment tree
with its counts as leaves. Nodes are hash-consed: a node is the pair of its halves, so equal stretches of counts are one node, in whatever group and place they stand.
Two groups are compared by walking both trees at once from the root. What a pair of nodes costs depends on the two nodes alone, as the groups' sums are fixed, so equal
pairs of nodes are one state with a multiplicity, and are opened and priced once.

The upper levels of all trees are cut off at blocks of 2**LEVELS numbers, and groups are dealt into tiles of TILE. A task walks the trees of two tiles in one block:
2 * TILE * 2**LEVELS counts at most, however many groups and terms there are; sums over blocks are partial aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, small, stage, steps, text_of, tidy, utf8, words

#: Levels of a block's trees, groups of a tile, states of a walk that are opened at once, and the ranks of terms that are told.
LEVELS, TILE, WALK, TOP = 12, 64, 1 << 18, 200
#: Documents that a kept term is in at least, and the unit of shares.
LEAST_DOCS, UNIT = 3, 1_000_000_000
#: Bytes of text counted together, before counts are handed on.
COUNTED = 4 << 20

_BYTE = np.arange(256)
#: ASCII characters that are no letters part terms; A to Z become small.
_APART = (_BYTE <= 0x40) | (_BYTE >= 0x5B) & (_BYTE <= 0x60) | (_BYTE >= 0x7B) & (_BYTE <= 0x7F)
_LOWER = (_BYTE + 32 * ((_BYTE >= 0x41) & (_BYTE <= 0x5A))).astype(np.uint8)


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = pc.dictionary_encode(column)
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    for batch in batches:
        langs, sources, texts = (batch.column(c) for c in ("lang", "source", "text"))
        for lo, hi in steps(utf8(texts)[1], COUNTED):
            raw, offsets = utf8(texts.slice(lo, hi - lo))
            starts, ends, first = words(raw, offsets, _APART)
            lower = _LOWER[raw[~_APART[raw]]]  # terms on end: parts are nothing but what parts them
            at = np.append(0, np.cumsum(ends - starts))
            terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(lower.tobytes())])
            term, found = _codes(terms)
            lang, known_langs = _codes(langs.slice(lo, hi - lo))
            source, known_sources = _codes(sources.slice(lo, hi - lo))
            group = lang * len(known_sources) + source
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            width = max(len(found), 1)
            in_doc, n = np.unique(doc * width + term, return_counts=True)
            cell, back = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
            docs, n = np.bincount(back, minlength=len(cell)), np.bincount(back, n, minlength=len(cell)).astype(np.int64)
            pair = cell // width
            columns = [known_langs.take(pa.array(pair // len(known_sources))), known_sources.take(pa.array(pair % len(known_sources))), found.take(pa.array(cell % width)), pa.array(n), pa.array(docs.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in columns[:3]] + columns[3:], ["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it). A null is empty in each of the columns."""
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(kept: DataFrame) -> DataFrame:
    """kept (lang, term, total) with number: its place in its language, by total descending, then term, without one task that sees a language."""
    order = [F.col("lang"), F.col("total").desc(), F.col("term")]
    dealt = stage(kept.repartitionByRange(min(partitions(kept.sparkSession), 64), *order).withColumn("part", F.spark_partition_id()), "divergence-terms")
    sizes = dealt.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n_part"))
    before = sizes.select("lang", "part", (F.sum("n_part").over(W.partitionBy("lang").orderBy("part")) - F.col("n_part")).alias("before"))  # a row a language and partition
    inside = F.row_number().over(W.partitionBy("lang", "part").orderBy(*order[1:])) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(before), ["lang", "part"]).select("lang", "term", "total", (F.col("before") + F.col("inside")).alias("number"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The share of a term in units, one at least: (count + 1) of (total + terms). Whole numbers throughout."""
    return 1 + F.call_function("div", F.lit(UNIT).cast("long") * (count + 1), F.greatest(total + terms, F.lit(1).cast("long")))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# ---------------------------------------------------------------- trees, inside tasks


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The roots of the trees over the rows of leaves (a power of two of counts each); of each level, from the leaves up, the halves of each node; and the
    count of each leaf node. Nodes of a level are the distinct pairs of nodes below."""
    values, nodes = np.unique(leaves, return_inverse=True)
    nodes, levels, below = nodes.reshape(leaves.shape), [], len(values)
    while nodes.shape[1] > 1:
        key, nodes_up = np.unique(nodes[:, 0::2].astype(np.int64) * below + nodes[:, 1::2], return_inverse=True)
        levels.append(np.stack([key // below, key % below], 1))
        nodes, below = nodes_up.reshape(nodes.shape[0], -1), len(key)
    return nodes[:, 0], levels, values


def walk(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Walks pairs of trees from their roots a and b at once: (pair, leaf of a, leaf of b, how often). Equal pairs of nodes of one pair of trees are one state."""
    times = np.ones(len(a), np.int64)
    for halves in reversed(levels):
        pair, times = np.tile(pair, 2), np.tile(times, 2)
        a, b = halves[a].T.ravel(), halves[b].T.ravel()
        order = np.lexsort((b, a, pair))
        pair, a, b, times = pair[order], a[order], b[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        pair, a, b, times = pair[new], a[new], b[new], np.add.reduceat(times, new)
    return pair, a, b, times


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    return 1 + UNIT * (count + 1) // np.maximum(total + terms, 1)


def _priced(levels: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        """Of a block of numbers and two tiles of groups: what each ordered pair of a group of the first and one of the second costs there. A row holds a group's numbers and counts in the block."""
        sizes = [len(x) for x in rows.column("numbers")]
        side = rows.column("side").to_numpy()
        leaves = np.zeros((len(sizes), 1 << levels), np.int64)
        if sum(sizes):
            at = np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(rows.column("numbers")).to_numpy() & (1 << levels) - 1
            leaves[at] = pc.list_flatten(rows.column("counts")).to_numpy()
        total, terms, block = rows.column("total").to_numpy(), rows.column("terms")[0].as_py(), rows.column("block")[0].as_py()
        depth = levels
        while depth and terms <= 1 << (depth - 1):  # a language of few terms has a small tree
            depth -= 1
        spare = (1 << depth) - min(terms - (block << levels), 1 << depth)  # leaves beyond the last term: no counts in either tree
        roots, below, values = consed(leaves[:, : 1 << depth])
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = np.repeat(first, len(second)), np.tile(second, len(first))
        name = np.array(rows.column("source").to_pylist(), object)
        differ = name[a] != name[b]
        a, b = a[differ], b[differ]
        cost = np.zeros(len(a), np.int64)
        step = max(1, WALK >> depth)
        for lo in range(0, len(a), step):
            pair = np.arange(lo, min(lo + step, len(a)))
            of, x, y, times = walk(roots[a[pair]], roots[b[pair]], below, pair)
            p, q = shares(values[x], total[a[of]], terms), shares(values[y], total[b[of]], terms)
            np.add.at(cost, of, times * ((p - q) * (p - q) // q))
        if spare:
            zero = np.zeros(1, np.int64)
            p, q = shares(zero, total[a], terms), shares(zero, total[b], terms)
            cost -= spare * ((p - q) * (p - q) // q)
        names, lang = rows.column("source"), rows.column("lang")
        return pa.table({"lang": lang.take(pa.array(a)), "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": pa.array(cost)})

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, levels: int = LEVELS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank.

    A language keeps the V terms that are in least_docs of its documents. In a group (lang, source) with N occurrences of kept terms, and in a language as a whole, a
    term with count occurrences has the share p = 1 + floor(10**9 * (count + 1) / (N + V)). A share p costs floor((p - q)**2 / q) against q.
    Part pair: item is each other source of the language, value what all kept terms' shares cost against that source's; all ranks. Part term: item is each term that the group has with a
    share above the language's, value what it costs against that; the first top ranks. Ranks begin at 1, highest value first, ties by item in the order of its bytes.
    Nulls are empty, as texts, languages and sources. A group without any term is compared all the same; with no kept terms, values are 0. Rows that repeat count
    as often as they come. An empty table gives an empty result. Other columns are not read.
    """
    found = stage(counts(docs, text_col, lang_col, source_col), "divergence-counts")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "total")
    terms = stage(numbered(kept), "divergence-numbers")
    langs = stage(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total")), "divergence-langs")
    held = stage(found.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "divergence-held")
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    present = stage(docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct(), "divergence-present")
    tiles = present.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    groups = present.join(sums, ["lang", "source"], "left").join(small(langs), "lang", "left").join(tiles, "lang")
    groups = groups.select("lang", "source", "tiles", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")])
    groups = stage(groups, "divergence-groups")
    ranked = _pairs(held, groups, levels).unionByName(_terms(held, groups))
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    pairs = ranked.filter("part = 'pair'").withColumn("rank", F.row_number().over(order))
    first = ranked.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(first).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _terms(held: DataFrame, groups: DataFrame) -> DataFrame:
    rows = held.withColumnRenamed("total", "term_total").join(small(groups.select("lang", "source", "total", "terms", "lang_total")), ["lang", "source"])
    rows = rows.withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("term_total"), F.col("lang_total"), F.col("terms"))})
    return rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))


def _pairs(held: DataFrame, groups: DataFrame, levels: int) -> DataFrame:
    """What each group costs against each other one of its language. A group's counts of a block are one row, also where it has none, and meet those of each other tile."""
    width = 1 << levels
    filled = held.select("lang", "source", F.floor(F.col("number") / width).alias("block"), F.struct("number", "n").alias("cell")).groupBy("lang", "source", "block").agg(F.collect_list("cell").alias("cells"))
    every = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("terms") - 1) / width), F.lit(0)).cast("long"))))
    rows = every.join(filled, ["lang", "source", "block"], "left").select("lang", "source", "total", "terms", "tiles", "tile", "block", F.coalesce("cells.number", F.array().cast("array<long>")).alias("numbers"), F.coalesce("cells.n", F.array().cast("array<long>")).alias("counts"))
    rows = stage(rows, "divergence-rows").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sides = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    dealt = sides.select("lang", "block", F.when(F.col("side") == 0, F.col("tile")).otherwise(F.col("other")).alias("of"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("tile")).alias("against"), "side", "source", "total", "terms", "numbers", "counts")
    costs = dealt.groupBy("lang", "block", "of", "against").applyInArrow(_priced(levels), "lang string, source string, item string, value long")
    return costs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::BIGINT AS total FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*)::BIGINT AS terms, sum(total)::BIGINT AS lang_total FROM kept GROUP BY lang),
cells AS (SELECT f.lang, source, f.term, count(*)::BIGINT AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL),
sums AS (SELECT lang, source, sum(n)::BIGINT AS total FROM cells GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(s.total, 0) AS total, coalesce(l.terms, 0) AS terms, coalesce(l.lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source LEFT JOIN langs l ON g.lang = l.lang),
all_shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {UNIT} * (coalesce(c.n, 0) + 1) // (g.total + g.terms) AS p, 1 + {UNIT} * (k.total + 1) // (g.lang_total + g.terms) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p)::BIGINT AS value FROM all_shares x JOIN all_shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
  ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
told AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM all_shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
