"""Byte pairs, source divergence and hard negatives against a library, SQL and loops."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import byte_pairs, divergence, hard_negatives
from tickloom.llm.queries import ranks

ALPHABET = ["a", "b", "ab", "the", " ", "  ", "\n", "'", "'s", "'re", "1", "23", "é", "ñ", "漢", "字", "　", "!", "?!", "\t", "\x1c", "\x85", "\xa0", "🙂", "İ", "x" * 50, "ACGT", "0" * 30, "\x00", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    words = byte_pairs._encoder(ranks(), byte_pairs.USUAL).library.words
    assert public_tokenizers.PATTERN == byte_pairs.USUAL
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def said(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=120), st.integers(1, 40))
def test_segments_joined_by_a_tree_are_the_whole(parts, size):
    text, tree = "".join(parts), byte_pairs._encoder(ranks(), byte_pairs.USUAL).library
    whole = tree.encode(text).ids
    level = [tree.segment(text[k : k + size]) for k in range(0, len(text), size)] or [tree.segment("")]
    while len(level) > 1:
        level = [tree.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    assert [i for ids in level[0][2] for i in ids.tolist()] == whole
    assert level[0][0] == text and tree.words.bytes_of(np.array(whole, np.int64)).tobytes() == text.encode()


def test_joins_grow_their_windows_until_tokens_are_sound(library):
    """Runs whose tokens all move when something is set before them."""
    words = byte_pairs._encoder(ranks(), byte_pairs.USUAL).library.words
    rng = random.Random(2)
    pieces = [b"a" * n for n in (1, 17, 100, 1000)] + ["漢字".encode() * 300, bytes(rng.choice(b"ab") for _ in range(3000)), bytes(rng.choice(b"etaoin") for _ in range(3000))]
    pieces += [bytes(rng.choice(b"etaoinsr") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    for piece, ids in zip(pieces, words.encoded(pieces)):
        assert ids.tolist() == words._merged_long(np.frombuffer(piece, np.uint8)).tolist()
        if piece not in words.ranks and piece.isalpha():
            assert ids.tolist() == library.encode_ordinary(piece.decode())


def test_byte_pairs(spark, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(60)]
    texts += ["a" * 5000, "漢字" * 3000, "words and more words, " * 400, "  \n" * 900, "one"]
    rows = [(k, t, 7, "x") for k, t in enumerate(texts)] + [(1000, None, 7, "x"), (1001, "", 7, "x"), (None, "a  b c", 7, "x"), (None, None, 7, "x"), *[(2000, "again and again " * 300, 7, "x")] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(5)
    for segment in (byte_pairs.SEGMENT, 500):
        got = byte_pairs.decode(byte_pairs.encode(docs, ranks(), segment=segment), ranks()).collect()
        want = [(i, t or "") for i, t, _, _ in rows]
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(((i, len(e := library.encode_ordinary(t)), said(e), t.encode()) for i, t in want), key=key)
    assert byte_pairs.encode(docs.limit(0), ranks()).count() == 0


def test_byte_pairs_of_the_query(spark, library):
    from tickloom.llm.queries import op11_byte_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        e = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(e), hashlib.sha256(said(e)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_unknown_ids_are_an_error(spark):
    with pytest.raises(Exception, match="no tokens"):
        byte_pairs.decode(spark.createDataFrame([(1, bytearray(said([1 << 20])))], "doc_id long, ids binary"), ranks()).collect()


def audited(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE})").fetchall())


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(6)
    words = [rng.choice(["alpha", "Beta", "é", "ñandú", "Straße", "ÀB", "x"]) + rng.choice("abcdefgh") + rng.choice("XYZ") * rng.randint(0, 3) for _ in range(150)]
    rows = []
    for k in range(150):
        text = rng.choice([" ", "-", "3"]).join(rng.choice(words[: 20 + k]) for _ in range(rng.randint(0, 80)))
        rows.append((k, text, rng.choice(["en", "en", "en", "de", None]), rng.choice([f"s{rng.randint(0, 9)}", "hot", None]), 1, "t"))
    rows += [(500, None, "en", "silent", 1, "t"), (501, "", "fr", "alone", 1, "t"), (502, "once", "it", "a", 1, "t"), (503, "twice", "it", "b", 1, "t"), (504, "x " * 40_000, "en", "long", 1, "t")]
    rows += rows[:3] + [(None, "alpha alpha", "en", "hot", 1, "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, term string").repartition(4)


@pytest.mark.parametrize(("levels", "tile"), [(12, 64), (3, 2)])
def test_source_divergence(sources, levels, tile):
    """In one block and tile, and in many."""
    got = sorted(map(tuple, divergence.audit(sources, levels=levels, tile=tile).select("lang", "source", "part", "item", "value", "rank").collect()))
    want = audited(sources)
    assert got == want and len(want) > 300
    assert {r[4] for r in want if r[:3] == ("it", "a", "pair")} == {0}


def test_source_divergence_of_nothing(sources):
    assert divergence.audit(sources.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6), st.integers(1, 6), st.integers(0, 10**6))
def test_walks_give_all_pairs_of_counts(depth, n, seed):
    rng = np.random.default_rng(seed)
    leaves = rng.integers(0, 3, (n, 1 << depth)) * (rng.random((n, 1)) < 0.8)
    roots, levels, values = divergence.consed(leaves)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    pair, x, y, times = divergence.walk(roots[a], roots[b], levels, np.arange(len(a)))
    got = sorted(zip(pair.tolist(), values[x].tolist(), values[y].tolist(), times.tolist()))
    want = [(k, *c, t) for k in range(len(a)) for c, t in sorted({c: sum(z == c for z in zip(leaves[a[k]].tolist(), leaves[b[k]].tolist())) for c in set(zip(leaves[a[k]].tolist(), leaves[b[k]].tolist()))}.items())]
    assert got == sorted(want)
    same = [k for k in range(n) if (leaves[k] == leaves[0]).all()]
    assert len(set(roots[same])) == 1  # equal stretches are one node


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([-math.inf, -50, 0, 30, 200, 900]))
def test_threshold_joins_lose_nothing(n, dims, seed, least):
    rng = np.random.default_rng(seed)
    rows = np.floor(rng.normal(0, rng.choice([1, 10]), (n, dims)) * rng.random((n, 1)) * 3)
    queries = np.floor(rng.normal(0, 8, (5, dims)))
    bounds = np.full(5, least) + np.arange(5) * 10
    got = sorted(zip(*(c.tolist() for c in hard_negatives.candidates(queries, rows, bounds, chunk=3))))
    score = queries @ rows.T
    assert got == [(a, b, score[a, b]) for a in range(5) for b in range(n) if score[a, b] >= bounds[a]]


def mined(rows, every):
    """By loops."""
    taken = {}
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        taken[(i, label, tuple(math.floor(256 * x) for x in v))] = 1
    big, out = 1 << 62, []
    for i, label, v in taken:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), big if j is None else j, other) for j, other, w in taken if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, None if j == big else j, k + 1, None if m == big else m, -p, -s) for k, (s, m, _) in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4096, 40])
def test_hard_negatives(spark, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives.blocks, "__defaults__", (block,))
    rng, rows = random.Random(9), []
    for i in range(300):
        label = rng.randint(0, 9) if i % 50 else None
        spread = rng.choice([0.02, 0.3, 1.0])
        v = [0.5 + rng.gauss(0, spread) for _ in range(20)]
        rows.append((i, v, label))
    rows += [(1000 + k, rows[k + 1][1], rows[k + 1][2]) for k in range(40)]  # ties
    rows += [rows[20], rows[20], (400, None, 3), (401, [0.1] * 19 + [None], 3), (402, [0.1] * 19 + [math.nan], 3), (403, [math.inf] * 20, 3), (404, [], 3), (405, [0.5] * 3, 3), (None, rows[7][1], 2), (500, [0.0] * 20, 1), (510, [-1.0] * 20, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"score": F.lit("x"), "key": F.lit(1), "block": F.lit(None).cast("int")}).repartition(4)
    got = hard_negatives.mine(df, hard_negatives.shifted("vec_id", "label"), F.col("vec_id") % 10 == 0)
    got = sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)
    want = mined(rows, 10)
    assert got == want and len(want) > 100
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df, anchors=F.col("vec_id") < 0).count() == 0


def shuffled(spark, since):
    """Bytes that the stages after this one wrote for shuffles, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in stages if s.stageId() > since), max((s.stageId() for s in stages), default=-1)


def test_hard_negatives_do_not_shuffle_anchors_to_each_block(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives.blocks, "__defaults__", (10,))
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(rng.normal(0, 0.2, (1200, 24)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    _, since = shuffled(spark, -1)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of size, nothing is small
    try:
        got = sorted(map(tuple, hard_negatives.mine(df, anchors=F.col("vec_id") % 5 == 0).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    written, _ = shuffled(spark, since)
    assert written < 10 * 1200 * 24 * 8  # 120 blocks
    taken = [(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in rows]
    vectors, labels, ids = np.array([v for _, v, _ in taken]), np.array([x for _, _, x in taken]), np.arange(1200)
    want = []
    for i in range(0, 1200, 5):
        score = vectors @ vectors[i]
        near = sorted((-score[j], j) for j in ids if labels[j] == labels[i] and j != i)[:5]
        for p, j in near:
            hard = sorted((-score[m], m) for m in ids if labels[m] != labels[i] and 80 * -p <= 100 * score[m] <= 100 * -p)[:5]
            want += [(i, j, k + 1, m, -p, -s) for k, (s, m) in enumerate(hard)]
    assert got == sorted(want) and len(want) > 1000


def test_hard_negatives_in_groups_of_anchors(spark, monkeypatch):
    for name, value in (("GROUP_BYTES", 2000), ("GROUP", 2), ("FIRST", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(hard_negatives.blocks, "__defaults__", (30,))
    rng, rows = random.Random(3), []
    for i in range(240):
        spread = rng.choice([0.02, 0.3])
        v = [0.5 + rng.gauss(0, spread) for _ in range(12)] if i % 4 else [7e4 + rng.gauss(0, 2e4) for _ in range(2)] if i % 8 else [2e3 + rng.gauss(0, 900) for _ in range(9)]  # floats of either width
        rows.append((i, v, rng.choice([0, 1, 2]) if i % 60 else 9))
    rows += [(1000 + k, rows[5][1], k % 3) for k in range(60)]  # many alike
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = hard_negatives.mine(df, hard_negatives.shifted("vec_id", "label"), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows, 5)
    assert len({r[0] for r in mined(rows, 5)}) > 30


def test_many_labels_and_tables_of_any_order_fill_windows():
    rng = np.random.default_rng(8)
    vectors, labels, ids = np.floor(rng.normal(0, 3, (400, 5))).astype(np.float32), rng.integers(0, 60, 400), rng.permutation(400)
    pair = lambda x, kind=np.int64: np.asarray(x, kind).tobytes()
    at = np.arange(0, 400, 3)
    row = {"dims": 5, "a_ident": pair(ids[at]), "a_label": pair(labels[at]), "a_vector": pair(vectors[at], np.float32), "a_wide": False, "key": pair(at), "windows": pair(np.full(len(at), 2)), "most": pair(np.tile([20, 5], len(at))), "least": pair(np.full(2 * len(at), -(1 << 62)))}
    for same in (True, False):
        batch = hard_negatives._Batch(row, 3)
        for lo in range(0, 400, 50):
            part = slice(lo, lo + 50)
            batch.meet(ids[part], labels[part], hard_negatives._apart(labels[part], vectors[part]), same)
            if lo % 100:
                batch.settle()  # raises thresholds
        got = sorted(zip(*(c.to_pylist() for c in batch.found().columns)))
        want = []
        for a in at:
            score = (vectors @ vectors[a]).astype(int)
            for most in (20, 5):
                fits = [(-score[b], ids[b]) for b in range(400) if ids[b] != ids[a] and (labels[b] == labels[a]) == same and score[b] <= most]
                want += [(a, most, i, -s) for s, i in sorted(fits)[:3]]
        assert got == sorted(want)
