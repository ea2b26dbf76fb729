"""The pipeline's stages and the decontamination against brute force."""

import pickle
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import decontaminate, mixing, quality, token_store
from tickloom.llm.common import Hasher, utf8
from tickloom.llm.queries import sites, tokenizer
from tickloom.llm.wavelet import WaveletMatrix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, doc string"


def least_distance(pattern, text):
    """Sellers: the least edits that turn the pattern into a run of the text that is not empty."""
    row = list(range(len(pattern) + 1))
    best = len(pattern) + 1
    for w in text:
        old, row = row, [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(old[i - 1] + (p != w), old[i] + 1, row[-1] + 1))
        best = min(best, row[-1])
    return best


def test_decontamination_by_brute_force(spark):
    """Random items of 1 to 40 words, planted with and without edits, also in repeated and long texts."""
    rng = random.Random(17)
    vocab = [f"v{k}" for k in range(60)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(1, 40))] for _ in range(25)]
    rows = []
    for k in range(120):
        own = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for item in rng.sample(items, rng.randint(0, 2)):
            w = list(item)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
            cut = rng.randint(0, len(own))
            own[cut:cut] = w
        rows.append((k, " ".join(own)))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (501, " ".join(rng.choice(vocab) for _ in range(3000))), (None, rows[4][1]), (502, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.distance) for r in decontaminate.leaks(df, bench, shortest=1).collect())
    names, want = {}, []
    for k, i in enumerate(items):
        names.setdefault(tuple(i), k)
    for d, t in rows:
        w = (t or "").split()
        for item, k in names.items():
            distance = least_distance(list(item), w)
            if distance <= int(len(item) * decontaminate.ERROR_RATE):
                want.append((d or -1, k, distance))
    assert got == sorted(want) and len(want) > 80 and any(x[2] > 0 for x in want)


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return 1.0 if not a.split() and not b.split() else len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The tables, and what each stage gives, written and reread as the pipeline does."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(23)
    vocab = [a + b for a in ("tree", "river", "stone", "cloud", "wind", "grass", "hill") for b in ("", "s", "y", "ing", "land", "side")]
    good = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    bench = [good(30) for _ in range(5)]
    rows = [(k, good(rng.randint(20, 120)) if k % 4 else " | ".join(["BUY!!", "$$$"] * 30), "en", f"s{k % 5}" if k % 7 else None) for k in range(160)]
    rows += [(200 + k, rows[k][1] + " more words", "en", "s1") for k in range(1, 40, 3)] + [(300 + k, rows[k][1], "de", "s9") for k in range(1, 20, 6)]
    rows += [(400 + k, f"{good(15)} {b.upper()} {good(9)}", None, "s2") for k, b in enumerate(bench)]
    rows += [(500, None, None, None), (501, "", "en", "s1"), (502, "one", "en", "s1"), (None, good(40), "en", "s1"), (503, good(6000), "en", "s3"), (1, rows[1][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "d", "x") for r in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 160)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, frames[-1], folder).write.parquet(f"{folder}/{k}.parquet")
        frames.append(spark.read.parquet(f"{folder}/{k}.parquet"))
    return folder, bench, frames


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_the_columns(stages):
    _, _, frames = stages
    assert all(f.columns == frames[0].columns for f in frames[:-1])


def test_quality_stage(spark, stages):
    folder, _, frames = stages
    model, scored = quality.train(frames[0], spark.read.parquet(f"{folder}/labels.parquet"), **sites())
    keep = {r.doc_id for r in quality.verdicts(scored, model).collect() if r.keep}
    assert rows_of(frames[1]) == rows_of(frames[0].filter(F.coalesce(F.col("doc_id").isin([k for k in keep if k is not None]), F.lit(None in keep))))
    assert all("|" not in (r.text or "") for r in frames[1].collect()) and {r.doc_id for r in frames[1].collect()} >= {k for k in range(160) if k % 4}


def test_scores_go_back_a_step_at_a_time():
    """A batch that is a task's whole text, with nulls: rows, columns and log odds as text by text, in parts of bounded size, and little beside the batch in memory."""
    rng = random.Random(4)
    known = [None, "", *(" ".join(rng.choice(["tree", "BUY!!", "stone", "|", "wind 7", "größe"]) for _ in range(600)) for _ in range(50))]
    texts = [known[k % len(known)] for k in range(8000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array(texts), pa.array([f"s{k % 9}" if k % 7 else None for k in range(8000)])], ["c0", "c1", "host"])
    draw = np.random.default_rng(4)
    evidence = quality.Evidence(draw.random(quality.WIDTH), draw.random(quality.WIDTH) + 1, draw.normal(size=quality.WIDTH + 1), 0.5)
    alone = [quality.features(*utf8(pa.array([t], pa.string())), Hasher(31)) for t in known]
    tracemalloc.start()
    parts = list(quality._scorer(evidence, 1, batch.schema.names)(iter([batch, batch.slice(0, 0)])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(sum(len((t or "").encode()) for t in part.column("c1").to_pylist()) < 300_000 for part in parts) and most < 32e6
    got = pa.Table.from_batches(parts)
    assert got.drop_columns("out").equals(pa.Table.from_batches([batch])) and got["out"].null_count == 0
    assert np.allclose(got["out"].to_numpy(), [evidence.log_odds(alone[k % len(known)])[0] for k in range(8000)], rtol=0, atol=1e-9)
    raw = pa.Table.from_batches(quality._scorer(None, 1, ["c0"])(iter([batch.slice(0, 200)])))
    assert raw["c0"].to_pylist() == list(range(200)) and raw["out"].to_pylist() == [alone[k % len(known)].tobytes() for k in range(200)]


def test_near_duplicate_stage(stages):
    """One of each group by all pairs: the smallest identifier, null last."""
    _, _, frames = stages
    rows = sorted(frames[1].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    root = list(range(len(rows)))
    near = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a].text or "", rows[b].text or "") >= 0.8]
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(repr(r.doc_id) for r in frames[2].collect()) == sorted(repr(rows[k].doc_id) for k in set(root)) and len(set(root)) < len(rows) - 10


def test_decontamination_stage(stages):
    _, bench, frames = stages
    words = lambda t: (t or "").lower().replace(".", " ").replace("|", " ").split()
    clean = lambda t: all(least_distance(words(b), words(t)) > int(len(words(b)) * decontaminate.ERROR_RATE) for b in bench)
    assert rows_of(frames[3]) == sorted((tuple(r) for r in frames[2].collect() if clean(r.text)), key=repr) and frames[3].count() == frames[2].count() - len(bench)


def test_mixing_stage(stages):
    _, _, frames = stages
    want = sorted((repr(r.doc_id), r.reps) for r in mixing.mix_plan(frames[3]).collect() if r.reps)
    assert sorted((repr(r.doc_id), r["count"]) for r in frames[4].groupBy("doc_id").count().collect()) == want


def test_token_stage(stages):
    from tokenizers import Tokenizer

    library, (_, _, frames) = Tokenizer.from_file(tokenizer()), stages
    want = sorted((r.doc_id is None, r.doc_id or 0, zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in frames[4].collect())
    got = frames[5].orderBy("start").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_empty_tables(spark, stages, tmp_path):
    folder, _, frames = stages
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_token_files_and_leaks_hold_little():
    """What a worker allocates for a batch of 2 MB, beyond it: 57 MB for token files and 22 MB for leaks when steps were of 2 and 1 MB and
    each filter had 4 MB; 14 and 5 since. Ids are the library's, across steps."""
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), n)) for n in rng.integers(2, 12, 9000)]
    texts = [" ".join(rng.choice(vocab, 400)) for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), pa.array(texts), pa.array(np.zeros(700, np.int32))], ["doc_id", "text", "part"])
    encoder = token_store._encoder(tokenizer())
    encoder.forget()
    tracemalloc.start()
    (shard,) = token_store._writer(tokenizer(), 2, 1 << 24)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = WaveletMatrix.from_bytes(shard.column("matrix")[0].as_py()).tokens().tolist()
    assert ids == [i for e in encoder.library.encode_batch(texts, add_special_tokens=False) for i in [*e.ids, 2]]
    assert peak < 25e6

    items = pa.table({"item_id": [0, 1, 2], "text": [" ".join(texts[5].split()[7:27]), "not there at all", " ".join(texts[699].split()[-9:])]})
    tracemalloc.start()
    block = decontaminate.Block(items, decontaminate.ERROR_RATE)
    found = list(block.find(batch.column("text"), Hasher(decontaminate._SEED)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {f[:3] for f in found} >= {(5, 0, 0), (699, 2, 0)} and not {1} & {f[1] for f in found}
    assert peak < 10e6 and len(pickle.dumps(block)) < 1 << 17
