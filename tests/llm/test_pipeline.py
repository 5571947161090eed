"""Every query and stage on nulls, repeats, empty and long texts and clashing names; the pipeline stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausewright.llm import queries

NAMES = "lang source n_chars score lang_pred h key root class_id text_id n_links piece start length sequence_id offset digests _lost_id n_lines n_dropped spans term terms rank blob row path seed item_id pos label labels tree host shard blocks window".split()
PASSAGE = " ".join(f"bench{i}" for i in range(40))


def documents(spark):
    rng = random.Random(12)
    word = {"en": ["the", "and", "cat", "dog", "house"], "de": ["der", "und", "katze", "hund", "haus"]}
    prose = lambda k, n: " ".join(rng.choice(word[k]) + (str(rng.randint(0, 99)) if rng.random() < 0.2 else "") for _ in range(n))
    rows = [(i, prose(k, 60), k) for i, k in enumerate(["en", "de"] * 20)]
    line = "A line that three documents have in common"
    rows += [(100 + i, f"{line}\n{rows[i][1]} tail {i} of it", "en") for i in range(4)]
    rows += [(200, rows[0][1], "en"), (201, rows[0][1] + " more", None), (202, f"the {PASSAGE} and", "en"), (203, None, "de"), (204, "", None), (205, "1 2 3", "en"), (206, "the cat " * 30_000, "en")]
    rows += [(None, "the dog and the cat", "en"), (None, None, None), (40, "the house of the dog", "en"), (40, "der hund und das haus", "de"), rows[3], rows[3]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return d.select("doc_id", "text", "lang", *[(F.lit("s") if n == "source" else F.length("text").cast("long") if n == "n_chars" else F.lit(1)).alias(n) for n in NAMES[1:]])


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("in"))
    documents(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE, 1), (2, None, 1), (3, "", 1), (None, "the x y z", 1)], "item_id long, text string, seed int").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a/", "<p>a</p>", 1), (1, "http://a/", "<p>a</p>", 1), (None, None, None, 1)], "page_id long, url string, html string, shard int").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(50)] + [(None, None, 1)], "vec_id long, embedding array<double>, rank int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, sf_dir, empty_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    rows, n = got.collect(), spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name.split("_")[0] in ("op1", "op3", "op6", "op9", "op10"):
        assert len(rows) == n
    empty = queries.QUERIES[name](spark, empty_dir)
    assert empty.columns == got.columns and empty.collect() == []


def test_stages(spark, sf_dir, empty_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "best-fit packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            texts[name] = {(r.doc_id, r.text) for r in docs.collect()}
    kept = texts["language ID"]
    assert {i for i, _ in kept}.isdisjoint({203, 204, 205}) and {i for i, _ in kept} >= {*range(41), 100, 200, 202, 206, None} and (40, "der hund und das haus") in kept
    lines = {i: t for i, t in texts["line dedup"] if i and 100 <= i < 104}
    assert [i for i, t in lines.items() if t.startswith("A line")] == [103]
    one = texts["n-gram Jaccard join"]
    assert {i for i, _ in one}.isdisjoint({100, 102, 200, 201}) and {i for i, _ in one} >= {*range(40), 202, 206} and {t for i, t in one if i == 40} == {"the house of the dog", "der hund und das haus"}
    assert texts["benchmark decontamination"] == {(i, t) for i, t in one if i != 202}
    assert {r.doc_id for r in out.collect()} == {i for i, _ in texts["benchmark decontamination"]} and out.where("offset + length > 2048").count() == 0
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32").collect()} == {tuple(r) for r in out.select("doc_id", "piece", "start", "length", "ids_crc32").collect()}
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_decontamination_by_brute_force(spark):
    import math

    from clausewright.llm import decontam

    rng = random.Random(13)
    words = [f"w{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(rng.randint(5, 30))] for _ in range(12)]
    docs = []
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            part = [w if rng.random() > 0.15 else "other" for w in rng.choice(items)]
            a = rng.randint(0, len(t))
            t[a:a] = part[rng.randint(0, 4) :]
        docs.append(t)
    want = {}
    for d, t in enumerate(docs):
        for i, x in enumerate(items):
            size = min(len(x), decontam.LENGTH)
            best = 0
            for shift in range(-len(x), len(t) + 1):
                same = [0 <= shift + j < len(t) and t[shift + j] == w for j, w in enumerate(x)]
                best = max(best, *(sum(same[a : a + size]) for a in range(len(x) - size + 1)))
            if best >= math.ceil(size * decontam.AGREE):
                want[d, i] = best
    got = decontam.overlaps(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.matched for r in got.collect()} == want
