"""The pipeline's stages, each on its own input, and the registered queries of this package."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle_check import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, found int"
ENGLISH = "the of and to in is that it was for with on by this from at an be are or".split()
GERMAN = "der die und das ist nicht ein eine mit für auf zu den von dem sich auch über als an".split()


def prose(rng, n, own):
    names = [f"{rng.choice(own)}{rng.choice(own)}{rng.choice(own)}" for _ in range(n)]
    return " ".join(rng.choice(own) if rng.random() < 0.4 else w for w in names)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted cases: who stays after the stages is known."""
    rng = random.Random(12)
    texts = {i: "\n".join(prose(rng, rng.randint(12, 60), ENGLISH if i % 3 else GERMAN) for _ in range(3)) for i in range(60)}
    langs = {i: "en" if i % 3 else "de" for i in texts}
    item = prose(rng, 30, ENGLISH)
    texts |= {100: texts[4], 101: texts[5].upper(), 102: f"{texts[7]}\n{item} and more", 103: "1234 5678 !!!", 104: None, 105: ""}
    own = texts[8].split(" ")
    own[20] = "changed"
    texts[106] = " ".join(own)
    texts[107] = f"{texts[9].splitlines()[0]}\n{prose(rng, 40, ENGLISH)}"
    long = "\n".join(prose(rng, 50, ENGLISH) for _ in range(40))
    texts[108] = long
    rows = [(i, t, langs.get(i, "en"), "s", len(t or ""), "r", 1) for i, t in texts.items()]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(rng, 30, GERMAN)), (3, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), texts


def test_stages_take_effect(spark, folder, tmp_path):
    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        left[name] = {r["doc_id"] for r in docs.collect()}
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() == len(left[name])
    everyone = set(texts)
    assert left["language_id"] == everyone - {103, 104, 105}
    # whole copies lose all their lines
    assert left["language_id"] - left["line_dedup"] >= {100, 101} and left["line_dedup"] >= set(range(60)) | {102, 107, 108}
    assert left["near_dedup"] >= set(range(60))
    assert left["near_dedup"] - left["decontamination"] == {102}
    assert left["best_fit_packing"] == left["decontamination"] and left["decontamination"] >= set(range(60)) | {107, 108}
    kept = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "1")).collect()}
    assert kept[107]["text"] == texts[107].split("\n")[1] and kept[107]["n_chars"] == len(kept[107]["text"])
    assert all(kept[i]["text"] == texts[i] for i in range(60))


def test_each_stage_on_the_raw_documents(spark, folder):
    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert near == set(texts) - {100, 101, 106}
    clean = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, sf_dir).collect()}
    assert clean == set(texts) - {102}


def test_run_is_the_stages(spark, folder):
    sf_dir, _ = folder
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(used) == max(1, -(-sum(r["length"] for r in rows) // 2048)) and {0, 59, 107, 108} <= {r["doc_id"] for r in rows}


def test_empty_documents(spark, folder, tmp_path):
    sf_dir, _ = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "op5_benchmark_decontamination"])
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir) is None


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
