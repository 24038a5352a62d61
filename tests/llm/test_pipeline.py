import corpus_pipeline as cp
from pyspark.sql import functions as F

from loomline.llm import langid, toxicity
from tests.llm.test_jaccard import brute_force

SF = "/root/testdata/sf0.001"


def keys(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows)


def test_each_stage_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = docs.collect()
    known = cp.language_id(spark, docs, SF).collect()
    model = langid.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rejected = model.predict([r["text"] for r in rows])[3]
    assert keys(known) == keys(r for r, gone in zip(rows, rejected, strict=True) if not gone) and len(known) > 0.95 * len(rows)

    docs = spark.createDataFrame(known, docs.schema)
    civil = cp.toxic_text(spark, docs, SF).collect()
    classifier = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.fold(F.col("doc_id"), 4) != 2)
    assert keys(civil) == keys(r for r in known if classifier.score(r["text"]) < cp.TOXIC_FROM)

    docs = spark.createDataFrame(civil, docs.schema)
    single = cp.near_duplicates(spark, docs, SF).collect()
    least = {key: name for _, key, _, name in brute_force([(r["doc_id"], r["text"]) for r in civil])}
    assert keys(single) == keys(r for r in civil if least[r["doc_id"]] == r["doc_id"]) and len(single) < len(civil)

    packed = cp.best_fit(spark, spark.createDataFrame(single, docs.schema), SF).collect()
    assert sum(r["length"] for r in packed) == sum(len(r["text"].encode().split()) for r in single)


def test_run_applies_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    shown = ["doc_id", "piece", "length", "residual"]
    assert sorted(map(tuple, cp.run(spark, SF).select(shown).collect())) == sorted(map(tuple, docs.select(shown).collect()))


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert name == "best_fit_packing" or out.columns == docs.columns
            assert out.count() <= max(docs.count(), 20)
    kept = cp.near_duplicates(spark, odd_docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "6", "None"]
    twice = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (7, "other words in this one here"), (None, "x y")], "doc_id long, text string")
    assert cp.near_duplicates(spark, twice, SF).count() == 3


def test_an_id_of_two_texts_loses_only_the_linked_one(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "clean text of its own here"), (2, "clean text of its own here"), (3, "a b c d e f g")]
    kept = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert keys(kept) == [rows[0], rows[2]]
