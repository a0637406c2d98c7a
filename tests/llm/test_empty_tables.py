"""Empty tables give empty results, as the docstrings say."""

import corpus_pipeline
from chipmeter.llm import decontam, exact_dedup, mixing, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_operators_on_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    bench, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "labels"))
    scorer = toxicity.fit(none, labels.limit(0))
    for out in (
        exact_dedup.decisions(none), exact_dedup.deduplicate(none), mixing.mix(none), decontam.report(none, bench), decontam.decontaminate(none, bench),
        toxicity.scores(none, scorer), simhash.near_duplicates(none), simhash.deduplicate(none), secrets.scan(none),
    ):
        assert out.count() == 0


def test_stages_on_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0, name
        assert set(none.columns) <= set(out.columns), name
