import corpus_pipeline

from wavegauge.llm.queries import oracles, queries


def test_every_query_is_registered():
    names = set(queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x != "pipeline"} and "pipeline" in names
    assert set(oracles()) <= names


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs
    ids = {n: {r["doc_id"] for r in d.collect()} for n, d in seen.items()}
    assert ids["line_dedup"] == ids["toxicity"] and ids["secret_scan"] == ids["minhash"] == ids["packing"] and ids["minhash"] <= ids["toxicity"]
    assert len(toxic & ids["toxicity"]) < len(toxic)
    assert seen["secret_scan"].where("text rlike 'AKIA[A-Z0-9]{12}'").count() == 0


def test_stages_of_odd_tables(edge, nothing, spark, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge.select(columns), nothing.select(columns)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == (edge.count() > 0 and docs.count() > 0)
