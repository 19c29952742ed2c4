import corpus_pipeline
from pyspark.sql import functions as F

from tmengine.llm import packing, pii, quality_classifier, quality_rules, simhash


def test_stages_compose(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = quality_rules.quality_rules(docs).where("kept")
    first = corpus_pipeline.rules(spark, docs, sf_dir)
    assert first.columns == docs.columns and first.dtypes == docs.dtypes and {r.doc_id for r in first.collect()} == {r.doc_id for r in kept.collect()}
    second = corpus_pipeline.classifier(spark, first, sf_dir)
    good = {r.doc_id for r in quality_classifier.quality_scores(first, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert 0 < len(good) < first.count() and {r.doc_id for r in second.collect()} == good and second.columns == docs.columns
    third = corpus_pipeline.near_dedup(spark, second, sf_dir)
    groups = {r.component_id for r in simhash.near_duplicates(second).collect()}
    assert {r.doc_id for r in third.collect()} == groups and third.count() == len(groups)
    fourth = corpus_pipeline.private_data(spark, third, sf_dir)
    assert {r.doc_id: r.text for r in fourth.collect()} == {r.doc_id: r.text for r in pii.pseudonymise(third, pii.session_key(spark)).collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.packed(spark, fourth, sf_dir).collect()) == sorted(groups)
    whole = sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
    assert whole == sorted(map(str, packing.pack(fourth).collect()))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeats, clashing columns; each stage's defined result."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, group long, component_id long, n_private int, batch_id int"
    text = " ".join(f"word{i} and" for i in range(80))
    other = " ".join(f"another{i} or" for i in range(80))
    long = " ".join(f"long{i} text" for i in range(60_000))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text, None, None, None), (2, None, "en", "a", 0), (3, "", "en", None, 0), (4, text + " more", "en", "a", 9)]
    rows += [(1, other, "en", "a", 7), (7, long, "en", "a", 1), (8, "mail a@b.de", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, True, 0.5, 1, 1, 1, 1) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    some = lambda name: sorted((str(r.doc_id), len(r.text or "")) for r in stages[name](spark, docs, sf_dir).collect())
    sized = lambda *at: sorted((str(rows[i][0]), len(rows[i][1] or "")) for i in at)
    assert some("quality rules") == sized(0, 1, 2, 5, 6, 7)
    scored = quality_classifier.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("size", F.coalesce(F.length("text"), F.lit(-1)).cast("long")))
    good = {(r.doc_id, r.size) for r in scored.where("predicted = 1").collect()}
    assert some("quality classifier") == sized(*[i for i, r in enumerate(rows) if r[1] is not None and (r[0], len(r[1])) in good])
    assert some("SimHash near-dedup") == sized(0, 3, 6, 7, 8)
    private = stages["PII"](spark, docs, sf_dir).collect()
    assert sorted((str(r.doc_id), r.text is None) for r in private) == sorted((str(r[0]), r[1] is None) for r in rows)
    assert [r.text for r in private if r.doc_id == 8][0].endswith("@mail.invalid") and all(r.n_chars == len(r.text or "") or r.text is None for r in private)
    packed_ = stages["packing"](spark, docs, sf_dir).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in packed_) == sorted((str(r[0]), len((r[1] or "").split())) for r in rows)
