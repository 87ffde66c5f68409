import corpus_pipeline
from siltstone.llm import decontam, langid
from siltstone.llm.queries import ORACLE, QUERIES
from tests.llm.cases import sample
from tests.llm.test_exact_dedup import _LOW
from tests.llm.test_ngram_join import brute
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = sample(spark, "0.01")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    model = langid.fit(langid.training_rows(docs))
    rows = [(i, t) for i, t in rows if not model.predict(t)[2]]
    docs = corpus_pipeline.language_id(spark, docs, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {i for i, _ in rows}

    best = {}
    for i, t in rows:
        best[t.translate(_LOW)] = max(i, best.get(t.translate(_LOW), i))
    rows = [(i, t) for i, t in rows if best[t.translate(_LOW)] == i]
    docs = corpus_pipeline.distinct_texts(spark, docs, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {i for i, _ in rows}

    stay = {i for i, _, c in brute(rows, 5, 4, 5) if i == c}
    rows = [(i, t) for i, t in rows if i in stay]
    docs = corpus_pipeline.distinct_groups(spark, docs, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {i for i, _ in rows}

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = decontam.brute_force([t for _, t in rows], items)
    rows = [x for x, (n, hit, _) in zip(rows, found, strict=True) if not (any(hit) and 20 * sum(hit) >= n)]
    docs = corpus_pipeline.decontaminated(spark, docs, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {i for i, _ in rows}

    n, least = check_packing(corpus_pipeline.packed(spark, docs, SF).collect(), rows, 4096)
    assert n <= least + 1


def test_odd_documents(spark):
    from pyspark.sql import functions as F

    from tests.llm.cases import clashing

    docs = clashing(spark).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() >= 0


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


def test_decontamination_judges_each_row(spark):
    passage = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    docs = spark.createDataFrame([(None, passage), (7, passage), (7, "plain words of its own"), (None, "other plain words")], "doc_id long, text string")
    left = corpus_pipeline.decontaminated(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.text) for r in left) == [(False, "plain words of its own"), (True, "other plain words")]
