import zlib

from pyspark.sql import functions as F

from siltstone.llm import langid
from siltstone.llm.queries import op2_language_id
from tests.llm.cases import ODD, clashing, empty, sample


def test_held_out_accuracy(spark):
    got = op2_language_id(spark, "/root/testdata/sf0.01")
    truth = sample(spark, "0.01").select("doc_id", "lang", F.col("text").isNull().alias("no_text"))
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(tested) > 100
    right = sum(r.lang == r.lang_pred for r in tested) / len(tested)
    assert right > 0.95, right
    assert sum(r.rejected for r in tested) < 0.05 * len(tested)


def test_odd_rows(spark):
    model = langid.fit(langid.training_rows(sample(spark)))
    assert len(model.langs) == 4 * len(set(model.langs))  # several centroids for each language
    docs = clashing(spark)
    got = {(r.doc_id, r.text): r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(set(ODD))
    for key in ((1, None), (2, ""), (3, "   \n\t "), (9, "1234 5678 !!")):
        assert (got[key].lang_pred, got[key].score, got[key].rejected) == ("und", 0.0, True)
    assert got[5, "plain words only"].lang_pred == got[4, "plain words only"].lang_pred != "und"
    assert langid.predict(empty(spark), model).count() == 0


def test_rejects_what_is_far(spark):
    model = langid.fit(langid.training_rows(sample(spark, "0.01")))
    assert model.predict("东京都是日本的首都，人口众多。" * 100)[2]
    assert not langid.has_letter("½ Ⅷ ² 123 _") and langid.has_letter("é") and langid.has_letter("东")


def test_no_training_rows(spark):
    model = langid.fit(empty(spark).withColumn("lang", F.lit("en")).select("text", "lang"))
    assert model.predict("some words") == ("und", 0.0, True)


def test_long_text_counts_whole():
    import numpy as np

    whole, parts = np.zeros(1 << langid.BITS), np.zeros(1 << langid.BITS)
    text = "abc déf, ghi " * 200
    langid._counts(text, whole)
    chunk, langid._CHUNK = langid._CHUNK, 97
    try:
        langid._counts(text, parts)
    finally:
        langid._CHUNK = chunk
    # runs of other characters across a chunk's edge may count once more
    assert abs(whole - parts).sum() <= 4 * len(text) / 97


def test_copies_do_not_thin_the_sample(spark):
    # one text with 3000 copies in each of 20 languages: all have few distinct texts, so all of them are taken
    train = spark.range(60_000).select(F.concat(F.lit("l"), F.col("id") % 20).alias("lang"), F.concat(F.lit("some words of "), F.sha2((F.col("id") % 20).cast("string"), 256)).alias("text"))
    model = langid.fit(train)
    assert sorted(set(model.langs)) == sorted(f"l{k}" for k in range(20))


def plain_vector(text, idf):
    """The TF-IDF vector, n-gram by n-gram in Python's whole numbers."""
    import math
    import re
    from collections import Counter

    kept = re.sub(" +", " ", "".join(c if c >= "\x80" or "a" <= c <= "z" else " " for c in text.lower()))
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            h = 0
            for c in kept[i : i + n]:
                h = (h * 31 + ord(c) * 0x9E3779B1) % 2**32
            counts[((h ^ (h >> 15)) * 0x85EBCA6B) % 2**32 >> (32 - langid.BITS)] += 1
    v = {k: math.log1p(c) * (idf[k] if idf is not None else 1.0) for k, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {k: x / norm for k, x in v.items()}


def test_vectors_nearest_centroids_and_rejection_by_brute_force(spark):
    import math
    from collections import Counter

    docs = sample(spark)
    train = langid.training_rows(docs)
    model = langid.fit(train)
    texts = [(r.lang, r.text) for r in train.collect()]
    df = Counter(k for _, t in texts for k in plain_vector(t, None))
    want = [math.log((1 + len(texts)) / (1 + df[k])) + 1 if df[k] else 0.0 for k in range(1 << langid.BITS)]
    assert all(math.isclose(a, b, rel_tol=1e-9) or not df[k] for k, (a, b) in enumerate(zip(model.idf.tolist(), want, strict=True)))
    centroids = [{k: x for k, x in enumerate(c.tolist()) if x} for c in model.centroids]

    def near(text):
        v = plain_vector(text, want)
        return [sum(x * c.get(k, 0.0) for k, x in v.items()) for c in centroids]

    # a centroid is the mean direction of the texts that are nearest to it among those of its language, and no farther from any of them than its floor says
    for lang in sorted(set(model.langs)):
        own = [j for j, x in enumerate(model.langs) if x == lang]
        members = {j: [] for j in own}
        for text in sorted({t for x, t in texts if x == lang}):
            cos = near(text)
            best = max(own, key=lambda j: cos[j])
            members[best].append((cos[best], plain_vector(text, want)))
        for j in own:
            if members[j]:
                assert model.floor[j] <= 0.5 * min(c for c, _ in members[j]) + 1e-4
                mean = Counter()
                for _, v in members[j]:
                    mean.update(v)
                norm = math.sqrt(sum(x * x for x in mean.values()))
                assert sum(x / norm * centroids[j].get(k, 0.0) for k, x in mean.items()) > 0.98
    odd = ["x", "zz top", "Ωμέγα και άλφα", "the " * 400, "12 a", "q" * 3000]
    for text in [t for _, t in texts[:60]] + [r.text for r in docs.where(langid.held_out()).collect() if r.text] + odd:
        cos = near(text)
        best = max(range(len(cos)), key=lambda j: cos[j])
        lang, score, rejected = model.predict(text)
        if not langid.has_letter(text):
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        assert math.isclose(score, min(1.0, max(0.0, cos[best])), abs_tol=1e-4)
        assert lang == model.langs[best] or sorted(cos)[-1] - sorted(cos)[-2] < 1e-4
        floor = model.floor[best] * min(1.0, len(text) / langid.FULL) ** 0.5
        assert rejected == (cos[best] < floor) or abs(cos[best] - floor) < 1e-4
