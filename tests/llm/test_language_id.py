"""Language identification: the mixture against plain Python, held-out accuracy, mixed texts, odd rows."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from galegrid.llm import language_id as li
from galegrid.llm.common import read_documents

FR, DE = "le chat et la souris dans la maison avec tout le monde ", "der hund und die katze in dem haus mit allen leuten "


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, score string, langs string")


def learnt(spark):
    return docs_of(spark, [(FR * 20, "fr"), (DE * 20, "de")] * 20)


def test_grams_of_cut_texts(monkeypatch):
    """Each letter once with its neighbours, wherever a text is cut."""
    texts = ["Ab, c", "", "x", "éa" * 30, "1 2", " lead", "trail "]
    whole = [x.tolist() for x in li.grams(texts, 16)]
    monkeypatch.setattr(li, "BLOCK_CHARS", 4)
    assert [x.tolist() for x in li.grams(texts, 16)] == whole
    letters = Counter()
    for t, n in zip(whole[0], whole[2], strict=True):
        letters[t] += n
    assert letters == {i: sum(c.isalpha() for c in t) for i, t in enumerate(texts) if any(c.isalpha() for c in t)}


def test_shares_equal_plain_python():
    rng = np.random.default_rng(3)
    chance, count, first = rng.random((9, 3)), np.array([1, 2, 3, 1, 1, 5, 2, 1, 4]), np.array([0, 4])
    share, likely = li.shares(chance, count, first, 6)
    for k, (a, b) in enumerate([(0, 4), (4, 9)]):
        now = [1 / 3] * 3
        for _ in range(6):
            new = [0.0] * 3
            for g in range(a, b):
                s = sum(now[j] * chance[g, j] for j in range(3))
                for j in range(3):
                    new[j] += count[g] * now[j] * chance[g, j] / s
            now = [x / sum(count[a:b]) for x in new]
        assert np.allclose(share[k], now)
        assert math.isclose(likely[k], sum(count[g] * math.log(sum(now[j] * chance[g, j] for j in range(3))) for g in range(a, b)))


def test_held_out_accuracy(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    rows = li.identify_languages(docs).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.truth for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures(spark):
    fitted = learnt(spark)
    langs, table = li.fit_languages(fitted)
    found = {i: held for i, held, _ in li.mixtures([FR * 6, FR * 6 + DE * 2, DE * 5], table, li.Settings())}
    named = {i: [(langs[k], round(v, 1)) for k, v in held] for i, held in found.items()}
    assert named == {0: [("fr", 1.0)], 1: [("fr", 0.8), ("de", 0.2)], 2: [("de", 1.0)]}


def test_held_out_labels_are_not_learnt(spark):
    rows = [(FR, "fr")] * 40 + [(DE, "de")] * 40
    docs = docs_of(spark, rows)
    swapped = docs.withColumn("lang", F.when(li.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(li.fit_languages(swapped)[0]) == ["de", "fr"]
    assert [r[:4] for r in map(tuple, li.identify_languages(swapped).orderBy("doc_id").collect())] == [r[:4] for r in map(tuple, li.identify_languages(docs).orderBy("doc_id").collect())]


def test_odd_rows(spark, odd, none):
    rows = li.identify_languages(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].lang_pred for i in (4, 5, 10)} == {"und"} and by_id[4].score == 0.0 and by_id[4].langs == []
    assert by_id[8].lang_pred == "en" and not by_id[None].held_out
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1
    assert li.identify_languages(none).collect() == []
    unlabelled = docs_of(spark, [(FR, None), ("x", None)])
    assert {r.lang_pred for r in li.identify_languages(unlabelled).collect()} == {"und"}
