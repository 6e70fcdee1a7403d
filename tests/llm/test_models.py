import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from linkquarry.llm import language, quality
from linkquarry.llm.queries import op1_quality_trees, op2_language_mixture


def out_of_sample(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_trees_flatten_to_what_walking_them_gives():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit_trees(x, y, trees=20, depth=3)
    slow = []
    for row in x:
        total = m.base
        for f, c, leaf in zip(m.feature, m.cut, m.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += leaf[node - len(f)]
        slow.append(total)
    assert np.allclose(slow, m.raw(x))
    assert ((m.score(x) >= 0.5) == y).mean() > 0.95


def test_quality_held_out_accuracy(spark, sf):
    got = op1_quality_trees(spark, sf).toPandas()
    assert len(got) == 1000 and (got.held_out == got.doc_id.map(out_of_sample)).all() and got.score.between(0, 1).all()
    both = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    test = both[both.held_out]
    assert (test.predicted == test.quality).mean() > 0.95
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (4, None), (11, 0), (12, 1), (13, 5)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score_quality(odd, model)
    assert "Score" not in got.columns and got.count() == odd.count()
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(none, quality.fit(none, labels)).count() == 0


def test_language_held_out_accuracy(spark, sf):
    got = op2_language_mixture(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98


def test_mixture_shares(spark, docs, sf):
    model = language.fit(docs)
    rows = pd.read_parquet(f"{sf}/documents.parquet")
    rows = rows[rows.text.str.len().between(1500, 4000)]
    a, b = rows[rows.lang == "fr"].text.iloc[0][:1500], rows[rows.lang == "de"].text.iloc[0][:1500]
    names, score, shares, ok = language.infer(model, pa.array([a + " " + b, a, "", None, "1 2 3", "Привет мир как дела сегодня в городе"]))
    de, fr = model.languages.index("de"), model.languages.index("fr")
    assert 0.3 < shares[0][de] < 0.7 and 0.3 < shares[0][fr] < 0.7 and shares[0].sum() > 0.999
    assert names[1] == "fr" and score[1] == 1 and ok[1]
    assert names[2:5] == ["und"] * 3 and not ok[2:].any()


def test_language_odd_rows(spark, odd, none):
    got = language.identify(odd, language.fit(odd)).toPandas()
    assert len(got) == odd.count()
    blank = got.text.isna() | ~got.text.fillna("").str.contains(r"[^\W\d_]", regex=True)
    assert ((got.lang_pred == "und") == blank).all()
    empty = language.fit(none)
    assert language.identify(none, empty).count() == 0
    assert set(language.identify(odd, empty).select("lang_pred").distinct().toPandas().lang_pred) == {"und"}
    assert odd.filter(F.col("doc_id").isNull()).count() == 1
