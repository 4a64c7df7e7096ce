import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from formulake.llm import rule_ensemble as R
from formulake.llm.common import read

TREE = """DecisionTreeClassificationModel: uid=dtc_1, depth=2, numNodes=5, numClasses=2, numFeatures=12
  If (feature 0 <= 20.5)
   If (feature 7 <= 1.5E-3)
    Predict: 1.0
   Else (feature 7 > 1.5E-3)
    If (feature 0 <= 3.0)
     Predict: 0.0
    Else (feature 0 > 3.0)
     Predict: 1.0
  Else (feature 0 > 20.5)
   Predict: 0.0
"""


def test_rules_of_a_printed_tree():
    inf = math.inf
    assert R.paths(TREE) == [
        (("n_words", -inf, 20.5),),
        (("n_words", -inf, 20.5), ("symbols", -inf, 1.5e-3)),
        (("n_words", -inf, 20.5), ("symbols", 1.5e-3, inf)),
        (("n_words", -inf, 3.0), ("symbols", 1.5e-3, inf)),
        (("n_words", 3.0, 20.5), ("symbols", 1.5e-3, inf)),
        (("n_words", 20.5, inf),),
    ]
    assert R.as_text(R.paths(TREE)[4]) == "3 < n_words <= 20.5 and 0.0015 < symbols"


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if line.strip(" ")]
    n, chars = len(words), len(text)

    def over(a, b):
        return a / b if b else 0.0

    return {
        "n_words": float(n), "mean_word": over(sum(map(len, words)), n),
        "upper": over(sum(c.isupper() for c in text), chars), "letters": over(sum(c.isalpha() for c in text), chars),
        "digits": over(sum(c.isdigit() for c in text), chars), "stops": over(sum(c in ".,;:" for c in text), chars),
        "calls": over(sum(c in "!?" for c in text), chars),
        "symbols": over(sum(c in "$+<=>^`|~#*%&@/\\_" for c in text), chars),
        "distinct_words": over(len(set(words)), n),
        "repeated_neighbours": over(sum(a == b for a, b in zip(words, words[1:])), n),
        "distinct_lines": over(len(set(lines)), len(lines)), "line_length": chars / (text.count("\n") + 1),
    }


TEXTS = [None, "", " ", "\n\n", "one", "One two two two.\nOne two two two.\n\nThree, four! 12 $ a|b #", "Ä Ö ä ö " * 3000,
         "x" * 100_000]


def test_statistics(spark, docs_of):
    docs = docs_of(list(enumerate(TEXTS)))
    rows = docs.select("doc_id", R.statistics(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for row in rows:
        expected = plain(TEXTS[row.doc_id])
        assert tuple(row.s.asDict()) == R.STATISTICS == tuple(expected)
        for name, value in row.s.asDict().items():
            assert value == pytest.approx(expected[name]), (row.doc_id, name)


def test_compiled_rules(spark, docs_of):
    docs = docs_of(list(enumerate(TEXTS)))
    rules = tuple((rule, 0.5 + i) for i, rule in enumerate(R.paths(TREE)))
    model = R.Ensemble(rules, -0.25)
    for row in docs.select("doc_id", model.score(F.coalesce("text", F.lit(""))).alias("p")).collect():
        own = plain(TEXTS[row.doc_id])
        total = -0.25 + sum(w for rule, w in rules if all(low < own[n] <= high for n, low, high in rule))
        assert row.p == pytest.approx(1 / (1 + math.exp(-total)))
    assert R.keep_good(docs, model, 0.5).columns == docs.columns


@pytest.fixture(scope="module")
def found(spark):
    folder = "/root/testdata/sf0.01"
    return R.scored_documents(read(spark, folder, "documents"), read(spark, folder, "labels")).toPandas()


def test_held_out_accuracy(spark, found):
    labels = read(spark, "/root/testdata/sf0.01", "labels").toPandas()
    both = found.merge(labels, on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    held = both[both.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert (good.predicted == 1).mean() >= 0.98
    assert (bad.predicted == 0).mean() >= 0.9


def test_held_out_labels_teach_nothing(spark, found):
    folder = "/root/testdata/sf0.01"
    labels = read(spark, folder, "labels")
    turned = labels.withColumn("quality", F.when(R.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = R.scored_documents(read(spark, folder, "documents"), turned).toPandas()
    both = found.merge(again, on="doc_id")
    assert (both.score_x == both.score_y).all()


def test_odd_labels_and_tables(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "some text"), (3, "some text"), (None, "no id")])
    kind = "doc_id bigint, quality int, toxic int, text string"
    none = spark.createDataFrame([], kind)
    assert {r.score for r in R.scored_documents(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0, "x") for i in range(100)] + [(None, 0, 0, "x"), (5, None, 0, "x"), (5, 7, 0, "x")], kind)
    rows = R.scored_documents(docs, one).collect()
    assert len(rows) == 5 and {r.predicted for r in rows} == {1} and len({r.score for r in rows}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert R.scored_documents(docs.limit(0), one).collect() == []
    both = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(100)], kind)
    assert len(R.scored_documents(docs, both.where("doc_id > 50")).collect()) == 5  # labels without a document
