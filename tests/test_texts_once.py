"""Bodies are lowered once for all dictionaries; parsed articles are held in small pieces."""

import pandas as pd
from pyspark.sql import functions as F

from formulake.functions.text import first_term
from formulake.plans.q_joins import dictionary_terms
from formulake.sources import articles as A


def test_a_body_is_lowered_once(spark):
    rows = spark.createDataFrame([(1, "DSPC, dspc and SM-102 in DMG-PEG"), (2, "nothing"), (3, None)], "doc_id int, body string")
    found = dictionary_terms(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(body") == 1 and "Union" not in plan
    got = {(r.doc_id, r.role): (r.term.lower(), r.n) for r in found.collect()}
    assert got[1, "helper"] == ("dspc", 2) and {d for d, _ in got} == {1}
    plan = rows.select(first_term(F.col("body"), ["DSPC", "DOPE"]).alias("t"))
    assert [r.t for r in plan.collect()] == ["DSPC", None, None]


def test_articles_are_parsed_in_pieces():
    xml = pd.Series([f"<article><article-id pub-id-type='pmcid'>PMC{i}</article-id></article>" for i in range(250)] + [None, "<a"])
    pieces = list(A.parsed_articles(iter([xml, xml[:0], xml[:3]])))
    assert max(map(len, pieces)) <= A.PARSED_AT_ONCE and sum(map(len, pieces)) == 255
    assert pd.concat(pieces).pmc_id.tolist()[:250] == [str(i) for i in range(250)]


def test_pieces_keep_their_rows(spark):
    rows = spark.createDataFrame([(i, f"<article><article-title>t{i}</article-title></article>") for i in range(730)], "id int, xml string")
    found = A.parse_article_xml(rows.coalesce(1), "xml")
    assert all(r.title == f"t{r.id}" for r in found.collect()) and found.count() == 730
