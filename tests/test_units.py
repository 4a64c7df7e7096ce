"""Literal cases of the parsing, gate and offset rules."""

import pytest
from pyspark.sql import functions as F

from formulake.functions import ratio as R
from formulake.functions.outcome import as_percent, clean_outcome
from formulake.functions.text import spans
from formulake.operators import anchor as A
from formulake.operators.extract import ratio_mentions
from formulake.sources.files import align_report, canonical_header, classify_encodings, strict_select
from formulake import vocab as V


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,value", [
    ("92.08 ± 2.5", 92.08), ("85-90", 87.5), ("88 (n=3)", 88.0), ("0.94", 94.0), ("n.d.", None),
    ("120", None), ("69-100", 84.5), ("90-120", None), ("1.2.3-4", None), ("", None), (None, None),
])
def test_clean_outcome(spark, text, value):
    got = one(spark, text, clean_outcome)
    assert got == value if value is None else abs(got - value) < 1e-9


def test_outcome_range_rules(spark):
    assert one(spark, 0.0, as_percent, "double") is None
    assert one(spark, 0.0, lambda c: as_percent(c, keep_zero=True), "double") == 0.0
    assert one(spark, 1.0, as_percent, "double") == 100.0


@pytest.mark.parametrize("text,shares", [
    ("50:10:38.5:1.5", (50, 10, 38.5, 1.5)), ("60:38.5:1.5", (60, 0, 38.5, 1.5)),
    ("50/10/38.5/1.5", (50, 10, 38.5, 1.5)), ("n.r.", None), ("", None), ("1:2:3:4:5", None),
])
def test_components(spark, text, shares):
    row = one(spark, text, R.components)
    got = [row[c] for c in R.COMPONENTS]
    assert got == ([None] * 4 if shares is None else pytest.approx(shares))


def test_relative_ratios_are_equal(spark):
    a, b = (one(spark, t, R.components) for t in ("50:10:38.5:1.5", "10:2:7.7:0.3"))
    assert [a[c] for c in R.COMPONENTS] == pytest.approx([b[c] for c in R.COMPONENTS])


def test_ratio_key_ignores_order(spark):
    assert one(spark, "50:10:38.5:1.5", R.ratio_key) == one(spark, "50.0:38.5:10:1.5", R.ratio_key)


def test_ratio_reduce(spark):
    kept = one(spark, "42:10:8:38:2", R.reduce_ratio)
    assert kept["ratio"] == "42:10:8:38" and kept["note"] and kept["reason"] is None
    lost = one(spark, "40:20:20:10:30", R.reduce_ratio)
    assert lost["ratio"] is None and lost["reason"] == "irreducible ratio of 5 parts"


def test_ratio_token_keeps_digits_before_a_full_stop(spark):
    got = one(spark, "mixed at 50:1.5:10:38.5. T cells", lambda c: spans(c, V.RATIO_TOKEN))
    assert [(s["start"], s["hit"]) for s in got] == [(9, "50:1.5:10:38.5")]


def test_mentions_read_the_whole_text(spark):
    text = "filler é🦆 " * 20000 + "ratio 50:10:38.5:1.5 here"
    rows = ratio_mentions(spark.createDataFrame([(1, text)], "doc_id long, body string"), "doc_id", "body")
    row = rows.first()
    assert row["ratio"] == "50:10:38.5:1.5" and row["start"] == text.index("50:10")


@pytest.mark.parametrize("resid,shrunk,grade", [
    ([9.0], 6.0, "medium"), ([4.0, 8.0], 4.363636, "medium"), ([1.0, 2.0, 30.0], 1.5, "low"),
    ([1.0, 2.0, 3.0], 1.5, "high"), ([None], 0.0, "none"),
])
def test_study_offsets(spark, resid, shrunk, grade):
    df = spark.createDataFrame([("s", r) for r in resid], "study string, r double")
    row = A.study_offsets(df, "study", "r").first()
    assert row["shrunk"] == pytest.approx(shrunk, abs=1e-6) and row["grade"] == grade


@pytest.mark.parametrize("pred,off,ref,want", [(90.0, 10.0, 80.0, 95.0), (40.0, -10.0, 80.0, 35.0)])
def test_headroom(spark, pred, off, ref, want):
    got = one(spark, pred, lambda p: A.headroom(p, F.lit(off), F.lit(ref)), "double")
    assert got == pytest.approx(want)


def test_headroom_keeps_ranks(spark):
    df = spark.range(0, 101).select(F.col("id").cast("double").alias("p"))
    rows = df.select("p", A.headroom(F.col("p"), F.lit(30.0), F.lit(80.0)).alias("a")).orderBy("p").collect()
    moved = [r["a"] for r in rows]
    assert moved == sorted(moved) and max(moved) <= 100


def test_clip(spark):
    assert one(spark, 92.0, lambda p: A.clipped(p, F.lit(12.0)), "double") == 100.0


def test_headers():
    assert canonical_header(" Lipid Ratio ") == "lipid_molar_ratio"
    assert canonical_header("EE (%)") == "encapsulation_efficiency_percent_std_num"
    assert canonical_header("comment") is None
    assert align_report(["DOI", "x"]) == [("DOI", "reference_doi")]


def test_strict_schema_names_missing(spark):
    with pytest.raises(ValueError, match="missing columns: \\['b'\\]"):
        strict_select(spark.range(1).toDF("a"), ["a", "b"])


def test_encodings_are_told_apart(spark, tmp_path):
    for name, encoding in (("u", "utf-8"), ("k", "cp949"), ("l", "latin-1")):
        text = "id,t\n1,한글\n" if name != "l" else "id,t\n1,é à ± 2\n"
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    rows = classify_encodings(spark, [str(tmp_path)]).collect()
    got = {r["path"].rsplit("/", 1)[-1]: r["encoding"] for r in rows}
    assert got == {"u.csv": "UTF-8", "k.csv": "x-windows-949", "l.csv": "ISO-8859-1"}


JATS = """<article><front><article-meta>
<article-id pub-id-type="pmcid">PMC12</article-id><article-id pub-id-type="doi"> 10.1/x </article-id>
<title-group><article-title>A <italic>good</italic> title</article-title></title-group></article-meta></front>
<body><sec><title>One</title><p>first <italic>two</italic> three</p><sec><title>Deep</title><p>inner</p></sec></sec>
<fig id="f"><caption><p>A figure.</p></caption></fig></body>
<floats-group><table-wrap><caption><p>A table</p></caption><table><thead><tr><th>a</th><th>b</th></tr></thead>
<tbody><tr><td>1</td><td><bold>2</bold>x</td></tr></tbody></table></table-wrap></floats-group></article>"""


def test_journal_articles(spark, tmp_path):
    from formulake.sources import articles as A

    (tmp_path / "set.xml").write_text(f"<?xml version='1.0'?><set>{JATS}\n{JATS.replace('PMC12', 'PMC13')}</set>")
    rows = {r.pmc_id: r for r in A.read_article_xml(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["12", "13"]
    one = rows["12"]
    assert (one.doi, one.title) == ("10.1/x", "A good title")
    assert [(s.title, s.text) for s in one.sections] == [
        ("One", "One first two three Deep inner"), ("Deep", "Deep inner")]
    assert one.body == "One first two three Deep inner A figure." and one.figures == ["A figure."]
    assert one.tables[0].caption == "A table" and one.tables[0].rows == [["a", "b"], ["1", "2x"]]
    broken = A.parse_article_xml(spark.createDataFrame([(1, "<article><p>"), (2, None)], "k int, xml string"), "xml")
    assert [r.title for r in broken.orderBy("k").collect()] == [None, None]
    cells = A.table_cells(A.read_article_xml(spark, str(tmp_path)).withColumnRenamed("pmc_id", "doc_id"))
    assert cells.count() == 8


def test_csv_as_people_write_it(spark, tmp_path):
    from pyspark.sql import types as T

    from formulake.sources import files as S

    (tmp_path / "a.csv").write_text('k,t\n1,"says ""hi"", twice"\n2,"two\nlines"\nx,bad\n')
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", T.StringType())])
    rows = S.read_csv_any(spark, [str(tmp_path)], schema, keep_broken=True).collect()
    assert [(r.k, r.t) for r in rows][:2] == [(1, 'says "hi", twice'), (2, "two\nlines")]
    assert len(rows) == 3 and rows[2]._corrupt_record == "x,bad"
    out = str(tmp_path / "out")
    S.export_csv(spark.createDataFrame([(1, 'a "b"\nc')], "k int, t string"), out)
    assert spark.read.options(**S.CSV).csv(out).first().t == 'a "b"\nc'
