"""Article XML, page texts and tables given as cells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = (
    "pmc_id string, doi string, title string, sections array<struct<title:string,text:string>>, "
    "body string, tables array<struct<caption:string,rows:array<array<string>>>>, figures array<string>"
)
PARSED_AT_ONCE = 100  # articles whose fields are held at a time
PMC_KINDS = ("pmc", "pmcid", "pmcaid")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def inner_text(node: ElementTree.Element | None) -> str:
    """All text inside an element, inline markup dropped, white space evened out."""
    return "" if node is None else re.sub(r"\s+", " ", "".join(node.itertext())).strip()


def block_text(node: ElementTree.Element | None) -> str:
    """Text of a container whose child elements are blocks of their own."""
    if node is None:
        return ""
    if node.tag in ("p", "title", "td", "th", "caption", "label") or not len(node):
        return inner_text(node)
    return " ".join(filter(None, [(node.text or "").strip(), *(block_text(child) for child in node)]))


def article_of(xml: str | None) -> dict:
    """The fields of one JATS article; all null where the text is no well-formed element."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return dict.fromkeys(["pmc_id", "doi", "title", "sections", "body", "tables", "figures"])
    ids = {(i.get("pub-id-type") or ""): (i.text or "").strip() for i in reversed(root.findall(".//article-id"))}
    pmc = next((ids[k].removeprefix("PMC") for k in PMC_KINDS if k in ids), None)
    sections = [
        {"title": inner_text(s.find("./title")), "text": block_text(s)} for s in root.findall(".//body//sec")
    ]
    tables = [
        {"caption": block_text(t.find(".//caption")), "rows": [
            [inner_text(c) for c in row if c.tag in ("td", "th")] for row in t.findall(".//tr")]}
        for t in root.findall(".//table-wrap")
    ]
    return {
        "pmc_id": pmc, "doi": ids.get("doi"), "title": inner_text(root.find(".//article-title")),
        "sections": sections, "body": block_text(root.find(".//body")), "tables": tables,
        "figures": [block_text(f.find(".//caption")) for f in root.findall(".//fig")],
    }


NAMES = [c.split()[0] for c in ARTICLE.split(", ")]


def parsed_articles(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Articles in pieces, as all fields of a whole batch take many times the memory of its texts."""
    for xml in batches:
        for start in range(0, len(xml), PARSED_AT_ONCE):
            yield pd.DataFrame([article_of(x) for x in xml.iloc[start : start + PARSED_AT_ONCE]], columns=NAMES)


def read_article_xml(spark: SparkSession, path: str) -> DataFrame:
    """Article set files: one row per article element, whatever else is in the file."""
    pieces = spark.read.option("lineSep", "</article>").text(path)
    whole = F.concat(F.regexp_extract("value", r"(?s)(<article[\s>].*)$", 1), F.lit("</article>"))
    return parse_article_xml(pieces.where(F.col("value").rlike(r"<article[\s>]")).select(whole.alias("xml")), "xml")


def parse_article_xml(df: DataFrame, xml: str) -> DataFrame:
    """The other columns and the article of each row: ids, title, sections at any depth, whole
    body, tables of td and th cells, figure captions."""
    parse = F.pandas_udf(parsed_articles, ARTICLE)
    return df.withColumn("_a", parse(F.col(xml))).select(
        *[c for c in df.columns if c != xml], "_a.*")


def table_cells(articles: DataFrame) -> DataFrame:
    """Nested article tables as one row per cell."""
    rows = articles.select("doc_id", F.posexplode("tables").alias("tbl_no", "t")).select(
        "doc_id", "tbl_no", F.posexplode("t.rows").alias("row_no", "r")
    )
    return rows.select("doc_id", "tbl_no", "row_no", F.posexplode("r").alias("col_no", "cell"))


def page_text(df: DataFrame, key: str, text: str, separator: str = "\f") -> DataFrame:
    """One row per page of a text."""
    return df.select(key, F.posexplode(F.split(text, separator, -1)).alias("page", "text"))


def table_records(cells: DataFrame) -> DataFrame:
    """Cells with their column name: row 0 is the header when it reads like one.

    Every row is padded to the widest row of its table; unnamed columns are col_1, col_2, ...
    """
    table, row = ["doc_id", "tbl_no"], ["doc_id", "tbl_no", "row_no"]
    text = F.lower(F.coalesce("cell", F.lit("")))
    head = F.col("row_no") == 0
    shape = cells.groupBy(*table).agg(
        (F.max("col_no") + 1).alias("width"),
        F.sum(F.when(head, F.length(text) + 1)).alias("head_len"),
        F.sum(F.when(head, F.regexp_count(text, F.lit(r"\d")))).alias("digits"),
        F.sum(F.when(head, F.regexp_count(text, F.lit(r"\p{L}")))).alias("letters"),
    ).select(
        *table, "width",
        ((F.col("head_len") - 1 >= 3) & (F.col("digits") <= F.col("letters"))).alias("named"),
    )
    grid = (
        cells.select(*row).distinct().join(shape, table)
        .select(*row, "named", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col_no"))
    )
    full = grid.join(cells, [*row, "col_no"], "left").select(
        *row, "col_no", "named", F.trim(F.coalesce("cell", F.lit(""))).alias("cell")
    )
    names = full.where(F.col("named") & head).select(*table, "col_no", F.col("cell").alias("_name"))
    data = full.where(~(F.col("named") & head)).join(names, [*table, "col_no"], "left")
    column = F.coalesce(
        "_name", F.concat(F.lit("col_"), (F.col("col_no") + 1).cast("string"))
    )
    return data.select(*row, "col_no", column.alias("column"), "cell")
