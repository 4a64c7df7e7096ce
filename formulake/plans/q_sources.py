"""Sources and sinks: files are written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from formulake.plans import views as P
from formulake.plans.registry import query
from formulake.plans.sqlviews import r6, sql
from formulake.session import new_path, tune
from formulake.sources import articles as A
from formulake.sources import files as S

UPLOAD = ["row_id", "study_big", "ratio", "outcome_raw"]


@query("scan_csv_encodings", sql("form", "SELECT row_id, outcome_raw, name_raw FROM form"))
def scan_csv_encodings(spark, sf_dir):
    rows = P.form(spark, sf_dir).select("row_id", "outcome_raw", "name_raw", "order_no")
    tune(spark).conf.set("spark.sql.legacy.javaCharsets", "true")
    folders = []
    for i, encoding in enumerate(S.ENCODINGS):
        folders.append(new_path(spark, f"csv{i}"))
        (rows.where(F.col("order_no") % 3 == i).drop("order_no").write.options(header=True, escape='"')
         .option("encoding", encoding).csv(folders[-1]))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in rows.columns[:3]])
    return S.read_csv_any(spark, folders, schema)


MERGE_SQL = sql("colon", """
SELECT row_id, study_big AS reference_doi, ratio AS lipid_molar_ratio,
       outcome_raw AS encapsulation_efficiency_percent_std_num, source_file
FROM (SELECT *, row_number() OVER (PARTITION BY study_big, ratio, outcome_raw
                                   ORDER BY source_file, row_id) AS rn
      FROM (SELECT *, 'person' || (order_no % 3) AS source_file FROM colon
            UNION ALL SELECT *, 'person2' FROM colon WHERE order_no % 3 = 0 AND line_no = 1))
WHERE rn = 1""")


@query("scan_merge_files", MERGE_SQL)
def scan_merge_files(spark, sf_dir):
    rows = P.colon(P.form(spark, sf_dir))
    headers = [["doi", "ratio", "EE (%)"], ["Reference", "Lipid Ratio", "ee_percent"],
               ["paper", "composition", "Encapsulation"]]
    folders = []
    for i, names in enumerate(headers):
        mine = F.col("order_no") % 3 == i
        if i == 2:
            mine = mine | ((F.col("order_no") % 3 == 0) & (F.col("line_no") == 1))
        folder = f"{new_path(spark, 'upload')}/person{i}"
        rows.where(mine).select(
            "row_id", F.col("study_big").alias(names[0]), F.col("ratio").alias(names[1]),
            F.col("outcome_raw").alias(names[2]),
        ).write.option("header", True).option("escape", '"').csv(folder)
        folders.append(folder)
    keys = ["reference_doi", "lipid_molar_ratio", "encapsulation_efficiency_percent_std_num"]
    return S.merge_files(spark, folders, keys, "row_id")


@query("scan_strict_schema",
       sql("colon", "SELECT row_id, study_big, ratio, outcome_raw FROM colon"))
def scan_strict_schema(spark, sf_dir):
    return S.strict_select(P.colon(P.form(spark, sf_dir)), UPLOAD)


PAYLOAD = T.StructType([
    T.StructField("row_id", T.StringType()), T.StructField("ratio", T.StringType()),
    T.StructField("y10", T.LongType()), T.StructField("np", T.DoubleType()),
])


@query("scan_json_payload",
       sql("colon", "SELECT row_id AS id, row_id, ratio, y10, np FROM colon"))
def scan_json_payload(spark, sf_dir):
    path = new_path(spark, "payload")
    rows = P.colon(P.form(spark, sf_dir)).select("row_id", "ratio", "y10", "np")
    S.to_payload(rows, "row_id").withColumnRenamed("row_id", "id").write.parquet(path)
    return S.expand_payload(spark.read.parquet(path), "payload", PAYLOAD)


@query("scan_json_inferred", sql("colon", "SELECT row_id AS id, row_id, ratio, y10, np FROM colon"))
def scan_json_inferred(spark, sf_dir):
    """Stored JSON documents, some spread over several lines, expanded by the schema they show."""
    path = new_path(spark, "payload")
    rows = P.colon(P.form(spark, sf_dir)).select("row_id", "ratio", "y10", "np")
    stored = S.to_payload(rows, "row_id").withColumn("payload", F.when(
        F.col("row_id").endswith("1"), F.regexp_replace("payload", ",\"", ",\n  \"")).otherwise(F.col("payload")))
    stored.withColumnRenamed("row_id", "id").write.parquet(path)
    stored = spark.read.parquet(path)
    return S.expand_payload(stored, "payload", S.infer_payload_schema(stored, "payload"))


@query("sink_json_payload", sql("colon", "SELECT row_id, ratio, y10, study_big FROM colon"))
def sink_json_payload(spark, sf_dir):
    path = new_path(spark, "payload")
    rows = P.colon(P.form(spark, sf_dir)).select("row_id", "ratio", "y10", "study_big")
    S.to_payload(rows, "row_id").write.parquet(path)
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    return spark.read.parquet(path).select(
        "row_id", field("ratio").alias("ratio"), field("y10").cast("bigint").alias("y10"),
        field("study_big").alias("study_big"),
    )


@query("sink_table_replace",
       sql("store", "SELECT row_id, ratio, y10 FROM store WHERE order_no % 2 = 0"))
def sink_table_replace(spark, sf_dir):
    root = new_path(spark, "table")
    rows = P.store(spark, sf_dir).select("row_id", "ratio", "y10", "order_no")
    S.replace_table(rows, root)
    S.replace_table(S.read_table(spark, root).where(F.col("order_no") % 2 == 0), root)
    return S.read_table(spark, root).drop("order_no")


@query("sink_table_append", sql("store batch", """
SELECT row_id, study_big, ratio FROM store
UNION ALL SELECT row_id, study_big, ratio FROM batch"""))
def sink_table_append(spark, sf_dir):
    path = new_path(spark, "table")
    cols = ["row_id", "study_big", "ratio"]
    S.append_table(P.store(spark, sf_dir).select(*cols), path)
    S.append_table(P.batch(spark, sf_dir).select(*cols), path)
    return spark.read.parquet(path)


@query("scan_lookup_json", sql("lookup", "SELECT name, smiles FROM lookup"))
def scan_lookup_json(spark, sf_dir):
    path = new_path(spark, "lookup")
    pairs = P.lipid_lookup(spark, sf_dir)
    pairs.select(F.to_json(F.create_map("name", "smiles"))).write.text(path)
    return S.read_lookup_json(spark, path)


@query("sink_csv_export", sql("colon", "SELECT row_id, study_big, ratio, outcome_raw FROM colon"))
def sink_csv_export(spark, sf_dir):
    path = new_path(spark, "export")
    S.export_csv(P.colon(P.form(spark, sf_dir)).select(*UPLOAD), path)
    return spark.read.options(**S.CSV).csv(path).select(*UPLOAD)


XML_SQL = sql("articles cells", r"""
SELECT a.doc_id, concat('10.5555/st.', a.doc_id) AS doi, t AS title, cast(3 as bigint) AS n_sections,
       md5(concat('Summary ', t, ' Text ', concat_ws(' ', 'Deep', nullif(x, '')))) AS body_digest,
       coalesce(n_tables, 0) AS n_tables, cells_digest
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(title, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), '\s+', ' ', 'g')) AS t,
             trim(regexp_replace(regexp_replace(body, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), '\s+', ' ', 'g')) AS x
      FROM articles) a LEFT JOIN
     (SELECT doc_id, count(DISTINCT tbl_no) AS n_tables,
             md5(string_agg(trim(regexp_replace(cell, '\s+', ' ', 'g')), '|' ORDER BY tbl_no, row_no, col_no)) AS cells_digest
      FROM cells GROUP BY 1) c
  USING (doc_id)""")


def write_articles_xml(spark, sf_dir) -> str:
    """Articles as XML files, one element per line."""
    arts = P.articles(spark, sf_dir)
    cells = P.cells(spark, sf_dir)

    def esc(c):
        plain = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", " ")
        amp = F.replace(plain, F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    # a table is one formulation table of an article: a handful of rows
    lines = cells.groupBy("doc_id", "tbl_no", "row_no").agg(
        F.array_sort(F.collect_list(F.struct("col_no", "cell"))).alias("cs")
    ).select("doc_id", "tbl_no", "row_no", F.concat(F.lit("<tr>"), F.array_join(F.transform(
        "cs", lambda c: F.concat(
            F.when(F.col("row_no") == 0, "<th>").otherwise("<td>"), F.lit("<bold>"), esc(c["cell"]), F.lit("</bold>"),
            F.when(F.col("row_no") == 0, "</th>").otherwise("</td>"))), ""),
        F.lit("</tr>")).alias("tr"))
    tables = lines.groupBy("doc_id", "tbl_no").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "tr"))).alias("rs")
    ).groupBy("doc_id").agg(F.array_join(F.collect_list(F.concat(
        F.lit("<table-wrap><caption><p>Formulation table</p></caption><table><tbody>"),
        F.array_join(F.col("rs.tr"), ""), F.lit("</tbody></table></table-wrap>"))), "").alias("tables"))
    xml = arts.join(tables, "doc_id", "left").select(F.concat(
        F.lit("<article><front><article-meta><article-id pub-id-type='pmcid'>PMC"), F.col("doc_id").cast("string"),
        F.lit("</article-id><article-id pub-id-type='doi'>10.5555/st."), F.col("doc_id").cast("string"),
        F.lit("</article-id><title-group><article-title>"), esc(F.col("title")),
        F.lit("</article-title></title-group></article-meta></front><body>"),
        F.lit("<sec><title>Summary</title><p>"), esc(F.col("title")), F.lit("</p></sec>"),
        F.lit("<sec><title>Text</title><sec><title>Deep</title><p><italic>"), esc(F.translate("body", "\n\r", "  ")),
        F.lit("</italic></p></sec></sec></body><floats-group>"), F.coalesce("tables", F.lit("")),
        F.lit("</floats-group></article>"),
    ))
    path = new_path(spark, "xml")
    xml.write.text(path)
    return path


@query("scan_article_xml", XML_SQL)
def scan_article_xml(spark, sf_dir):
    arts = A.read_article_xml(spark, write_articles_xml(spark, sf_dir))
    cells = F.flatten(F.flatten(F.transform("tables", lambda t: t["rows"])))
    return arts.select(
        F.col("pmc_id").cast("bigint").alias("doc_id"), "doi", "title", F.size("sections").cast("bigint").alias("n_sections"),
        F.md5("body").alias("body_digest"), F.size("tables").cast("bigint").alias("n_tables"),
        F.when(F.size("tables") > 0, F.md5(F.array_join(cells, "|"))).alias("cells_digest"),
    )


@query("scan_page_text", sql("articles", """
SELECT doc_id, unnest(range(len(p))) AS page, unnest(list_transform(p, lambda x: md5(x))) AS digest
FROM (SELECT doc_id, string_split(body, chr(10)) AS p FROM articles)"""))
def scan_page_text(spark, sf_dir):
    paged = P.articles(spark, sf_dir).withColumn("body", F.translate("body", "\n", "\f"))
    return A.page_text(paged, "doc_id", "body").select(
        "doc_id", F.col("page").cast("bigint").alias("page"), F.md5("text").alias("digest")
    )


CELL_TABLE_SQL = sql("cells", """
SELECT doc_id, tbl_no, row_no, col_no,
       CASE WHEN named THEN h ELSE concat('col_', col_no + 1) END AS "column", cell
FROM (SELECT *, max(CASE WHEN row_no = 0 THEN cell END) OVER (PARTITION BY doc_id, tbl_no, col_no) AS h
      FROM (SELECT *, regexp_matches(hd, '...') AND len(regexp_extract_all(hd, '[0-9]'))
                      <= len(regexp_extract_all(hd, '\\p{L}')) AS named
            FROM (SELECT *, string_agg(CASE WHEN row_no = 0 THEN cell END, ' ')
                         OVER (PARTITION BY doc_id, tbl_no) AS hd FROM cells)))
WHERE NOT (named AND row_no = 0)""")


@query("html_to_text_tables", CELL_TABLE_SQL)
def html_to_text_tables(spark, sf_dir):
    return A.table_records(P.cells(spark, sf_dir))
