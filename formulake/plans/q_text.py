"""Mentions, candidates, pairing, verification and audit over article texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions.numbers import r6
from formulake.functions.text import cargo_from_words
from formulake.functions.ratio import content_key
from formulake.operators import extract as X
from formulake.operators import gate as G
from formulake.operators import joins as J
from formulake.plans import sqlviews as Q
from formulake.plans import views as P
from formulake.plans.q_clean import sql_clean_text, sql_malformed, sql_reduce, sql_spans, sql_warnings
from formulake.plans.q_joins import (
    EE_SQL, RUN_SQL, ROLE_WORDS, sql_cascade, sql_dictionary_name, sql_map, sql_ratio_mentions,
)
from formulake.plans.q_stats import rounded
from formulake.plans.registry import query
from formulake.plans.sqlviews import lit, sql
from formulake.plans.sqlviews import r6 as q6
from formulake.session import materialise


def sql_number(e: str, pattern: str) -> str:
    return f"try_cast(nullif(regexp_extract({e}, {lit(pattern)}, 1), '') as double)"


@query("mention_ratio", sql("articles", f"""
SELECT doc_id, start, {Q.ratio_text('vals')} AS ratio, {q6('list_sum(vals)')} AS total FROM ratio_runs""",
    sql_ratio_mentions()))
def q_mention_ratio(spark, sf_dir):
    out = X.ratio_mentions(P.articles(spark, sf_dir), "doc_id", "body")
    return rounded(out.select("doc_id", "start", "ratio", "total"), "total")


STRICT_PATTERNS = [V.OUTCOME_MENTION, V.OUTCOME_MENTION_VERB, V.OUTCOME_MENTION_SHORT]


def sql_window(s: str, before: int, after: int) -> str:
    left = f"greatest(0, {s}.start - {before})"
    return f"substring(body, {left} + 1, {s}.start + length({s}.hit) + {after} - {left})"


STRICT_SQL = "strict0 AS (" + " UNION ALL ".join(
    f"SELECT doc_id, body, {i} AS pattern, unnest({sql_spans('body', lit(p))}) AS s FROM articles"
    for i, p in enumerate(STRICT_PATTERNS)) + f"""),
strict AS (SELECT doc_id, pattern, s.start AS start, ee, regexp_matches(near, {lit(V.OUTCOME_BOUND)}) AS approx, around
  FROM (SELECT *, CASE pattern """ + " ".join(
    f"WHEN {i} THEN {sql_number('s.hit', p)}" for i, p in enumerate(STRICT_PATTERNS)) + f""" END AS ee,
          {sql_window('s', 90, 90)} AS near, {sql_window('s', 130, 130)} AS around,
          concat(s.hit, ' ', substring(body, greatest(0, s.start - 160) + 1, s.start - greatest(0, s.start - 160))) AS lead
        FROM strict0)
  WHERE ee BETWEEN 20 AND 100 AND NOT regexp_matches(around, {lit(V.OUTCOME_GENERAL)})
    AND regexp_matches(near, {lit(V.OUTCOME_NEAR)}) AND NOT regexp_matches(lead, {lit(V.OUTCOME_FORMULA)}))"""


@query("mention_outcome", sql("articles", "SELECT doc_id, pattern, start, ee, approx FROM strict", STRICT_SQL))
def q_mention_outcome(spark, sf_dir):
    return X.strict_outcomes(P.articles(spark, sf_dir), "doc_id", "body")


@query("mention_process", sql("articles", "SELECT doc_id, " + ", ".join(
    f"{sql_number('body', p)} AS {n}" for n, p in V.PROCESS_PATTERNS.items()) + " FROM articles"))
def q_mention_process(spark, sf_dir):
    return P.articles(spark, sf_dir).select("doc_id", *X.process_values(F.col("body")))


_DOIS = (f"list_transform(regexp_extract_all(body, {lit(V.DOI_PATTERN)}, 1), "
         f"lambda d: regexp_replace(d, '[.,);\\]]+$', ''))")
META_SQL = f"""
meta AS (SELECT doc_id, coalesce(d[1], '') AS doi, upper(regexp_extract(body, {lit(V.PMCID_PATTERN)}, 1)) AS pmcid,
  array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ' ') AS doi_alternatives,
  coalesce(list_filter(list_filter(list_transform(string_split(body, chr(10)), lambda t: {sql_clean_text('t')}),
    lambda t: t <> ''), lambda t: length(t) >= 20 AND NOT regexp_matches(lower(t), 'abstract|doi|copyright'))[1], '') AS title
  FROM (SELECT doc_id, body, {_DOIS} AS d FROM articles))"""


@query("doc_metadata", sql("articles", "SELECT doc_id, doi, doi_alternatives, pmcid, title FROM meta", META_SQL))
def q_doc_metadata(spark, sf_dir):
    return X.doc_metadata(P.articles(spark, sf_dir), "doc_id", "body")


def sql_first_pos(low: str, names: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(instr({low}, {lit(n.lower())}), 0)" for n in names) + ")"


def sql_order(low: str) -> str:
    roles = [("ionizable", V.IONIZABLE), ("helper", V.HELPER), ("peg", V.PEG_LIPID),
             ("cholesterol", V.CHOLESTEROL)]
    items = ", ".join(
        f"{{'at': {sql_first_pos(low, names)}, 'tie': {i}, 'role': '{r}'}}" for i, (r, names) in enumerate(roles))
    return (f"list_transform(list_sort(list_filter([{items}], lambda s: s.at IS NOT NULL)), "
            f"lambda s: s.role)")


@query("component_order", sql("articles", f"""
SELECT doc_id, array_to_string({sql_order('lower(body)')}, '>') AS roles FROM articles"""))
def q_component_order(spark, sf_dir):
    from formulake.functions.text import component_order

    return P.articles(spark, sf_dir).select(
        "doc_id", F.array_join(component_order(F.col("body")), ">").alias("roles"))


def sql_longest(low: str, names: list[str]) -> str:
    ordered = sorted(names, key=lambda w: -len(w))
    return "coalesce(" + ", ".join(
        f"CASE WHEN contains({low}, {lit(w.lower())}) THEN {lit(w)} END" for w in ordered) + ")"


def sql_cargo_words(low: str) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({low}, {lit(w)})" for w in words) + f" THEN '{c}'"
        for c, words in V.CARGO_WORDS.items()) + " END"


def sql_local(ctx: str) -> str:
    """List of {start, stop, ee} of the outcome mentions of a short text."""
    parts = [
        f"list_transform({sql_spans(ctx, lit(p))}, lambda z: {{'start': z.start, 'stop': z.start + length(z.hit), "
        f"'ee': {sql_number('z.hit', p)}}})" for p in (V.OUTCOME_MENTION, V.OUTCOME_MENTION_BACK)]
    return f"list_filter(list_concat({', '.join(parts)}), lambda m: m.ee > 0 AND m.ee <= 100)"


def sql_approx(ctx: str, m: str) -> str:
    """Whether a bounding word stands within 90 characters of a mention."""
    left = f"greatest(0, {m}.start - 90)"
    return (f"coalesce(regexp_matches(substring({ctx}, {left} + 1, {m}.stop + 90 - {left}), "
            f"{lit(V.OUTCOME_BOUND)}), false)")


def sql_page(pos: str) -> str:
    """Page of a position: pages are the lines of a body."""
    return f"1 + length(substring(body, 1, {pos})) - length(replace(substring(body, 1, {pos}), chr(10), ''))"


_VALS = "list_transform(string_split_regex(s.hit, '\\s*[:/;,|-]\\s*'), lambda v: cast(v as double))"
CAND_SQL = f"""
cand_text AS (
  SELECT doc_id, pos, raw, vals, context, 'text' AS source, m.ee AS ee, {sql_approx('context', 'm')} AS approx
  FROM (SELECT *, list_sort(list_transform({sql_local('context')}, lambda m, i: {{'d': abs((m.start + m.stop) / 2
      - length(context) // 2), 'i': i, 'ee': m.ee, 'start': m.start, 'stop': m.stop}}))[1] AS m
  FROM (SELECT doc_id, s.start AS pos, s.hit AS raw, {_VALS} AS vals, {sql_clean_text(sql_window('s', 500, 500))} AS context
        FROM (SELECT doc_id, body, unnest({sql_spans('body', RUN_SQL)}) AS s FROM articles))
  WHERE len(vals) = 4)),
figs AS (SELECT doc_id, body, {sql_spans('body', lit(V.FIGURE_MARK))} AS m FROM articles),
caps AS (SELECT doc_id, c.start AS cat, substring(body, c.start + 1,
           coalesce(m[i + 1].start, length(body)) - c.start) AS chunk
  FROM (SELECT doc_id, body, m, unnest(m) AS c, unnest(range(1, len(m) + 1)) AS i FROM figs)),
cand_caption AS (
  SELECT doc_id, cat + s.start AS pos, s.hit AS raw, {_VALS} AS vals, {sql_clean_text('chunk')} AS context, 'caption' AS source,
    m.ee AS ee, {sql_approx('chunk', 'm')} AS approx
  FROM (SELECT *, {sql_local('chunk')}[1] AS m, unnest({sql_spans('chunk', RUN_SQL)}) AS s FROM caps)
  WHERE len({_VALS}) = 4),
table_lines AS (SELECT doc_id, tbl_no, row_no, string_agg({sql_clean_text('cell')}, ' | ' ORDER BY col_no) AS context
  FROM cells GROUP BY 1, 2, 3),
cand_table AS (
  SELECT doc_id, row_no * 1000 + s.start AS pos, s.hit AS raw, {_VALS} AS vals, context, 'table' AS source,
    m.ee AS ee, {sql_approx('context', 'm')} AS approx
  FROM (SELECT *, {sql_local('context')}[1] AS m, unnest({sql_spans('context', RUN_SQL)}) AS s FROM table_lines)
  WHERE len({_VALS}) = 4),
cand AS (SELECT doc_id, pos, raw, vals, context, ee, approx, source FROM cand_text
  UNION ALL SELECT doc_id, pos, raw, vals, context, ee, approx, source FROM cand_caption
  UNION ALL SELECT doc_id, pos, raw, vals, context, ee, approx, source FROM cand_table),
scored AS (
  SELECT *, {sql_warnings('ratio')} AS warnings, round(least(0.99::double, CASE source """ + " ".join(
    f"WHEN '{s}' THEN {b}" for s, b in V.SCORE_BASE.items()) + """ END
      + CASE WHEN ee IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN ionizable IS NOT NULL THEN 0.1 ELSE 0 END
      + CASE WHEN helper IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN peg IS NOT NULL THEN 0.05 ELSE 0 END
      + CASE WHEN order_detected THEN 0.1 ELSE 0 END) + 1e-9, 3) AS score
  FROM (SELECT *, len(ord) = 4 AS order_detected, """ + Q.ratio_text(
    "(CASE WHEN len(ord) = 4 THEN [" + ", ".join(f"vals[list_position(ord, '{r}')]" for r in V.ROLES)
    + "] ELSE vals END)") + f""" AS ratio
    FROM (SELECT *, list_sum(vals) AS total, {sql_order('lower(context)')} AS ord,
            {sql_longest('lower(context)', V.IONIZABLE)} AS ionizable, {sql_longest('lower(context)', V.HELPER)} AS helper,
            {sql_longest('lower(context)', V.PEG_LIPID)} AS peg, {sql_cargo_words('lower(context)')} AS cargo, """ + ", ".join(
    f"{sql_number('context', p)} AS {n}" for n, p in V.PROCESS_PATTERNS.items()) + """ FROM cand))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, (ee IS NOT NULL) DESC, (source = 'table') DESC,
      CASE source WHEN 'table' THEN 1 WHEN 'text' THEN 2 ELSE 3 END, pos) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ratio, ee, ionizable ORDER BY score DESC, (ee IS NOT NULL) DESC,
      (source = 'table') DESC, CASE source WHEN 'table' THEN 1 WHEN 'text' THEN 2 ELSE 3 END, pos) AS rn FROM scored)
  WHERE rn = 1)"""
PAGED_SQL = f"""
paged AS (SELECT ranked.*, CASE WHEN source <> 'table' THEN {sql_page('pos')} END AS page
  FROM ranked JOIN articles USING (doc_id))"""


def candidates(spark, sf_dir):
    arts, cells = P.articles(spark, sf_dir), P.cells(spark, sf_dir)
    cols = ["doc_id", "pos", "raw", "vals", "context", "ee", "approx", "source"]
    return (
        X.text_candidates(arts, "doc_id", "body").select(*cols)
        .unionByName(X.caption_candidates(arts, "doc_id", "body").select(*cols))
        .unionByName(X.table_line_candidates(cells).select(*cols)))


@query("caption_mentions", sql("articles cells", """
SELECT doc_id, pos, raw, ee FROM cand_caption""", CAND_SQL))
def q_caption_mentions(spark, sf_dir):
    return X.caption_candidates(P.articles(spark, sf_dir), "doc_id", "body").select(
        "doc_id", "pos", "raw", "ee")


@query("union_candidates", sql("articles cells", """
SELECT doc_id, source, pos, raw, ee, md5(context) AS context FROM cand""", CAND_SQL))
def q_union_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "doc_id", "source", "pos", "raw", "ee", F.md5("context").alias("context"))


@query("candidate_score", sql("articles cells", """
SELECT doc_id, source, pos, ratio, total, ee, ionizable, helper, peg, cargo, np, ph, size, pdi, zeta,
       order_detected, warnings, score FROM scored""", CAND_SQL))
def q_candidate_score(spark, sf_dir):
    return X.score_candidates(candidates(spark, sf_dir)).select(
        "doc_id", "source", "pos", "ratio", "total", "ee", "ionizable", "helper", "peg", "cargo", "np",
        "ph", "size", "pdi", "zeta", "order_detected", "warnings", "score")


def ranked(spark, sf_dir):
    return X.rank_candidates(X.score_candidates(candidates(spark, sf_dir)))


def starts(spark, sf_dir):
    """Pages are the lines of a body, as in ``scan_page_text``."""
    return X.page_starts(P.articles(spark, sf_dir), "doc_id", "body")


def paged(spark, sf_dir):
    return X.paged(ranked(spark, sf_dir), starts(spark, sf_dir))


@query("candidate_rank", sql("articles cells", """
SELECT doc_id, rank, source, pos, ratio, ee, ionizable, score FROM ranked""", CAND_SQL))
def q_candidate_rank(spark, sf_dir):
    return ranked(spark, sf_dir).select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), "source", "pos", "ratio", "ee", "ionizable",
        "score")


@query("top_candidates", sql("articles cells", """
SELECT doc_id, source, pos, ratio, ee, score FROM scored
ORDER BY score DESC, (ee IS NOT NULL) DESC, doc_id, source, pos LIMIT 50""", CAND_SQL))
def q_top_candidates(spark, sf_dir):
    out = X.top_candidates(X.score_candidates(candidates(spark, sf_dir)), 50)
    return out.select("doc_id", "source", "pos", "ratio", "ee", "score")


@query("candidate_summary", sql("articles cells", """
SELECT doc_id, page, ratio, total, ee, ionizable, helper, peg, score, rank FROM paged""", CAND_SQL, PAGED_SQL))
def q_candidate_summary(spark, sf_dir):
    out = X.candidate_summary(paged(spark, sf_dir))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("draft_rows", sql("articles cells", f"""
SELECT doc_id, doi AS reference_doi, ratio AS lipid_molar_ratio, coalesce(ionizable, '') AS ionizable_lipid_name,
  ee AS encapsulation_efficiency_percent_std_num, np AS np_ratio_std_num, ph AS buffer_ph_std_num,
  coalesce(cargo, doc_cargo) AS cargo_type, coalesce(helper, '') AS helper_lipid_name,
  coalesce(peg, '') AS peg_lipid_name, size AS particle_size_nm_std_num, pdi AS pdi_std_num,
  zeta AS zeta_potential_mv_std_num, NULL::varchar AS ionizable_lipid_smiles, coalesce('page ' || page, 'table') AS source_note, source,
  score AS confidence_score, context AS evidence, title, warnings AS chem_warnings, pmcid, approx AS ee_is_approximate,
  concat_ws(' | ', CASE WHEN raw <> ratio THEN 'ratio rewritten in canonical form' END,
    CASE WHEN NOT order_detected THEN 'component order not certain' END,
    CASE WHEN ee IS NULL THEN 'no outcome in the text' END) AS repair_note
FROM paged JOIN meta USING (doc_id)
JOIN (SELECT doc_id, {sql_cargo_words('lower(body)')} AS doc_cargo FROM articles) USING (doc_id)""",
    CAND_SQL, PAGED_SQL, META_SQL))
def q_draft_rows(spark, sf_dir):
    arts = P.articles(spark, sf_dir)
    meta = X.doc_metadata(arts, "doc_id", "body")
    cargo = arts.select("doc_id", cargo_from_words(F.col("body")).alias("cargo"))
    return X.draft_rows(paged(spark, sf_dir), meta, cargo)


ALL_EE_SQL = f"""
all_ee AS (SELECT doc_id, m.ee AS ee, {sql_page('m.start')} AS page
  FROM (SELECT doc_id, body, unnest({sql_local('body')}) AS m FROM articles))"""


@query("doc_summary", sql("articles cells", """
SELECT doc_id, 1 + length(body) - length(replace(body, chr(10), '')) AS n_pages, coalesce(c, 0) AS n_candidates,
  coalesce(e, 0) AS n_outcomes
FROM articles LEFT JOIN (SELECT doc_id, count(*) AS c FROM ranked GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(DISTINCT (ee, page)) AS e FROM (
  SELECT doc_id, ee, page FROM all_ee UNION ALL SELECT doc_id, ee, page FROM paged WHERE ee IS NOT NULL)
  GROUP BY 1) USING (doc_id)""",
    CAND_SQL, PAGED_SQL, ALL_EE_SQL))
def q_doc_summary(spark, sf_dir):
    """Pages, candidates, and different outcomes by page of every document."""
    arts = P.articles(spark, sf_dir)
    best = materialise(paged(spark, sf_dir).select("doc_id", "ee", "page"), "paged")
    own = arts.select("doc_id", F.explode(X.local_outcomes(F.col("body"))).alias("m")).select(
        "doc_id", "m.ee", F.col("m.start").cast("bigint").alias("at"))
    own = X.with_page(own, starts(spark, sf_dir), "doc_id", "at").drop("at")
    pages = starts(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    values = own.unionByName(best.where("ee is not null")).groupBy("doc_id").agg(
        F.count_distinct(F.struct("ee", "page")).alias("n_outcomes"))
    counts = best.groupBy("doc_id").agg(F.count("*").alias("n_candidates"))
    out = pages.join(counts, "doc_id", "left").join(values, "doc_id", "left")
    zero = F.lit(0)
    return out.select("doc_id", "n_pages", F.coalesce("n_candidates", zero).alias("n_candidates"),
                      F.coalesce("n_outcomes", zero).alias("n_outcomes"))


# ------------------------------------------------------------------ tables and pairing
def sql_role(role: str) -> str:
    hits = " OR ".join(f"contains(h, {lit(k)})" for k in V.TABLE_ROLES[role])
    return f"min(CASE WHEN row_no = 0 AND ({hits}) THEN col_no END) OVER (PARTITION BY doc_id, tbl_no)"


TABLE_SQL = "roles AS (SELECT *, " + ", ".join(
    f"{sql_role(r)} AS c_{r}" for r in V.TABLE_ROLES) + """
  FROM (SELECT *, lower(trim(cell)) AS h FROM cells)),
wide AS (SELECT doc_id, tbl_no, row_no, """ + ", ".join(
    f"max(CASE WHEN col_no = c_{r} THEN cell END) AS {r}" for r in V.TABLE_ROLES) + f"""
  FROM roles WHERE row_no > 0 GROUP BY 1, 2, 3),
table_form AS (SELECT doc_id, tbl_no, row_no,
    {Q.ratio_text("list_transform(string_split(hit, ':'), lambda v: cast(v as double))")} AS ratio,
    {sql_number('ee', V.TABLE_NUMBER)} AS ee, """ + ", ".join(
    f"{sql_number(c, V.TABLE_SIGNED)} AS {c}" for c in ("size", "pdi", "zeta")) + f"""
  FROM (SELECT *, regexp_extract(ratio, {RUN_SQL}) AS hit FROM wide) WHERE hit <> '')"""


@query("table_rows_by_header", sql("cells", """
SELECT *, CASE WHEN coalesce(ee, 0) <> 0 THEN 'high' ELSE 'medium' END AS grade FROM table_form""", TABLE_SQL))
def q_table_rows_by_header(spark, sf_dir):
    return X.table_rows(P.cells(spark, sf_dir))


PAIR_SQL = f"""
runs AS (SELECT doc_id, s.start AS start, {_VALS} AS vals, {sql_window('s', 130, 130)} AS ev
  FROM (SELECT doc_id, body, unnest({sql_spans('body', RUN_SQL)}) AS s FROM articles)),
uniq AS (SELECT doc_id, """ + Q.ratio_text(
    "(CASE WHEN len(ord) = 4 THEN [" + ", ".join(f"vals[list_position(ord, '{r}')]" for r in V.ROLES)
    + "] ELSE vals END)") + f""" AS ratio, max(start) AS start, max_by(ev, start) AS ev
  FROM (SELECT *, {sql_order('lower(ev)')} AS ord FROM runs WHERE len(vals) = 4) GROUP BY 1, 2),
uniq_n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS nr FROM uniq),
vals_e AS (SELECT doc_id, ee, start, approx, around FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ee
  ORDER BY pattern DESC, start DESC) AS rn FROM strict) WHERE rn = 1),
cross1 AS (SELECT u.doc_id, ratio, ee, approx, ev, around, abs(e.start - greatest(0, u.start - 130)) AS gap,
    count(*) OVER (PARTITION BY u.doc_id) AS ne,
    row_number() OVER (PARTITION BY u.doc_id ORDER BY abs(e.start - greatest(0, u.start - 130)), e.start, ee) AS rn
  FROM uniq_n u JOIN vals_e e ON e.doc_id = u.doc_id WHERE nr = 1),
pair_text AS (
  SELECT doc_id, ratio, CASE WHEN ne = 1 OR gap <= 4000 THEN ee END AS ee,
    CASE WHEN ne = 1 OR gap <= 4000 THEN approx ELSE false END AS approx,
    CASE WHEN ne = 1 THEN 'medium' ELSE 'low' END AS grade,
    CASE WHEN ne = 1 OR gap <= 4000 THEN concat(substring(ev, 1, 150), ' -> outcome: ', substring(around, 1, 150))
      ELSE substring(ev, 1, 200) END AS evidence FROM cross1 WHERE rn = 1
  UNION ALL SELECT doc_id, ratio, NULL, false, 'low', substring(ev, 1, 200) FROM uniq_n WHERE doc_id NOT IN (SELECT doc_id FROM cross1)),
pairs AS (
  SELECT doc_id, ratio, ee, false AS approx, CASE WHEN coalesce(ee, 0) <> 0 THEN 'high' ELSE 'medium' END AS grade, '' AS evidence, 'table' AS source
  FROM table_form
  UNION ALL SELECT *, 'text' FROM pair_text WHERE doc_id NOT IN (SELECT doc_id FROM table_form))"""


def paired_rows(spark, sf_dir):
    arts = P.articles(spark, sf_dir)
    ratios = X.ordered_mentions(arts, "doc_id", "body")
    return X.pair_grade(ratios, X.strict_outcomes(arts, "doc_id", "body", evidence=True),
                        X.table_rows(P.cells(spark, sf_dir)))


@query("pair_grade", sql("articles cells", "SELECT doc_id, ratio, ee, approx, grade, evidence, source FROM pairs",
                         STRICT_SQL, TABLE_SQL, PAIR_SQL))
def q_pair_grade(spark, sf_dir):
    return paired_rows(spark, sf_dir)


YIELD_SQL = """
yield AS (SELECT doc_id, coalesce(t, 0) AS n_tables, coalesce(r, 0) AS n_rows, coalesce(u, 0) AS n_usable,
  CASE WHEN coalesce(u, 0) > 0 THEN 'ok' WHEN coalesce(r, 0) > 0 THEN 'ratio_only' ELSE 'none' END AS status
  FROM articles LEFT JOIN (SELECT doc_id, count(*) AS r, count(ee) AS u FROM pairs GROUP BY 1) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(DISTINCT tbl_no) AS t FROM cells GROUP BY 1) USING (doc_id))"""


@query("harvest_yield", sql("articles cells", "SELECT * FROM yield", STRICT_SQL,
                            TABLE_SQL, PAIR_SQL, YIELD_SQL))
def q_harvest_yield(spark, sf_dir):
    return X.harvest_yield(P.articles(spark, sf_dir), paired_rows(spark, sf_dir), P.cells(spark, sf_dir))


@query("harvest_status", sql("articles cells", "SELECT status, count(*) AS n FROM yield GROUP BY 1",
                             STRICT_SQL, TABLE_SQL, PAIR_SQL, YIELD_SQL))
def q_harvest_status(spark, sf_dir):
    out = X.harvest_yield(P.articles(spark, sf_dir), paired_rows(spark, sf_dir), P.cells(spark, sf_dir))
    return out.groupBy("status").agg(F.count("*").alias("n"))


TOKEN_RUN = r"[0-9][0-9.,]*(?:\s*[:/]\s*[0-9][0-9.,]*)+"
TOKEN_PART = "^[0-9]{1,3}([.,][0-9]{1,2})?$"


def sql_token_parts(hit: str) -> str:
    return (f"list_transform(string_split_regex({hit}, '\\s*[:/]\\s*'), "
            f"lambda v: regexp_replace(v, '[.,]$', ''))")


EXCERPT_SQL = f"""
reach AS (
  SELECT doc_id, greatest(0, s.start - 600) AS a, least(length(body), s.start + length(regexp_replace(s.hit, '[.,]$', '')) + 500) AS b
  FROM (SELECT doc_id, body, unnest({sql_spans('body', lit(TOKEN_RUN))}) AS s FROM articles)
  WHERE len({sql_token_parts('s.hit')}) BETWEEN 3 AND 5
    AND len(list_filter({sql_token_parts('s.hit')}, lambda v: NOT regexp_matches(v, '{TOKEN_PART}'))) = 0
  UNION ALL
  SELECT doc_id, greatest(0, s.start - 500), least(length(body), s.start + length(s.hit) + 400)
  FROM (SELECT doc_id, body, unnest({sql_spans('body', lit(V.OUTCOME_ANCHORED))}) AS s FROM articles)),
isles AS (SELECT *, sum(CASE WHEN a <= prev + 80 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, b
    ROWS UNBOUNDED PRECEDING) AS isle
  FROM (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM reach)),
excerpts AS (SELECT doc_id, string_agg(substring(body, a + 1, b - a), chr(10) || '[...]' || chr(10) ORDER BY a) AS excerpt
  FROM (SELECT doc_id, isle, min(a) AS a, max(b) AS b FROM isles GROUP BY 1, 2) JOIN articles USING (doc_id) GROUP BY doc_id)"""


@query("merge_spans", sql("articles", """
SELECT doc_id, length(coalesce(excerpt, '')) AS n_chars, md5(coalesce(excerpt, '')) AS digest
FROM articles LEFT JOIN excerpts USING (doc_id)""", EXCERPT_SQL))
def q_merge_spans(spark, sf_dir):
    out = X.excerpt(P.articles(spark, sf_dir), "doc_id", "body")
    return out.select("doc_id", F.length("excerpt").cast("bigint").alias("n_chars"),
                      F.md5("excerpt").alias("digest"))


@query("excerpt_tables", sql("cells", """
SELECT doc_id, concat(chr(10), '[TABLE] Formulation table', chr(10),
  string_agg(line, chr(10) ORDER BY row_no)) AS tables
FROM (SELECT doc_id, row_no, string_agg(cell, ' | ' ORDER BY col_no) AS line FROM cells GROUP BY 1, 2)
GROUP BY 1"""))
def q_excerpt_tables(spark, sf_dir):
    cells = P.cells(spark, sf_dir)
    captions = cells.select("doc_id", "tbl_no").distinct().withColumn(
        "caption", F.lit("Formulation table"))
    return X.excerpt_tables(cells, captions)


# ------------------------------------------------------------------ verification
def sql_found_number(ee: str) -> str:
    forms = (f"list_distinct([{Q.plain(ee)}, cast(cast(round_even({ee}, 1) as decimal(18,1)) as varchar), "
             f"cast(cast(round_even({ee}, 0) as decimal(18,0)) as varchar)])")
    return (f"len(list_filter({forms}, lambda f: len(list_filter(src_numbers, lambda n: n = f OR "
            f"starts_with(n, f || '.'))) > 0)) > 0")


INDEX_SQL = f"""
src AS (
  SELECT doc_id, list_distinct(regexp_extract_all(body, '[0-9.]+')) AS src_numbers,
    regexp_replace(lower(body), '[- ‐]', '', 'g') AS src_flat,
    list_transform(list_filter(list_transform(regexp_extract_all(body, {lit(TOKEN_RUN)}), lambda h: {sql_token_parts('h')}),
      lambda p: len(p) BETWEEN 2 AND 5 AND len(list_filter(p, lambda v: NOT regexp_matches(v, '{TOKEN_PART}'))) = 0),
      lambda p: list_transform(p, lambda v: cast(replace(v, ',', '.') as double))) AS src_ratios
  FROM articles)"""

_WANT = f"list_transform({Q.colon_parts('ratio')}, lambda x: {Q.num('x')})"
_CONTAINED = ("len(list_filter(list_distinct(want), lambda v: len(list_filter(want, lambda w: w = v)) > "
              "len(list_filter(got, lambda w: w = v)))) = 0")
FOUND_RATIO = (f"(len(want) >= 3 AND len(list_filter(src_ratios, lambda got: list_sort(got) = list_sort(want) OR "
               f"(len(got) > len(want) AND {_CONTAINED}))) > 0)")
_NAME = "lower(trim(coalesce(name, '')))"
FOUND_NAME = (
    f"len(list_filter(list_concat([{_NAME}, regexp_replace({_NAME}, '[- ]', '', 'g')], string_split_regex({_NAME}, '[-\\s]')), "
    f"lambda c: length(c) >= 3 AND contains(src_flat, regexp_replace(c, '[- ‐]', '', 'g')))) > 0")


def sql_gate(src: str) -> str:
    ranges = " ".join(
        f"WHEN NOT ({c} BETWEEN {lo} AND {hi}) THEN '{c} out of range'" for c, (lo, hi) in V.RANGES.items())
    named = f"{_NAME} <> '' AND trim(name) <> '{V.UNNAMED}'"
    return f"""
    SELECT *, CASE WHEN src_flat IS NULL THEN 'no source document' WHEN ee IS NULL THEN 'no outcome' WHEN NOT (ee BETWEEN 0 AND 100) THEN 'outcome out of range'
      WHEN NOT ({sql_found_number('ee')}) THEN 'outcome not in text' WHEN ratio_reason IS NOT NULL THEN ratio_reason
      WHEN bad IS NOT NULL THEN concat('malformed ratio: ', bad) WHEN NOT {FOUND_RATIO} THEN 'ratio not in text'
      WHEN {named} AND {_NAME} IN {Q.inlist(V.NOT_IONIZABLE)} THEN 'not an ionizable name'
      WHEN {named} AND NOT ({FOUND_NAME}) THEN 'name not in text' {ranges} END AS why
    FROM (SELECT *, {sql_malformed('ratio')} AS bad, {_WANT} AS want FROM {src}) LEFT JOIN src USING (doc_id)"""


GATE_SQL = f"""
reduced AS (SELECT * EXCLUDE (r, note, reason) REPLACE (coalesce(r, '') AS ratio), note AS repair_note, reason AS ratio_reason
  FROM (SELECT *, {sql_reduce("replace(ratio, ' ', '')")} FROM claims)),
gated AS ({sql_gate('reduced')})"""


@query("gate_claims", sql("claims articles", "SELECT claim_id, doc_id, ratio, why FROM gated", INDEX_SQL, GATE_SQL))
def q_gate_claims(spark, sf_dir):
    out = G.gate_claims(P.claims(spark, sf_dir), P.articles(spark, sf_dir))
    return out.select("claim_id", "doc_id", "ratio", "why")


@query("acceptance_rate", sql("claims articles", f"""
SELECT cast(count_if(why IS NULL) as bigint) AS n_accepted, cast(count_if(why IS NOT NULL) as bigint) AS n_rejected,
  {q6('avg(cast(why IS NULL as double))')} AS rate, count(DISTINCT doc_id) AS n_documents FROM gated""", INDEX_SQL, GATE_SQL))
def q_acceptance_rate(spark, sf_dir):
    out = G.acceptance(G.gate_claims(P.claims(spark, sf_dir), P.articles(spark, sf_dir)))
    return rounded(out, "rate")


_NULLIFIED = ", ".join(
    f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, (lo, hi) in V.RANGES.items() if c != "ee")
HARVEST_SQL = f"""
harv AS (
  SELECT * REPLACE (nm AS name), CASE WHEN nm = '{V.UNNAMED}' THEN name END AS generic_name,
    CASE WHEN nm = '{V.UNNAMED}' THEN 'low' WHEN approx THEN 'medium' ELSE 'high' END AS grade
  FROM (SELECT reduced.* REPLACE ({_NULLIFIED}), CASE WHEN trim(name) = '' OR lower(trim(name)) IN {Q.inlist(V.GENERIC_NAMES)}
            THEN '{V.UNNAMED}' ELSE trim(name) END AS nm,
          regexp_matches(evidence, {lit(V.APPROXIMATE)}) AS approx, {sql_cascade('cargo_claim', 'a.title', 'body')} AS cargo,
          CASE WHEN doi <> '' THEN doi ELSE concat('PMC', reduced.doc_id) END AS study
        FROM reduced LEFT JOIN articles a ON a.doc_id = reduced.doc_id LEFT JOIN meta ON meta.doc_id = reduced.doc_id))"""
HARVEST_COLS = ["claim_id", "study", "name", "generic_name", "ratio", "ee", "np", "ph", "size", "pdi",
                "zeta", "approx", "cargo", "grade", "repair_note"]


def articles_with_doi(spark, sf_dir):
    arts = P.articles(spark, sf_dir)
    return arts.withColumn("doi", F.regexp_replace(
        F.regexp_extract("body", V.DOI_PATTERN, 1), r"[.,);\]]+$", ""))


@query("to_harvest_schema", sql("claims articles", f"SELECT {', '.join(HARVEST_COLS)} FROM harv",
                                GATE_SQL.split("gated AS")[0].rstrip().rstrip(","), META_SQL, HARVEST_SQL))
def q_to_harvest_schema(spark, sf_dir):
    out = G.to_harvest(P.claims(spark, sf_dir), articles_with_doi(spark, sf_dir))
    return out.select(*HARVEST_COLS)


POLICY_SQL = f"""CASE WHEN name IN ('', '{V.UNNAMED}') THEN 'unnamed' WHEN approx THEN 'approximate outcome'
  WHEN cargo NOT IN {Q.inlist(V.NUCLEIC_CARGO)} THEN concat('not nucleic: ', cargo) END"""


@query("policy_filter", sql("claims articles", f"SELECT claim_id, {POLICY_SQL} AS why FROM harv",
                            GATE_SQL.split("gated AS")[0].rstrip().rstrip(","), META_SQL, HARVEST_SQL))
def q_policy_filter(spark, sf_dir):
    out = G.to_harvest(P.claims(spark, sf_dir), articles_with_doi(spark, sf_dir))
    return out.select("claim_id", G.policy_reason().alias("why"))


JOB_SQL = f"""
hgate AS ({sql_gate('harv')}),
keyed AS (SELECT *, {Q.content_key('study', 'name', 'ratio', 'ee')} AS k,
  CASE WHEN why IS NULL THEN {POLICY_SQL} END AS pol FROM hgate),
firsts AS (SELECT k, min(claim_id) AS f FROM keyed WHERE why IS NULL AND pol IS NULL GROUP BY k),
job AS (SELECT keyed.* REPLACE (CASE WHEN why IS NOT NULL THEN why WHEN claim_id > f THEN 'duplicate' ELSE pol END AS why)
  FROM keyed LEFT JOIN firsts USING (k))"""


@query("harvest_job", sql("claims articles", f"""
SELECT claim_id, study, {sql_dictionary_name('name')} AS name, ratio, ee, cargo,
  coalesce({sql_map(V.PEG_CANON, 'lower(trim(peg_name))')}, trim(peg_name)) AS peg_name, grade, why FROM job""",
    INDEX_SQL, GATE_SQL.split("gated AS")[0].rstrip().rstrip(","), META_SQL, HARVEST_SQL, JOB_SQL))
def q_harvest_job(spark, sf_dir):
    from formulake.functions.text import lookup_map

    out = G.harvest(P.claims(spark, sf_dir), articles_with_doi(spark, sf_dir), "claim_id")
    pegs = lookup_map(V.PEG_CANON)
    return out.select(
        "claim_id", "study", J.dictionary_name(F.col("name")).alias("name"), "ratio", "ee", "cargo",
        F.coalesce(F.try_element_at(pegs, F.lower(F.trim("peg_name"))), F.trim("peg_name")).alias("peg_name"),
        "grade", "why")


KEPT_SQL = f"""
stored_keys AS (SELECT DISTINCT k FROM keyed WHERE doc_id % 3 = 0),
piped AS (SELECT * REPLACE (CASE WHEN why IS NULL AND k IN (SELECT k FROM stored_keys) THEN 'already stored' ELSE why END AS why,
    CASE WHEN why IS NULL AND k NOT IN (SELECT k FROM stored_keys) THEN {POLICY_SQL} END AS pol) FROM keyed),
firsts2 AS (SELECT k, min(claim_id) AS f FROM piped WHERE why IS NULL AND pol IS NULL GROUP BY k)"""


@query("harvest_pipeline", sql("claims articles", """
SELECT claim_id, study, ratio, ee, grade,
  CASE WHEN why IS NOT NULL THEN why WHEN claim_id > f THEN 'duplicate' ELSE pol END AS why
FROM piped LEFT JOIN firsts2 USING (k)""",
    INDEX_SQL, GATE_SQL.split("gated AS")[0].rstrip().rstrip(","), META_SQL, HARVEST_SQL, JOB_SQL, KEPT_SQL))
def q_harvest_pipeline(spark, sf_dir):
    """The harvest against rows that are stored already: those of every third document."""
    arts = articles_with_doi(spark, sf_dir)
    claims = P.claims(spark, sf_dir)
    stored = G.to_harvest(claims.where(F.col("doc_id") % 3 == 0), arts).select(
        content_key(F.col("study"), F.col("name"), F.col("ratio"), F.col("ee")).alias("content_key"))
    out = G.harvest(claims, arts, "claim_id", stored_keys=stored)
    return out.select("claim_id", "study", "ratio", "ee", "grade", "why")


@query("audit_stored_rows", sql("claims articles", f"""
SELECT claim_id, rv AS ratio_verdict, ev AS ee_verdict, nv AS name_verdict,
  CASE WHEN nv = 'no source document' OR nv = 'not_ionizable' OR rv = 'not_found' THEN 'drop'
       WHEN rv = 'wrong_order' OR ev <> 'ok' OR nv <> 'ok' THEN 'fix' ELSE 'keep' END AS overall
FROM (SELECT claim_id, CASE WHEN src_flat IS NULL THEN 'no source document' WHEN len(list_filter(src_ratios, lambda g: g = want)) > 0 THEN 'ok'
        WHEN len(list_filter(src_ratios, lambda g: list_sort(g) = list_sort(want))) > 0 THEN 'wrong_order' ELSE 'not_found' END AS rv,
      CASE WHEN src_flat IS NULL THEN 'no source document' WHEN ee IS NOT NULL AND {sql_found_number('ee')} THEN 'ok' ELSE 'not_found' END AS ev,
      CASE WHEN src_flat IS NULL THEN 'no source document' WHEN {_NAME} IN {Q.inlist(V.NOT_IONIZABLE)} THEN 'not_ionizable' WHEN {FOUND_NAME} THEN 'ok' ELSE 'not_found' END AS nv
  FROM (SELECT *, {_WANT} AS want FROM claims) LEFT JOIN src USING (doc_id))""", INDEX_SQL))
def q_audit_stored_rows(spark, sf_dir):
    out = G.audit(P.claims(spark, sf_dir), P.articles(spark, sf_dir))
    return out.select("claim_id", "ratio_verdict", "ee_verdict", "name_verdict", "overall")
