"""Column alignment, coercion, features, cleaning, validation and quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions import outcome as O
from formulake.functions import ratio as R
from formulake.functions.numbers import parse_number, r6
from formulake.functions.text import clean_text, spans, window
from formulake.operators import clean as C
from formulake.operators import keys as K
from formulake.plans import sqlviews as Q
from formulake.plans import views as P
from formulake.plans.registry import query
from formulake.plans.sqlviews import sql
from formulake.sources.files import align_columns


def loose(spark, sf_dir):
    """Formulations under the headers people type."""
    return P.form(spark, sf_dir).select(
        F.col("row_id").alias("source_note"), F.col("study_big").alias(" DOI "),
        F.col("ratio_raw").alias("Lipid Ratio"),
        F.when(F.col("line_no") != 3, F.col("outcome_raw")).alias("EE (%)"),
        F.col("y10").cast("string").alias("ee_percent"), F.col("name_raw").alias("Lipid"),
        F.col("cargo_raw").alias("Payload"), F.col("np").alias("N P"), F.col("ph").alias("pH"),
        F.col("size").alias("Diameter"), F.col("pdi").alias("PDI"), F.col("zeta").alias("zeta"),
        F.col("peg_name").alias("peg"), F.lit("x").alias("comment"),
    )


@query("align_columns", sql("form", """
SELECT row_id AS source_note, study_big AS reference_doi, ratio_raw AS lipid_molar_ratio,
       CASE WHEN line_no <> 3 THEN outcome_raw ELSE cast(y10 as varchar) END
         AS encapsulation_efficiency_percent_std_num,
       name_raw AS ionizable_lipid_name, cargo_raw AS cargo_type, np AS np_ratio_std_num,
       ph AS buffer_ph_std_num, size AS particle_size_nm_std_num, pdi AS pdi_std_num,
       zeta AS zeta_potential_mv_std_num, peg_name AS peg_lipid_name, 'x' AS comment
FROM form"""))
def q_align_columns(spark, sf_dir):
    return align_columns(loose(spark, sf_dir))


def canonical(spark, sf_dir):
    """Formulations under canonical names, with structure text where the lookup has one."""
    rows = P.form(spark, sf_dir)
    look = P.lipid_lookup(spark, sf_dir).withColumnRenamed("name", "part_name")
    return rows.join(look, "part_name", "left").select(
        "row_id", F.col("study_big").alias("reference_doi"),
        F.col("ratio_raw").alias("lipid_molar_ratio"),
        F.col("outcome_raw").alias("encapsulation_efficiency_percent_std_num"),
        F.col("name_raw").alias("ionizable_lipid_name"), F.col("peg_name").alias("peg_lipid_name"),
        F.lit("DSPC").alias("helper_lipid_name"), F.col("cargo_raw").alias("cargo_type"),
        F.col("np").alias("np_ratio_std_num"), F.col("ph").alias("buffer_ph_std_num"),
        F.when(F.col("qty") > 47, F.col("np")).alias("mixing_speed"),
        F.when(F.col("qty") <= 2, F.col("size")).alias("particle_size_nm_std_num"),
        F.lit(None).cast("double").alias("pdi_std_num"),
        F.col("smiles").alias("ionizable_lipid_smiles"),
    )


@query("discover_columns", sql("form", """
SELECT * FROM (VALUES
  (1, 'x', 'x', false),
  (2, 'lipid_molar_ratio', 'ratio', true),
  (3, 'encapsulation_efficiency_percent_std_num', 'target', true),
  (4, 'ionizable_lipid_name', 'category',
     (SELECT count(DISTINCT name_raw) BETWEEN 2 AND 40 FROM form)),
  (5, 'peg_lipid_name', 'category', (SELECT count(DISTINCT peg_name) BETWEEN 2 AND 40 FROM form)),
  (6, 'helper_lipid_name', 'category', false),
  (7, 'cargo_type', 'category', (SELECT count(DISTINCT cargo_raw) BETWEEN 2 AND 40 FROM form)),
  (8, 'np_ratio_std_num', 'process', true),
  (9, 'buffer_ph_std_num', 'process', true),
  (10, 'mixing_speed', 'process',
     (SELECT avg(cast(qty > 47 as integer)) > 0.1 FROM form)),
  (11, 'particle_size_nm_std_num', 'measured', (SELECT count_if(qty <= 2) > 0 FROM form)),
  (12, 'pdi_std_num', 'measured', false),
  (13, 'ionizable_lipid_smiles', 'smiles', true)
) t(position, "column", role, keep) WHERE keep""").replace("SELECT * FROM (VALUES",
      "SELECT cast(position as bigint) AS position, \"column\", role FROM (VALUES"))
def q_discover_columns(spark, sf_dir):
    return C.discover_columns(canonical(spark, sf_dir))


@query("discover_group_key", sql("form", """
SELECT 'citation' AS key_column, true AS found, count(DISTINCT study_big) AS n_studies FROM form"""))
def q_discover_group_key(spark, sf_dir):
    rows = P.form(spark, sf_dir).select(
        F.when(F.col("order_no") % 3 == 0, F.col("study_small")).alias("doi"),
        F.upper("study_big").alias("citation"), F.col("part_name").alias("study_note"),
    )
    return C.discover_group_key(rows)


@query("coerce_numeric",
       sql("form", f"SELECT row_id, {Q.num('outcome_raw')} AS value FROM form"))
def q_coerce_numeric(spark, sf_dir):
    return P.form(spark, sf_dir).select(
        "row_id", parse_number(F.col("outcome_raw")).alias("value"))


@query("study_defaults", sql("form", """
SELECT row_id, study, coalesce(nullif(cargo_raw, ''), cargo) AS cargo_raw,
       coalesce(nullif(np_text, ''), np0) AS np_text,
       CASE WHEN study <> '' THEN 'ok' ELSE 'no study id' END AS status
FROM (SELECT row_id, CASE WHEN order_no % 13 = 0 THEN '' ELSE study_big END AS study, cargo_raw,
             CASE WHEN line_no = 2 THEN '' ELSE cast(line_no as varchar) END AS np_text FROM form)
LEFT JOIN (SELECT concat('10.1000/s', s_suppkey) AS study,
                  CASE WHEN s_suppkey % 2 = 0 THEN 'mRNA' ELSE 'siRNA' END AS cargo,
                  cast(s_nationkey as varchar) AS np0 FROM supplier) USING (study)"""))
def q_study_defaults(spark, sf_dir):
    rows = P.form(spark, sf_dir).select(
        "row_id", F.when(F.col("order_no") % 13 == 0, "").otherwise(F.col("study_big")).alias("study"),
        "cargo_raw", F.when(F.col("line_no") == 2, "").otherwise(F.col("line_no").cast("string"))
        .alias("np_text"),
    )
    defaults = P.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("10.1000/s"), F.col("s_suppkey").cast("string")).alias("study"),
        F.when(F.col("s_suppkey") % 2 == 0, "mRNA").otherwise("siRNA").alias("cargo_raw"),
        F.col("s_nationkey").cast("string").alias("np_text"),
    )
    return C.study_defaults(rows, defaults, "study", ["cargo_raw", "np_text"])


FEATURE_SQL = ", ".join(f"{Q.r6(c)} AS {c}" for c in R.FEATURES)


@query("ratio_features", sql("form", f"""
SELECT row_id, n_valid, {FEATURE_SQL} FROM (
  SELECT *, ionizable / nullif(helper, 0) AS ion_to_helper, ionizable + chol AS ion_plus_chol,
         ln(1 + peg) AS log_peg
  FROM (SELECT row_id, n_valid, {Q.share(1)} AS ionizable, {Q.share(2)} AS helper,
               {Q.share(3)} AS chol, {Q.share(4)} AS peg
        FROM ({Q.components(f"(SELECT row_id, {Q.numbers('ratio_raw')} AS nums FROM form)")})))"""))
def q_ratio_features(spark, sf_dir):
    rows = R.with_ratio_features(P.form(spark, sf_dir).select("row_id", "ratio_raw"), "ratio_raw")
    return rows.select("row_id", "n_valid", *[r6(F.col(c)).alias(c) for c in R.FEATURES])


@query("peg_share",
       sql("form", f"SELECT row_id, {Q.r6(Q.peg_share('ratio_raw'))} AS peg_share FROM form"))
def q_peg_share(spark, sf_dir):
    return P.form(spark, sf_dir).select(
        "row_id", r6(R.peg_share(F.col("ratio_raw"))).alias("peg_share"))


SMILES_PATTERNS = {"n_n": "[Nn]", "n_o": "[Oo]", "n_c": "C", "n_ester": r"C\(=O\)O", "n_branch": r"\("}
SMILES_SQL = ", ".join(
    f"CASE WHEN smiles IS NOT NULL THEN len(regexp_extract_all(smiles, {Q.lit(p)})) END AS {n}"
    for n, p in SMILES_PATTERNS.items()
)


def smiles_features(lookup):
    """Structural text counts per distinct substance."""
    text = F.trim("smiles")
    good = ~F.lower(text).isin("nan", "none", "")
    return lookup.select("name", *[
        F.when(good, F.regexp_count(text, F.lit(p))).cast("bigint").alias(n)
        for n, p in SMILES_PATTERNS.items()
    ])


@query("smiles_text_features", sql("form lookup", f"""
SELECT row_id, {SMILES_SQL} FROM form LEFT JOIN lookup ON name = part_name"""))
def q_smiles_text_features(spark, sf_dir):
    dim = smiles_features(P.lipid_lookup(spark, sf_dir)).withColumnRenamed("name", "part_name")
    rows = P.form(spark, sf_dir).select("row_id", "part_name").join(dim, "part_name", "left")
    return rows.select("row_id", *SMILES_PATTERNS)


NUMERIC = [*R.FEATURES, "np", "ph"]
MEASURED = ["size", "pdi", "zeta"]
CATEGORIES = ["name_raw", "peg_name", "cargo_raw"]


def feature_matrix(rows, include_measured=False, dropped=()):
    """Row id, study, outcome, numeric and categorical blocks; measured values are opt-in."""
    numeric = NUMERIC + (MEASURED if include_measured else [])
    wanted = [c for c in numeric + CATEGORIES if c in rows.columns and c not in dropped]
    return rows.select("row_id", F.lower(F.trim("study_big")).alias("study"), "y", *wanted)


def _matrix_sql(names, cats):
    return ", ".join([f"{Q.r6(c)} AS {c}" for c in names] + cats)


@query("feature_matrix", sql("featured", f"""
SELECT row_id, study_big AS study, y, {_matrix_sql(NUMERIC + MEASURED, CATEGORIES)} FROM featured"""))
def q_feature_matrix(spark, sf_dir):
    m = feature_matrix(P.featured(spark, sf_dir), include_measured=True)
    return m.select(*[r6(F.col(c)).alias(c) if c in NUMERIC + MEASURED else F.col(c)
                      for c in m.columns])


def feature_lean(matrix, dropped):
    """Without the given block; unchanged when nothing else would be left."""
    left = [c for c in matrix.columns if c not in dropped]
    return matrix.select(*left) if len(left) > 3 else matrix


@query("feature_lean", sql("featured lookup", f"""
SELECT row_id, study_big AS study, y, {_matrix_sql(NUMERIC, CATEGORIES)} FROM featured"""))
def q_feature_lean(spark, sf_dir):
    dim = smiles_features(P.lipid_lookup(spark, sf_dir)).withColumnRenamed("name", "part_name")
    rows = P.featured(spark, sf_dir).join(dim, "part_name", "left")
    matrix = rows.select("row_id", F.col("study_big").alias("study"), "y",
                         *[r6(F.col(c)).alias(c) for c in NUMERIC], *CATEGORIES, *SMILES_PATTERNS)
    return feature_lean(matrix, list(SMILES_PATTERNS))


def to_logit(value, eps):
    kept = F.greatest(F.lit(eps), F.least(F.lit(100.0 - eps), value))
    return F.ln(kept / (100.0 - kept))


def from_logit(z):
    return 100.0 / (1.0 + F.exp(-z))


def _logit_sql(eps):
    kept = f"greatest({eps}, least({100 - eps}, y))"
    return f"ln({kept} / (100.0 - {kept}))"


@query("logit_outcome", sql("obs", f"""
SELECT row_id, {Q.r6('z10')} AS z10, {Q.r6('z1')} AS z1, {Q.r6('100.0 / (1.0 + exp(-z1))')} AS back
FROM (SELECT row_id, {_logit_sql(10.0)} AS z10, {_logit_sql(1.0)} AS z1 FROM obs)"""))
def q_logit_outcome(spark, sf_dir):
    y = F.col("y")
    return P.obs(spark, sf_dir).select(
        "row_id", r6(to_logit(y, V.LOGIT_BASE)).alias("z10"),
        r6(to_logit(y, V.LOGIT_SHARP)).alias("z1"),
        r6(from_logit(to_logit(y, V.LOGIT_SHARP))).alias("back"),
    )


EE_SQL = Q.lit(V.OUTCOME_MENTION)


def sql_spans(text: str, pattern: str) -> str:
    """List of {start, end, hit} for a pattern both regex engines read alike."""
    hits, gaps = f"regexp_extract_all({text}, {pattern})", f"string_split_regex({text}, {pattern})"
    return (
        f"list_transform({hits}, lambda h, i: {{'start': "
        f"cast(list_sum(list_transform(list_slice({gaps}, 1, i), lambda g: length(g))) as bigint) + "
        f"cast(coalesce(list_sum(list_transform(list_slice({hits}, 1, i - 1), lambda g: length(g))), 0) as bigint), "
        f"'hit': h}})"
    )


def sql_clean_text(e: str) -> str:
    return f"trim(regexp_replace(translate({e}, chr(160) || '–—−', ' ---'), '[ \\t]+', ' ', 'g'))"


@query("evidence_window", sql("articles", f"""
SELECT doc_id, s.start AS start, {sql_clean_text(
    "substring(body, greatest(0, s.start - 130) + 1, s.start + length(s.hit) + 130 - greatest(0, s.start - 130))"
)} AS evidence
FROM (SELECT doc_id, body, unnest({sql_spans('body', EE_SQL)}) AS s FROM articles)"""))
def q_evidence_window(spark, sf_dir):
    rows = P.articles(spark, sf_dir).select(
        "doc_id", "body", F.explode(spans(F.col("body"), V.OUTCOME_MENTION)).alias("s"))
    near = window(F.col("body"), F.col("s.start"), F.col("s.end"), 130)
    return rows.select("doc_id", F.col("s.start").cast("bigint").alias("start"),
                       clean_text(near).alias("evidence"))


@query("clean_outcome", sql("form", f"""
SELECT row_id, {Q.r6(Q.clean_outcome('outcome_raw'))} AS y FROM form"""))
def q_clean_outcome(spark, sf_dir):
    return P.form(spark, sf_dir).select(
        "row_id", r6(O.clean_outcome(F.col("outcome_raw"))).alias("y"))


_GOOD = f"coalesce({Q.clean_outcome('outcome_raw')} BETWEEN 0 AND 100, false)"
_WAS = f"coalesce({Q.naive_outcome('outcome_raw')} BETWEEN 0 AND 100, false)"


@query("clean_outcome_recovery", sql("form", f"""
SELECT count(*) AS n, cast(count_if(g) as bigint) AS n_clean, cast(count_if(w) as bigint) AS n_naive,
       cast(count_if(g AND NOT w) as bigint) AS n_recovered
FROM (SELECT {_GOOD} AS g, {_WAS} AS w FROM form)"""))
def q_clean_outcome_recovery(spark, sf_dir):
    return C.outcome_recovery(P.form(spark, sf_dir), "outcome_raw")


def odd_numbers(spark, sf_dir):
    """Outcomes with fractions, negatives and values above 100."""
    return P.form(spark, sf_dir).withColumn("v", (F.col("y10") - 600) / F.when(
        F.col("order_no") % 5 == 0, 300.0).otherwise(3.0))


ODD_SQL = "odd AS (SELECT *, (y10 - 600) / (CASE WHEN order_no % 5 = 0 THEN 300.0::double ELSE 3.0::double END) AS v FROM form)"


@query("normalize_outcome", sql("form", f"""
SELECT row_id, {Q.r6(Q.as_percent('v'))} AS y, {Q.r6(Q.as_percent('v', True))} AS y_zero
FROM odd""", ODD_SQL))
def q_normalize_outcome(spark, sf_dir):
    v = F.col("v")
    return odd_numbers(spark, sf_dir).select(
        "row_id", r6(O.as_percent(v)).alias("y"), r6(O.as_percent(v, True)).alias("y_zero"))


WORK_KEYS = ["study_big", "ratio_raw", "outcome_raw"]
WORK_SQL = f"""
SELECT row_id, study_big, ratio_raw, {Q.r6('y')} AS y FROM (
  SELECT * EXCLUDE (y), {Q.clean_outcome('outcome_raw')} AS y,
         row_number() OVER (PARTITION BY study_big, ratio_raw, outcome_raw ORDER BY row_id) AS rn
  FROM form)
WHERE rn = 1 AND y IS NOT NULL"""


@query("working_frame", sql("form", WORK_SQL))
def q_working_frame(spark, sf_dir):
    rows = P.form(spark, sf_dir).select("row_id", *WORK_KEYS)
    work = C.working_frame(rows, WORK_KEYS, "outcome_raw", "row_id")
    return work.select("row_id", "study_big", "ratio_raw", r6(F.col("y")).alias("y"))


@query("working_waterfall", sql("form", f"""
SELECT (SELECT count(*) FROM form) AS n_input,
       (SELECT count(*) FROM (SELECT DISTINCT study_big, ratio_raw, outcome_raw FROM form)) AS n_deduped,
       (SELECT count(*) FROM ({WORK_SQL})) AS n_working"""))
def q_working_waterfall(spark, sf_dir):
    return C.working_waterfall(P.form(spark, sf_dir), WORK_KEYS, "outcome_raw")


def sql_reduce(e: str) -> str:
    """Columns r, note, reason of a reduced ratio."""
    bad = "len(list_filter(zn, lambda v: v IS NULL)) > 0"
    rest = "list_slice(zn, 5, len(zn))"
    large = f"{Q.total(rest)} > 0.15 * {Q.total('zn')}"

    def over(body):
        return Q.let("zp", Q.colon_parts(e), Q.let(
            "zn", f"list_transform(zp, lambda x: {Q.num('x')})", body))

    ratio = (f"CASE WHEN len(zp) <= 4 THEN array_to_string(zp, ':') WHEN {bad} THEN NULL WHEN {large} "
             f"THEN NULL ELSE {Q.ratio_text('list_slice(zn, 1, 4)')} END")
    note = (f"CASE WHEN len(zp) > 4 AND NOT ({bad}) AND NOT ({large}) THEN concat('first 4 of ', len(zp), "
            f"' parts kept; dropped ', {Q.ratio_text(rest)}) END")
    reason = (f"CASE WHEN len(zp) <= 4 THEN NULL WHEN {bad} THEN 'ratio not numeric' WHEN {large} "
              f"THEN concat('irreducible ratio of ', len(zp), ' parts') END")
    return f"{over(ratio)} AS r, {over(note)} AS note, {over(reason)} AS reason"


@query("ratio_reduce", sql("colon", f"""
SELECT row_id, r AS ratio, note, reason FROM (SELECT row_id, {sql_reduce('ratio')} FROM colon)"""))
def q_ratio_reduce(spark, sf_dir):
    rows = P.colon(P.form(spark, sf_dir)).select("row_id", R.reduce_ratio(F.col("ratio")).alias("r"))
    return rows.select("row_id", "r.ratio", "r.note", "r.reason")


def sql_malformed(e: str) -> str:
    body = (
        "CASE WHEN len(zn) < 3 THEN 'fewer than 3 parts' "
        "WHEN len(list_filter(zn, lambda v: v IS NULL)) > 0 THEN 'not numeric' "
        "WHEN list_min(zn) <= 0 THEN 'value not positive' "
        "WHEN list_max(zn) / list_min(zn) > 500 THEN 'extreme spread' END"
    )
    return Q.let("zn", f"list_transform({Q.colon_parts(e)}, lambda x: {Q.num('x')})", body)


def sql_malformed_wide(e: str) -> str:
    body = (
        "CASE WHEN len(list_filter(zn, lambda v: v IS NULL)) > 0 THEN 'not numeric' "
        "WHEN len(zn) NOT IN (3, 4) THEN 'not 3 or 4 parts' "
        f"WHEN list_min(zn) < 0 THEN 'negative value' WHEN {Q.total('zn')} <= 0 THEN 'total not positive' "
        "WHEN list_max(zn) / greatest(list_min(list_filter(zn, lambda v: v > 0)), 0.0001) > 10000 "
        "THEN 'extreme spread' END"
    )
    return Q.let("zn", Q.numbers(e), body)


@query("ratio_wellformed", sql("form", f"""
SELECT row_id, {sql_malformed('t')} AS reason, {sql_malformed_wide('t')} AS reason_wide
FROM (SELECT row_id, CASE WHEN line_no = 1 THEN concat(ratio_raw, ':0') WHEN line_no = 2
        THEN concat(ratio_raw, ':0.01') ELSE ratio_raw END AS t FROM form)"""))
def q_ratio_wellformed(spark, sf_dir):
    t = F.when(F.col("line_no") == 1, F.concat("ratio_raw", F.lit(":0"))).when(
        F.col("line_no") == 2, F.concat("ratio_raw", F.lit(":0.01"))).otherwise(F.col("ratio_raw"))
    return P.form(spark, sf_dir).select("row_id", t.alias("t")).select(
        "row_id", R.malformed_reason(F.col("t")).alias("reason"),
        R.malformed_reason_wide(F.col("t")).alias("reason_wide"))


def sql_warnings(e: str) -> str:
    body = (
        "CASE WHEN len(list_filter(zn, lambda v: v IS NULL)) > 0 THEN 'not numeric' "
        "WHEN len(zn) <> 4 THEN 'not 4 parts' ELSE concat_ws('; ', "
        "CASE WHEN list_min(zn) < 0 THEN 'negative value' END, "
        "CASE WHEN zn[1] = 0 THEN 'ionizable is 0' END, CASE WHEN zn[4] > 10 THEN 'peg above 10' END, "
        "CASE WHEN zn[2] > 50 THEN 'helper above 50' END, "
        f"CASE WHEN {Q.total('zn')} > 150 THEN 'total above 150' END) END"
    )
    return Q.let("zn", Q.numbers(e), body)


@query("composition_warnings", sql("form", f"""
SELECT row_id, {sql_warnings('t')} AS warnings
FROM (SELECT row_id, CASE WHEN line_no = 1 THEN concat('0:60:', ratio_raw) WHEN line_no = 7
        THEN concat(ratio_raw, ':', qty) WHEN line_no = 5 THEN concat(qty * 3, ':', c3, ':5:1')
        ELSE ratio_raw END AS t FROM (SELECT *, qty % 3 AS c3 FROM form))"""))
def q_composition_warnings(spark, sf_dir):
    qty = F.col("qty").cast("string")
    t = (
        F.when(F.col("line_no") == 1, F.concat(F.lit("0:60:"), F.col("ratio_raw")))
        .when(F.col("line_no") == 7, F.concat("ratio_raw", F.lit(":"), qty))
        .when(F.col("line_no") == 5, F.concat((F.col("qty") * 3).cast("string"), F.lit(":"),
              (F.col("qty") % 3).cast("string"), F.lit(":5:1")))
        .otherwise(F.col("ratio_raw"))
    )
    return P.form(spark, sf_dir).select(
        "row_id", F.array_join(R.composition_warnings(t), "; ").alias("warnings"))


RANGED = {c: c for c in ("np", "ph", "size", "pdi", "zeta")}


def sql_range(c: str) -> str:
    lo, hi = V.RANGES[c]
    return f"{c} BETWEEN {lo} AND {hi}"


@query("range_reject", sql("form", "SELECT row_id, coalesce(" + ", ".join(
    f"CASE WHEN NOT ({sql_range(c)}) THEN '{c} out of range' END" for c in RANGED
) + ") AS reason FROM form"))
def q_range_reject(spark, sf_dir):
    return P.form(spark, sf_dir).select("row_id", C.range_checks(RANGED).alias("reason"))


@query("range_nullify", sql("form", "SELECT row_id, " + ", ".join(
    f"CASE WHEN {sql_range(c)} THEN {c} END AS {c}" for c in RANGED) + " FROM form"))
def q_range_nullify(spark, sf_dir):
    return C.range_nullify(P.form(spark, sf_dir).select("row_id", *RANGED), RANGED)


def report_rows(spark, sf_dir):
    look = P.lipid_lookup(spark, sf_dir).withColumnRenamed("name", "part_name")
    rows = P.form(spark, sf_dir).join(look, "part_name", "left")
    study = F.when(F.col("order_no") % 17 == 0, "").when(
        F.col("order_no") % 19 == 0, F.concat(F.lit("lab book "), F.col("line_no").cast("string"))
    ).otherwise(F.col("study_big"))
    return rows.withColumn("study", study)


_REPORT_BASE = f"""
rep AS (
  SELECT trim(s) AS study, trim(ratio_raw) AS ratio, trim(outcome_raw) AS ee_text, trim(cargo_raw) AS cargo,
         trim(coalesce(smiles, '')) AS smiles, {Q.num('outcome_raw')} AS ee,
         len(list_filter({Q.numbers('ratio_raw')}, lambda v: v IS NOT NULL)) AS k,
         {Q.total(Q.numbers('ratio_raw'))} AS total
  FROM (SELECT *, CASE WHEN order_no % 17 = 0 THEN '' WHEN order_no % 19 = 0 THEN concat('lab book ', line_no)
               ELSE study_big END AS s FROM form) LEFT JOIN lookup ON name = part_name),
rep_flags AS (
  SELECT 'empty_study' AS rule, 'fail' AS bad, study = '' AS hit, NULL AS sample FROM rep
  UNION ALL SELECT 'empty_ratio', 'fail', ratio = '', NULL FROM rep
  UNION ALL SELECT 'empty_outcome', 'fail', ee_text = '', NULL FROM rep
  UNION ALL SELECT 'unreadable_ratio', 'fail', k NOT IN (3, 4), ratio FROM rep
  UNION ALL SELECT 'odd_total', 'warn', k = 4 AND (total < 80 OR total > 120), NULL FROM rep
  UNION ALL SELECT 'unreadable_outcome', 'fail', ee IS NULL, NULL FROM rep
  UNION ALL SELECT 'fraction_outcome', 'warn', ee > 0 AND ee <= 1, NULL FROM rep
  UNION ALL SELECT 'outcome_out_of_range', 'fail', ee < 0 OR ee > 100, NULL FROM rep
  UNION ALL SELECT 'odd_study_id', 'warn', NOT regexp_matches(study, '^(10\\.[0-9]{{4,9}}/|PMID|pmid|https?://)'), study FROM rep
  UNION ALL SELECT 'unknown_cargo', 'warn', cargo <> '' AND replace(replace(lower(cargo), '-', ''), ' ', '') NOT IN {Q.inlist(V.CARGO_SPELLINGS)}, cargo FROM rep
  UNION ALL SELECT 'smiles_missing', 'info', smiles = '' OR lower(smiles) = 'nan', NULL FROM rep)"""


@query("validate_report", sql("form lookup", """
SELECT rule, CASE WHEN n = 0 THEN 'ok' ELSE bad END AS level, n, samples FROM (
  SELECT rule, max(bad) AS bad, cast(count_if(hit) as bigint) AS n,
         coalesce(array_to_string(list_slice(list_sort(list_distinct(list(CASE WHEN hit THEN sample END))), 1, 3), ', '), '') AS samples
  FROM rep_flags GROUP BY rule)
UNION ALL SELECT 'few_studies', CASE WHEN count(DISTINCT lower(study)) < 10 THEN 'warn' ELSE 'ok' END,
       count(DISTINCT lower(study)), '' FROM rep""", _REPORT_BASE))
def q_validate_report(spark, sf_dir):
    return C.validate_report(report_rows(spark, sf_dir), "study", "ratio_raw", "outcome_raw",
                             "cargo_raw", "smiles")


@query("profile_outcome", sql("form", f"""
SELECT count(*) AS n, count(v) AS n_valid, cast(count_if(v > 0 AND v <= 1) as bigint) AS n_fraction,
       cast(count_if(v > 100) as bigint) AS n_over, cast(count_if(v < 0) as bigint) AS n_negative,
       count(c) AS n_clean, {Q.r6('avg(c)')} AS mean, {Q.r6('stddev_samp(c)')} AS sd,
       {Q.r6('median(c)')} AS median, {Q.r6('avg(cast(c > 90 as double))')} AS share_over_90
FROM (SELECT v, {Q.as_percent('v', True)} AS c FROM odd)""", ODD_SQL))
def q_profile_outcome(spark, sf_dir):
    from formulake.operators.groups import group_quantiles

    rows = odd_numbers(spark, sf_dir).select("v")
    clean = rows.select(O.as_percent(F.col("v"), True).alias("c"))
    median = group_quantiles(clean, [], "c", {"median": 0.5}, 0.1).select("median").scalar()
    out = C.profile_outcome(rows, "v")
    real = ("mean", "sd", "share_over_90")
    return out.select(*[r6(F.col(c)).alias(c) if c in real else F.col(c) for c in out.columns],
                      r6(median).alias("median"))


@query("cargo_spelling", sql("form", f"""
SELECT DISTINCT trim(cargo_raw) AS value FROM form WHERE trim(cargo_raw) <> ''
AND replace(replace(lower(cargo_raw), '-', ''), ' ', '') NOT IN {Q.inlist(V.CARGO_SPELLINGS)}"""))
def q_cargo_spelling(spark, sf_dir):
    return C.unknown_spellings(P.form(spark, sf_dir), "cargo_raw", V.CARGO_SPELLINGS)


_SCREEN_SQL = f"""
red AS (SELECT *, {sql_reduce('ratio')} FROM batch),
keyed AS (SELECT *, {Q.content_key('study_big', 'name_raw', 'r', Q.clean_outcome('outcome_raw'))} AS k FROM red),
have AS (SELECT DISTINCT {Q.content_key('study_big', 'name_raw', 'rr', Q.clean_outcome('outcome_raw'))} AS k
         FROM (SELECT *, coalesce(r, ratio) AS rr FROM (SELECT *, {sql_reduce('ratio')} FROM store))),
screened AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN k IN (SELECT k FROM have) THEN 'already stored'
       WHEN row_number() OVER (PARTITION BY reason IS NOT NULL, k IN (SELECT k FROM have), k ORDER BY row_id) > 1
       THEN 'duplicate in batch' END AS why FROM keyed)"""


@query("screen_new_rows", sql("batch store", """
SELECT row_id, r AS ratio, note, why FROM screened""", _SCREEN_SQL))
def q_screen_new_rows(spark, sf_dir):
    out = K.screen_new_rows(P.batch(spark, sf_dir), P.store(spark, sf_dir), **K.FORM_COLUMNS)
    return out.select("row_id", "ratio", "note", "why")


@query("screen_counters", sql("batch store", """
SELECT count(*) AS n_input, cast(count_if(why IS NULL) as bigint) AS n_accepted,
       cast(count_if(why = 'already stored') as bigint) AS n_dup_existing,
       cast(count_if(why = 'duplicate in batch') as bigint) AS n_dup_within,
       cast(count_if(note IS NOT NULL) as bigint) AS n_reduced FROM screened""", _SCREEN_SQL))
def q_screen_counters(spark, sf_dir):
    return K.screen_counters(
        K.screen_new_rows(P.batch(spark, sf_dir), P.store(spark, sf_dir), **K.FORM_COLUMNS))


UPLOAD_COLUMNS = {"study": "study", "ratio": "ratio_raw", "outcome": "outcome_raw", "cargo": "cargo_raw", "smiles": "smiles"}


LEVELS_SQL = """
counted AS (SELECT rule, max(bad) AS bad, cast(count_if(hit) as bigint) AS n,
    coalesce(array_to_string(list_slice(list_sort(list_distinct(list(CASE WHEN hit THEN sample END))), 1, 3), ', '), '') AS samples
  FROM rep_flags GROUP BY rule),
levels AS (SELECT rule, CASE WHEN n = 0 THEN 'ok' ELSE bad END AS level, n, samples FROM counted
  UNION ALL SELECT 'few_studies', CASE WHEN count(DISTINCT lower(study)) < 10 THEN 'warn' ELSE 'ok' END,
    count(DISTINCT lower(study)), '' FROM rep)"""


@query("validate_upload", sql("form lookup", """
SELECT 'whole' AS upload, * FROM levels
UNION ALL SELECT 'whole', 'missing_columns', 'ok', 0, ''
UNION ALL SELECT 'whole', 'passed', CASE WHEN count_if(level = 'fail') = 0 THEN 'ok' ELSE 'fail' END, count_if(level = 'fail'), '' FROM levels
UNION ALL SELECT 'without outcome', 'missing_columns', 'fail', 1, 'outcome_raw'
UNION ALL SELECT 'without outcome', 'passed', 'fail', 1, ''""", _REPORT_BASE, LEVELS_SQL))
def q_validate_upload(spark, sf_dir):
    """The report of a whole upload, and of one that lacks a required column."""
    rows = report_rows(spark, sf_dir)
    required = ["study", "ratio", "outcome"]
    whole = C.validate_upload(rows, UPLOAD_COLUMNS, required)
    part = C.validate_upload(rows.drop("outcome_raw"), UPLOAD_COLUMNS, required)
    return whole.select(F.lit("whole").alias("upload"), "*").unionByName(
        part.select(F.lit("without outcome").alias("upload"), "*"))
