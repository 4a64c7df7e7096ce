"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions import ratio as R
from formulake.functions.numbers import let, r6
from formulake.functions.outcome import clean_outcome
from formulake.functions.text import by_spelling, cargo_cascade, first_term_of, spans, term_count, terms
from formulake.operators import anchor as AN
from formulake.operators import joins as J
from formulake.operators import keys as K
from formulake.operators.groups import first_rows
from formulake.operators.stats import data_support
from formulake.plans import sqlviews as Q
from formulake.plans import views as P
from formulake.plans.q_clean import EE_SQL, sql_spans
from formulake.plans.registry import query
from formulake.plans.sqlviews import sql

# ------------------------------------------------------------------ lookups
HALF_SQL = """
half AS (SELECT row_id, part_name, CASE WHEN line_no = 1 THEN 'CCO' WHEN line_no = 2 THEN ' ' END AS smiles
         FROM form)"""


def half(spark, sf_dir):
    return P.form(spark, sf_dir).select(
        "row_id", "part_name",
        F.when(F.col("line_no") == 1, "CCO").when(F.col("line_no") == 2, " ").alias("smiles"))


@query("lookup_backfill", sql("form lookup", """
SELECT row_id, part_name, CASE WHEN trim(coalesce(half.smiles, '')) = '' THEN l.smiles
       ELSE half.smiles END AS smiles
FROM half LEFT JOIN lookup l ON l.name = part_name""", HALF_SQL))
def q_lookup_backfill(spark, sf_dir):
    return J.lookup_backfill(half(spark, sf_dir), P.lipid_lookup(spark, sf_dir), "part_name", "smiles")


@query("lookup_unresolved", sql("form lookup", """
SELECT DISTINCT part_name AS name FROM half
WHERE trim(coalesce(smiles, '')) = '' AND part_name NOT IN (SELECT name FROM lookup)""", HALF_SQL))
def q_lookup_unresolved(spark, sf_dir):
    return J.unresolved_names(half(spark, sf_dir), P.lipid_lookup(spark, sf_dir), "part_name", "smiles")


def sql_map(table: dict[str, str], e: str) -> str:
    cases = " ".join(f"WHEN {Q.lit(s)} THEN {Q.lit(c)}" for s, c in table.items())
    return f"(CASE {e} {cases} END)"


def sql_dictionary_name(e: str) -> str:
    flat = f"replace(replace(lower(trim({e})), '-', ''), ' ', '')"
    names = by_spelling(V.ION_CANON)
    return f"coalesce({sql_map(names, f'lower(trim({e}))')}, {sql_map(names, flat)}, trim({e}))"


CANON_SQL = f"""
spelled AS (SELECT lower(trim(name_raw)) AS low, max_by(trim(name_raw), row_id) AS stored
            FROM store WHERE trim(name_raw) <> '' GROUP BY 1),
smi AS (SELECT lower(trim(name_raw)) AS low, max_by(smiles, row_id) AS smiles
        FROM store JOIN lookup ON name = part_name WHERE trim(name_raw) <> '' GROUP BY 1),
dict AS (SELECT *, {sql_dictionary_name('name_raw')} AS d FROM batch),
fin AS (SELECT dict.*, CASE WHEN d IN {Q.inlist(list(V.ION_CANON))} THEN d ELSE coalesce(stored, d) END AS f
        FROM dict LEFT JOIN spelled ON lower(d) = spelled.low)"""


@query("canonical_names", sql("batch store lookup", f"""
SELECT row_id, f AS name_raw,
       CASE WHEN f IN ('', '{V.UNNAMED}') THEN '' ELSE coalesce(smi.smiles, '') END AS smiles,
       coalesce({sql_map(V.PEG_CANON, 'lower(trim(peg_name))')}, trim(peg_name)) AS peg_name
FROM fin LEFT JOIN smi ON lower(f) = smi.low""", CANON_SQL))
def q_canonical_names(spark, sf_dir):
    look = P.lipid_lookup(spark, sf_dir).withColumnRenamed("name", "part_name")
    existing = P.store(spark, sf_dir).join(look, "part_name", "left")
    out = J.canonical_names(P.batch(spark, sf_dir), existing, "name_raw", "peg_name", "smiles", "row_id")
    return out.select("row_id", "name_raw", "smiles", "peg_name")


KEY_SQL = Q.content_key("study_big", "name_raw", "ratio", Q.clean_outcome("outcome_raw"))


@query("screen_existing", sql("batch store", f"""
SELECT row_id FROM batch WHERE {KEY_SQL} NOT IN (SELECT {KEY_SQL} FROM store)"""))
def q_screen_existing(spark, sf_dir):
    cols = ("study_big", "name_raw", "ratio", "outcome_raw")
    new = K.with_key(P.batch(spark, sf_dir).select("row_id", *cols), *cols)
    have = K.with_key(P.store(spark, sf_dir).select(*cols), *cols)
    return J.without_existing(new, have, ["content_key"]).select("row_id")


@query("new_documents_only", """
SELECT id AS doc, min(pos) AS pos FROM (
  SELECT cast(doc_id as varchar) AS id, doc_id AS pos FROM documents
  UNION ALL SELECT cast(doc_id as varchar), doc_id + 100000000 FROM documents WHERE doc_id % 2 = 0)
WHERE id NOT IN (SELECT cast(doc_id as varchar) FROM labels) GROUP BY id""")
def q_new_documents_only(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select("doc_id")
    text = F.col("doc_id").cast("string")
    pool = docs.select(F.concat(F.lit("PMC"), text).alias("doc"), F.col("doc_id").alias("pos"))
    pool = pool.unionByName(docs.where(F.col("doc_id") % 2 == 0).select(
        F.concat(text, F.lit(".0")).alias("doc"), (F.col("doc_id") + 100000000).alias("pos")))
    done = P.table(spark, sf_dir, "labels").select(
        F.concat(text, F.lit(".0")).alias("doc"))
    return J.new_documents(pool, done, "doc", "pos")


@query("eligible_studies", sql("form", """
SELECT row_id, study_small, study_rows FROM (
  SELECT row_id, study_small, count(*) OVER (PARTITION BY study_small) AS study_rows FROM form)
WHERE study_rows >= 4"""))
def q_eligible_studies(spark, sf_dir):
    return J.eligible_studies(P.form(spark, sf_dir).select("row_id", "study_small"), "study_small", 4)


@query("singleton_studies", sql("form", """
SELECT count(*) AS n_studies, cast(count_if(n = 1) as bigint) AS n_singletons
FROM (SELECT study_small, count(*) AS n FROM form GROUP BY 1)"""))
def q_singleton_studies(spark, sf_dir):
    sizes = P.form(spark, sf_dir).groupBy("study_small").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_studies"), F.count_if(F.col("n") == 1).alias("n_singletons"))


@query("claims_with_source", sql("claims articles", """
SELECT claim_id, length(s) AS n_chars, md5(s) AS digest
FROM (SELECT claim_id, concat_ws(' ', evidence, body) AS s FROM claims LEFT JOIN articles USING (doc_id))"""))
def q_claims_with_source(spark, sf_dir):
    rows = J.claims_with_source(P.claims(spark, sf_dir), P.articles(spark, sf_dir))
    return rows.select("claim_id", F.length("source").cast("bigint").alias("n_chars"),
                       F.md5("source").alias("digest"))


# RE2 has no look-around: runs of number lists are cut out whole and checked part by part.
RUN = r"[0-9]+(?:\.[0-9]+)?(?:\s*[:/;,|-]\s*[0-9]+(?:\.[0-9]+)?)+"
RUN_SQL = Q.lit(RUN)


def sql_ratio_mentions(src: str = "articles") -> str:
    """CTE ratio_runs: doc_id, start, vals of every list of four numbers."""
    return f"""
ratio_runs AS (
  SELECT doc_id, start, list_transform(p, lambda v: cast(v as double)) AS vals
  FROM (SELECT doc_id, s.start AS start, list_transform(string_split_regex(s.hit, '[:/;,|-]'), lambda v: trim(v)) AS p
        FROM (SELECT doc_id, unnest({sql_spans('body', RUN_SQL)}) AS s FROM {src}))
  WHERE len(p) = 4)"""


def ratio_mentions(articles):
    """doc_id, start, ratio of every well-formed ratio mention."""
    rows = articles.select("doc_id", F.explode(spans(F.col("body"), V.RATIO_MENTION)).alias("s"))
    values = F.transform(F.split("s.hit", r"\s*[:/;,|-]\s*"), lambda v: v.cast("double"))
    return rows.where(R.malformed_reason_wide(F.col("s.hit")).isNull()).select(
        "doc_id", F.col("s.start").cast("bigint").alias("start"),
        R.ratio_text(values).alias("ratio"))


def outcome_mentions(articles):
    """doc_id, start, ee of every outcome mention with a value in (0, 100]."""
    rows = articles.select("doc_id", F.explode(spans(F.col("body"), V.OUTCOME_MENTION)).alias("s"))
    value = F.regexp_extract("s.hit", V.OUTCOME_MENTION, 1).try_cast("double")
    rows = rows.select("doc_id", F.col("s.start").cast("bigint").alias("start"), value.alias("ee"))
    return rows.where((F.col("ee") > 0) & (F.col("ee") <= 100))


OUTCOMES_SQL = f"""
outcomes AS (
  SELECT doc_id, s.start AS start, try_cast(regexp_extract(s.hit, {EE_SQL}, 1) as double) AS ee
  FROM (SELECT doc_id, unnest({sql_spans('body', EE_SQL)}) AS s FROM articles)),
outcomes_ok AS (SELECT * FROM outcomes WHERE ee > 0 AND ee <= 100)"""


@query("nearest_mention", sql("articles", f"""
SELECT doc_id, start, ratio, CASE WHEN gap <= 4000 THEN ee END AS ee,
       CASE WHEN gap <= 4000 THEN gap END AS gap
FROM (SELECT r.doc_id, r.start, {Q.ratio_text('vals')} AS ratio, o.ee, abs(r.start - o.start) AS gap,
             row_number() OVER (PARTITION BY r.doc_id, r.start ORDER BY abs(r.start - o.start), o.start) AS rn
      FROM ratio_runs r LEFT JOIN outcomes_ok o ON o.doc_id = r.doc_id)
WHERE rn = 1""", sql_ratio_mentions(), OUTCOMES_SQL))
def q_nearest_mention(spark, sf_dir):
    arts = P.articles(spark, sf_dir)
    return J.nearest_mention(ratio_mentions(arts), outcome_mentions(arts))


@query("align_oof", sql("form oof", """
SELECT form.row_id, pred, fold FROM form LEFT JOIN oof USING (row_id)"""))
def q_align_oof(spark, sf_dir):
    preds = P.oof(spark, sf_dir).select("row_id", "pred", "fold")
    return P.form(spark, sf_dir).select("row_id").join(preds, "row_id", "left")


SUPPORT_SQL = "support AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS component, quantile_cont({c}, 0.05) AS lo, quantile_cont({c}, 0.95) AS hi, "
    f"quantile_cont({c}, 0.5) AS median FROM featured WHERE {c} IS NOT NULL" for c in R.COMPONENTS) + ")"


def composition_grid(support, n):
    """Cartesian grid of four evenly spaced axes, made by nested explodes of one row."""
    axes = support.groupBy().agg(*[
        F.max(F.when(F.col("component") == c, F.struct("lo", "hi"))).alias(f"_{c}")
        for c in R.COMPONENTS])
    for c in R.COMPONENTS:
        at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
            i.cast("bigint").alias("i"),
            (F.col(f"_{c}.lo") + (F.col(f"_{c}.hi") - F.col(f"_{c}.lo")) * i / (n - 1)).alias("v")))
        axes = axes.withColumn(f"a_{c}", F.explode(at))
    total = sum((F.col(f"a_{c}.v") for c in R.COMPONENTS), F.lit(0.0))
    grid = axes.withColumn("_t", total).where(F.col("_t") > 0)
    point = F.col("a_ionizable.i")
    for c in R.COMPONENTS[1:]:
        point = point * n + F.col(f"a_{c}.i")
    return grid.select(point.alias("point"), *[
        (F.col(f"a_{c}.v") / F.col("_t") * 100).alias(c) for c in R.COMPONENTS])


GRID_SQL = "grid AS (SELECT point, " + ", ".join(
    f"{c} / (ionizable + helper + chol + peg) * 100 AS {c}" for c in R.COMPONENTS) + """
  FROM (SELECT ((i.i * 7 + h.i) * 7 + c.i) * 7 + p.i AS point, """ + ", ".join(
    f"{t}.lo + ({t}.hi - {t}.lo) * {t}.i / 6 AS {c}"
    for t, c in zip("ihcp", R.COMPONENTS)) + " FROM " + ", ".join(
    f"(SELECT *, unnest(range(7)) AS i FROM support WHERE component = '{c}') {t}"
    for t, c in zip("ihcp", R.COMPONENTS)) + "))"


@query("composition_grid", sql("featured", "SELECT point, " + ", ".join(
    f"{Q.r6(c)} AS {c}" for c in R.COMPONENTS) + " FROM grid", SUPPORT_SQL, GRID_SQL))
def q_composition_grid(spark, sf_dir):
    grid = composition_grid(data_support(P.shares(spark, sf_dir), R.COMPONENTS), 7)
    return grid.select("point", *[r6(F.col(c)).alias(c) for c in R.COMPONENTS])


@query("within_study_pairs", sql("oof", """
SELECT study, n_pairs, n_agree FROM (
  SELECT a.study, count(CASE WHEN b.y - a.y >= 5 - 1e-9 THEN 1 END) AS n_pairs,
         count(CASE WHEN b.y - a.y >= 5 - 1e-9 AND b.pred > a.pred THEN 1 END) AS n_agree
  FROM oof a JOIN oof b ON a.study = b.study GROUP BY a.study)"""))
def q_within_study_pairs(spark, sf_dir):
    out = J.pair_agreement(P.oof(spark, sf_dir), "study", "y", "pred", 5.0)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("n_pairs", "n_agree")})


@query("offset_broadcast", sql("oof_small", f"""
SELECT row_id, {Q.r6('pred + coalesce(shrunk, 0)')} AS adj FROM oof LEFT JOIN (
  SELECT study, median(y - pred) * CASE count(*) WHEN 1 THEN 1 / 1.5 WHEN 2 THEN 2 / 2.75
         ELSE count(*) / (count(*) + 1.0) END AS shrunk
  FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY row_id) AS rn FROM oof)
  WHERE rn <= 3 GROUP BY study) USING (study)"""))
def q_offset_broadcast(spark, sf_dir):
    from formulake.operators.groups import top_rows

    rows = P.oof(spark, sf_dir, "study_small")
    anchors = top_rows(rows, ["study"], [F.col("row_id")], 3, "_rn").select(
        "study", (F.col("y") - F.col("pred")).alias("resid"))
    offsets = AN.study_offsets(anchors, "study", "resid").withColumn("ref_pred", F.lit(80.0))
    moved = AN.with_offset(rows.select("row_id", "study", "pred"), offsets, "study")
    return moved.select("row_id", r6(F.col("pred") + F.col("offset")).alias("adj"))


ROLE_WORDS = {"ionizable": V.IONIZABLE, "helper": V.HELPER, "peg": V.PEG_LIPID}


def dictionary_terms(articles):
    """Per article and role the most frequent and the longest dictionary term; a body is read and lowered once."""
    def best(low, names):
        counted = F.transform(terms(names), lambda w: F.struct(
            (-term_count(low, F.lower(w))).alias("c"), w.alias("term")))
        return F.array_min(F.filter(counted, lambda s: s["c"] < 0))

    roles = let(F.lower("body"), lambda low: F.array(*[
        F.struct(F.lit(role).alias("role"), best(low, names).alias("b"), first_term_of(low, names).alias("longest"))
        for role, names in ROLE_WORDS.items()]))
    rows = articles.select("doc_id", F.explode(roles).alias("r")).where(F.col("r.b").isNotNull())
    return rows.select("doc_id", "r.role", F.col("r.b.term").alias("term"), (-F.col("r.b.c")).alias("n"), "r.longest")


def _terms_sql(role, names):
    ordered = sorted(names, key=lambda w: -len(w))
    longest = "coalesce(" + ", ".join(
        f"CASE WHEN contains(lower(body), {Q.lit(w.lower())}) THEN {Q.lit(w)} END" for w in ordered) + ")"
    return f"""
SELECT doc_id, '{role}' AS role, term, n, longest FROM (
  SELECT doc_id, term, n, longest, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rn
  FROM (SELECT doc_id, term, longest, (length(low) - length(replace(low, lower(term), ''))) // length(term) AS n
        FROM (SELECT doc_id, lower(body) AS low, {longest} AS longest, unnest({Q.words(names)}) AS term
              FROM articles))
  WHERE n > 0) WHERE rn = 1"""


@query("dictionary_terms", sql("articles", " UNION ALL ".join(
    _terms_sql(r, n) for r, n in ROLE_WORDS.items())))
def q_dictionary_terms(spark, sf_dir):
    return dictionary_terms(P.articles(spark, sf_dir))


def sql_cargo_class(e: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({e}, {Q.lit(p)}) THEN {Q.lit(c)}" for c, p in V.CARGO_CLASSES)
    return f"(CASE {cases} ELSE 'other' END)"


def sql_cascade(*fields: str) -> str:
    return "coalesce(" + ", ".join(
        f"nullif({sql_cargo_class(f'lower({f})')}, 'other')" for f in fields) + ", 'other')"


@query("cargo_cascade", sql("claims articles", f"""
SELECT claim_id, {sql_cascade('cargo_claim', 'title', 'body')} AS cargo
FROM claims LEFT JOIN articles USING (doc_id)"""))
def q_cargo_cascade(spark, sf_dir):
    arts = P.articles(spark, sf_dir)
    found = arts.select("doc_id", cargo_cascade(F.col("title"), F.col("body")).alias("_article"))
    rows = P.claims(spark, sf_dir).select("claim_id", "doc_id", "cargo_claim").join(found, "doc_id", "left")
    own = cargo_cascade(F.col("cargo_claim"))
    return rows.select("claim_id", F.coalesce(F.nullif(own, F.lit("other")), F.col("_article"), own).alias("cargo"))


# ------------------------------------------------------------------ keys and sets
@query("dedupe_keep_first", sql("form", """
SELECT row_id, study_big, ratio_raw, y10 FROM (
  SELECT *, row_number() OVER (PARTITION BY study_big, ratio_raw, y10 ORDER BY row_id) AS rn FROM form)
WHERE rn = 1"""))
def q_dedupe_keep_first(spark, sf_dir):
    rows = P.form(spark, sf_dir).select("row_id", "study_big", "ratio_raw", "y10")
    return first_rows(rows, ["study_big", "ratio_raw", "y10"], [F.col("row_id")])


COLS = ("study_big", "name_raw", "ratio", "outcome_raw")


@query("content_key", sql("batch", f"SELECT row_id, {KEY_SQL} AS content_key FROM batch"))
def q_content_key(spark, sf_dir):
    return K.with_key(P.batch(spark, sf_dir), *COLS).select("row_id", "content_key")


@query("dedupe_content", sql("batch", f"""
SELECT min(row_id) AS row_id, k AS content_key FROM (SELECT row_id, {KEY_SQL} AS k FROM batch) GROUP BY k"""))
def q_dedupe_content(spark, sf_dir):
    rows = K.with_key(P.batch(spark, sf_dir), *COLS).select("row_id", "content_key")
    return K.dedupe_content(rows, "row_id")


@query("duplicate_report", sql("batch", f"""
SELECT k AS content_key, count(*) AS n, array_to_string(list_slice(list_sort(list(row_id)), 1, 8), ',') AS row_ids
FROM (SELECT row_id, {KEY_SQL} AS k FROM (SELECT * REPLACE ('same' AS outcome_raw, 'x' AS name_raw,
      CASE WHEN part_no % 3 = 0 THEN '1:2:3' ELSE ratio END AS ratio) FROM batch)) GROUP BY k HAVING count(*) > 1"""))
def q_duplicate_report(spark, sf_dir):
    rows = P.batch_ratios(spark, sf_dir).withColumns({
        "outcome_raw": F.lit("same"), "name_raw": F.lit("x"),
        "ratio": F.when(F.col("part_no") % 3 == 0, "1:2:3").otherwise(F.col("ratio"))})
    return K.duplicate_report(K.with_key(rows, *COLS), "row_id")


@query("batch_duplicates", sql("batch", f"""
SELECT row_id, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY row_id) > 1 AS is_copy FROM batch"""))
def q_batch_duplicates(spark, sf_dir):
    from formulake.operators.groups import flag_first

    rows = K.with_key(P.batch(spark, sf_dir), *COLS).select("row_id", "content_key")
    return flag_first(rows, ["content_key"], "row_id", "_first").select(
        "row_id", (~F.col("_first")).alias("is_copy"))


@query("union_sources", sql("form", """
SELECT row_id, ratio_raw, np, NULL::double AS ph FROM form WHERE order_no % 2 = 0
UNION ALL SELECT row_id, ratio_raw, NULL, ph FROM form WHERE order_no % 2 = 1"""))
def q_union_sources(spark, sf_dir):
    rows = P.form(spark, sf_dir)
    even, odd = rows.where(F.col("order_no") % 2 == 0), rows.where(F.col("order_no") % 2 == 1)
    return even.select("row_id", "ratio_raw", "np").unionByName(
        odd.select("row_id", "ratio_raw", "ph"), allowMissingColumns=True)


NUMS_SQL = Q.numbers("ratio")


@query("ratio_set_equal", sql("colon", f"""
SELECT row_id, list_sort(n) = list_sort(o) AS equal_set,
       len(list_filter(list_distinct(o), lambda v: len(list_filter(o, lambda w: w = v))
                       > len(list_filter(n, lambda w: w = v)))) = 0 AS contained
FROM (SELECT row_id, {NUMS_SQL} AS n, CASE line_no WHEN 1 THEN list_reverse({NUMS_SQL})
        WHEN 2 THEN list_slice({NUMS_SQL}, 1, 3) WHEN 3 THEN list_concat({NUMS_SQL}, [1.0])
        ELSE [20.0, 3.0, 21.0, 0.5] END AS o FROM colon WHERE ratio <> 'n.r.')"""))
def q_ratio_set_equal(spark, sf_dir):
    rows = P.colon(P.form(spark, sf_dir)).where(F.col("ratio") != "n.r.").select(
        "row_id", "line_no", R.ratio_numbers(F.col("ratio")).alias("n"))
    other = (
        F.when(F.col("line_no") == 1, F.reverse("n")).when(F.col("line_no") == 2, F.slice("n", 1, 3))
        .when(F.col("line_no") == 3, F.concat("n", F.array(F.lit(1.0))))
        .otherwise(F.array(*[F.lit(v) for v in (20.0, 3.0, 21.0, 0.5)])))
    rows = rows.withColumn("o", other)
    return rows.select("row_id", (F.array_sort("n") == F.array_sort("o")).alias("equal_set"),
                       R.multiset_contains(F.col("n"), F.col("o")).alias("contained"))


@query("except_rows", sql("batch store", """
SELECT row_id FROM batch EXCEPT ALL SELECT row_id FROM store"""))
def q_except_rows(spark, sf_dir):
    return P.batch(spark, sf_dir).select("row_id").exceptAll(P.store(spark, sf_dir).select("row_id"))


@query("distinct_ordered", sql("form", """
SELECT name_raw AS value, min(row_id) AS first_at FROM form GROUP BY 1"""))
def q_distinct_ordered(spark, sf_dir):
    rows = P.form(spark, sf_dir).select(F.col("name_raw").alias("value"), "row_id")
    return J.distinct_ordered(rows, "value", "row_id")
