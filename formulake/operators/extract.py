"""Mentions, candidates and pairings read from whole article texts and their tables.

Text never leaves the row it is stored in: mentions are cut out by built-in expressions in
one pass, and only the small mention rows are grouped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions.numbers import let
from formulake.functions.ratio import (
    array_total, composition_warnings, malformed_reason_wide, ratio_text,
)
from formulake.functions.text import (
    cargo_from_words, clean_text, component_order, first_number, first_term, running, spans, window,
)
from formulake.operators.groups import top_rows
from formulake.session import materialise

SEPARATORS = r"\s*[:/;,|-]\s*"


def ratio_values(hit: Column) -> Column:
    return F.transform(F.split(hit, SEPARATORS), lambda v: v.cast("double"))


def ratio_mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Every well-formed ratio mention with position, raw text, values and sum."""
    rows = texts.select(key, F.explode(spans(F.col(text), V.RATIO_MENTION)).alias("s"))
    rows = rows.where(malformed_reason_wide(F.col("s.hit")).isNull())
    return rows.select(
        key, F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"),
        F.col("s.hit").alias("raw"), ratio_values(F.col("s.hit")).alias("vals"),
    ).withColumn("ratio", ratio_text(F.col("vals"))).withColumn("total", array_total(F.col("vals")))


EVIDENCE = 130  # characters on both sides of a mention


def ordered_mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Well-formed ratio mentions with their values in role order where the text around says all roles."""
    rows = texts.select(key, text, F.explode(spans(F.col(text), V.RATIO_MENTION)).alias("s"))
    rows = rows.where(malformed_reason_wide(F.col("s.hit")).isNull())
    rows = rows.select(
        key, F.col("s.start").cast("bigint").alias("start"), ratio_values(F.col("s.hit")).alias("vals"),
        window(F.col(text), F.col("s.start"), F.col("s.end"), EVIDENCE).alias("evidence"))
    order = component_order(F.col("evidence"))
    return rows.select(key, "start", ratio_text(reorder(F.col("vals"), order)).alias("ratio"), "evidence")


def strict_outcomes(texts: DataFrame, key: str, text: str, evidence: bool = False) -> DataFrame:
    """Outcome mentions that survive the strict rules, with the approximate flag, and the text around if asked.

    At least 20, an outcome word within 90 characters, no general statement within 130, no
    formula in the match or the 160 characters before it.
    """
    body = F.col(text)
    patterns = [V.OUTCOME_MENTION, V.OUTCOME_MENTION_VERB, V.OUTCOME_MENTION_SHORT]

    def found_by(number, pattern):
        return F.transform(spans(body, pattern), lambda s: F.struct(
            F.lit(number).alias("pattern"), s["start"].alias("start"), s["end"].alias("end"),
            s["hit"].alias("hit"), first_number(s["hit"], pattern).alias("ee")))

    found = F.concat(*[found_by(i, p) for i, p in enumerate(patterns)])
    rows = texts.select(key, text, F.explode(found).alias("m")).where(
        F.col("m.ee").between(20, 100))
    start, end = F.col("m.start"), F.col("m.end")
    before = F.greatest(F.lit(0), start - 160)
    lead = F.concat(F.col("m.hit"), F.lit(" "), F.substring(body, before + 1, start - before))
    near = window(body, start, end, 90)
    rows = rows.where(
        ~window(body, start, end, 130).rlike(V.OUTCOME_GENERAL) & near.rlike(V.OUTCOME_NEAR)
        & ~lead.rlike(V.OUTCOME_FORMULA))
    around = [window(body, start, end, EVIDENCE).alias("evidence")] if evidence else []
    return rows.select(
        key, F.col("m.pattern").alias("pattern"), start.cast("bigint").alias("start"),
        F.col("m.ee").alias("ee"), near.rlike(V.OUTCOME_BOUND).alias("approx"), *around)


def process_values(context: Column) -> list[Column]:
    return [first_number(context, p).alias(n) for n, p in V.PROCESS_PATTERNS.items()]


def doc_metadata(texts: DataFrame, key: str, text: str) -> DataFrame:
    """First DOI and its alternatives, first PMCID, title line."""
    dois = F.array_distinct(F.transform(
        F.regexp_extract_all(F.col(text), F.lit(V.DOI_PATTERN), F.lit(1)),
        lambda d: F.regexp_replace(d, r"[.,);\]]+$", "")))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda t: clean_text(t)), lambda t: t != "")
    titled = F.filter(lines, lambda t: (F.length(t) >= 20)
                      & ~F.lower(t).rlike("abstract|doi|copyright"))
    return texts.select(
        key, F.coalesce(F.get(dois, F.lit(0)), F.lit("")).alias("doi"),
        F.array_join(dois, " ").alias("doi_alternatives"),
        F.upper(F.regexp_extract(text, V.PMCID_PATTERN, 1)).alias("pmcid"),
        F.coalesce(F.get(titled, F.lit(0)), F.lit("")).alias("title"))


def reorder(values: Column, order: Column) -> Column:
    """Values in canonical role order, when all four roles were found for four values."""
    by_role = F.map_from_arrays(order, values)
    return F.when(
        (F.size(values) == 4) & (F.size(order) == 4),
        F.array(*[F.element_at(by_role, F.lit(r)) for r in V.ROLES]),
    ).otherwise(values)


def local_outcomes(context: Column) -> Column:
    """Outcome mentions of a short text as array of (start, end, ee), forward pattern first."""
    def found_by(pattern):
        return F.transform(spans(context, pattern), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            first_number(s["hit"], pattern).alias("ee")))

    both = F.concat(found_by(V.OUTCOME_MENTION), found_by(V.OUTCOME_MENTION_BACK))
    return F.filter(both, lambda m: (m["ee"] > 0) & (m["ee"] <= 100))


def approximate(text: Column, mention: Column) -> Column:
    """Whether a word of bounds or estimates stands within 90 characters of an outcome mention."""
    return F.coalesce(window(text, mention["start"], mention["end"], 90).rlike(V.OUTCOME_BOUND), F.lit(False))


def page_starts(texts: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """``(key, page, start)``: where each page of a text begins; pages count from 1.

    Positions of the page marks are cut next to the text; only they leave it.
    """
    begins = F.concat(F.array(F.lit(0)), F.transform(spans(F.col(text), separator), lambda s: s["end"]))
    pages = texts.select(key, F.posexplode(begins).alias("_i", "_s"))
    return pages.select(key, (F.col("_i") + 1).cast("bigint").alias("page"), F.col("_s").cast("bigint").alias("start"))


def with_page(rows: DataFrame, starts: DataFrame, key: str, pos: str) -> DataFrame:
    """The page that each position of a text lies on: the last one that begins at or before it.

    A null position has no page. Positions and page starts of a text meet in position order, so a text with
    many of both costs their sum and not their product.
    """
    plain = F.struct(*rows.columns)
    either = rows.select(key, F.col(pos).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_page"),
                         plain.alias("_row"))
    marks = starts.select(key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("page").alias("_page"),
                          F.lit(None).cast(rows.select(plain.alias("r")).schema["r"].dataType).alias("_row"))
    order = W.partitionBy(key).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    found = either.unionByName(marks).withColumn("_page", F.last("_page", ignorenulls=True).over(order))
    return found.where(F.col("_kind") == 1).select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_page")).alias("page"))


def text_candidates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One candidate per ratio mention with the outcome nearest to the middle of its context."""
    rows = texts.select(key, text, F.explode(spans(F.col(text), V.RATIO_MENTION)).alias("s"))
    rows = rows.where(malformed_reason_wide(F.col("s.hit")).isNull()).select(
        key, F.col("s.start").cast("bigint").alias("pos"), F.col("s.hit").alias("raw"),
        ratio_values(F.col("s.hit")).alias("vals"),
        clean_text(window(F.col(text), F.col("s.start"), F.col("s.end"), 500)).alias("context"))
    middle = F.floor(F.length("context") / 2)
    ranked = F.transform(local_outcomes(F.col("context")), lambda m, i: F.struct(
        F.abs((m["start"] + m["end"]) / 2 - middle).alias("d"), i.alias("i"), m["ee"].alias("ee"),
        m["start"].alias("start"), m["end"].alias("end")))
    rows = rows.withColumn("_m", F.array_min(ranked))
    return rows.withColumns({"ee": F.col("_m.ee"), "approx": approximate(F.col("context"), F.col("_m")),
                             "source": F.lit("text")}).drop("_m")


def caption_candidates(texts: DataFrame, key: str, text: str, width: int | None = None) -> DataFrame:
    """Candidates inside figure captions; a caption ends at the next figure, or after ``width`` if given."""
    body = F.col(text)
    limit = [] if width is None else [F.lit(width)]

    def captions(marks):
        return F.transform(marks, lambda m, i: F.struct(
            m["start"].alias("pos"),
            F.substring(body, m["start"] + 1, F.least(*limit, F.coalesce(
                F.get(marks, i + 1)["start"], F.length(body)) - m["start"], F.length(body))).alias("chunk")))

    rows = texts.select(key, F.explode(let(spans(body, V.FIGURE_MARK), captions)).alias("c"))
    rows = rows.select(key, F.col("c.pos").alias("caption_at"), F.col("c.chunk").alias("chunk"),
                       F.explode(spans(F.col("c.chunk"), V.RATIO_MENTION)).alias("s"))
    rows = rows.where(malformed_reason_wide(F.col("s.hit")).isNull())
    mention = F.get(local_outcomes(F.col("chunk")), F.lit(0))
    return rows.select(
        key, (F.col("caption_at") + F.col("s.start")).cast("bigint").alias("pos"),
        F.col("s.hit").alias("raw"), ratio_values(F.col("s.hit")).alias("vals"),
        clean_text(F.col("chunk")).alias("context"),
        mention["ee"].alias("ee"), approximate(F.col("chunk"), mention).alias("approx"),
        F.lit("caption").alias("source"))


def table_line_candidates(cells: DataFrame) -> DataFrame:
    """Candidates from the joined text of table rows (a row holds a handful of cells)."""
    lines = cells.groupBy("doc_id", "tbl_no", "row_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda c: clean_text(c["cell"])),
        " | ").alias("context"))
    rows = lines.select("doc_id", "tbl_no", "row_no", "context",
                        F.explode(spans(F.col("context"), V.RATIO_MENTION)).alias("s"))
    rows = rows.where(malformed_reason_wide(F.col("s.hit")).isNull())
    mention = F.get(local_outcomes(F.col("context")), F.lit(0))
    return rows.select(
        "doc_id", (F.col("row_no") * 1000 + F.col("s.start")).cast("bigint").alias("pos"),
        F.col("s.hit").alias("raw"), ratio_values(F.col("s.hit")).alias("vals"), "context",
        mention["ee"].alias("ee"), approximate(F.col("context"), mention).alias("approx"),
        F.lit("table").alias("source"))


def score_candidates(df: DataFrame) -> DataFrame:
    """Order, components, process values, cargo, warnings and score of raw candidates."""
    context = F.col("context")
    rows = df.withColumns({
        "order": component_order(context), "ionizable": first_term(context, V.IONIZABLE),
        "helper": first_term(context, V.HELPER), "peg": first_term(context, V.PEG_LIPID),
        "cargo": cargo_from_words(context),
    }).withColumns({
        "ratio": ratio_text(reorder(F.col("vals"), F.col("order"))),
        "order_detected": F.size("order") == 4,
    })
    base = F.lit(None).cast("double")
    for source, value in V.SCORE_BASE.items():
        base = F.when(F.col("source") == source, F.lit(value)).otherwise(base)

    def bonus(cond, value):
        return F.when(cond, value).otherwise(0.0)

    score = (
        base + bonus(F.col("ee").isNotNull(), 0.25) + bonus(F.col("ionizable").isNotNull(), 0.10)
        + bonus(F.col("helper").isNotNull(), 0.05) + bonus(F.col("peg").isNotNull(), 0.05)
        + bonus(F.col("order_detected"), 0.10))
    return rows.select(
        "*", *process_values(context), array_total(F.col("vals")).alias("total"),
        F.array_join(composition_warnings(F.col("ratio")), "; ").alias("warnings"),
        F.round(F.least(F.lit(0.99), score) + 1e-9, 3).alias("score"))


SOURCE_ORDER = ["table", "text", "caption"]


def rank_candidates(df: DataFrame, per_doc: int | None = None) -> DataFrame:
    """First of equal (ratio, outcome, name) per document, ranked; the best ``per_doc`` if given."""
    source = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source"))
    rows = df.withColumn("_so", source)
    key = ["doc_id", "ratio", "ee", "ionizable"]
    best = [F.col("score").desc(), F.col("ee").isNotNull().desc(),
            (F.col("source") == "table").desc(), F.col("_so"), F.col("pos")]
    rows = top_rows(rows, key, best, 1, "_rn").drop("_rn")
    if per_doc is not None:
        return top_rows(rows, ["doc_id"], best, per_doc, "rank").drop("_so")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(*best))).drop("_so")


def top_candidates(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("score"), F.col("ee").isNotNull().desc(), "doc_id", "source", "pos").limit(n)


def table_rows(cells: DataFrame) -> DataFrame:
    """Formulation rows of tables whose header names a ratio or an outcome column."""
    head = F.lower(F.trim("cell"))
    table = ["doc_id", "tbl_no"]
    roles = []
    for name, keys in V.TABLE_ROLES.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(head, F.lit(k))
        roles.append(F.when(hit, F.lit(name)))
    heads = cells.where(F.col("row_no") == 0).select(
        *table, "col_no", F.explode(F.array_compact(F.array(*roles))).alias("role"))
    heads = heads.groupBy(*table, "role").agg(F.min("col_no").alias("col_no"))
    data = cells.where(F.col("row_no") > 0).join(heads, [*table, "col_no"])
    wide = data.groupBy(*table, "row_no").pivot("role", list(V.TABLE_ROLES)).agg(F.first("cell"))
    hit = F.regexp_extract("ratio", V.RATIO_MENTION, 0)
    wide = wide.where((hit != "") & malformed_reason_wide(hit).isNull())

    def number(c, pattern=V.TABLE_SIGNED):
        return first_number(F.col(c), pattern).alias(c)

    return wide.select(
        *table, "row_no", ratio_text(ratio_values(hit)).alias("ratio"),
        number("ee", V.TABLE_NUMBER), number("size"), number("pdi"), number("zeta"),
    ).withColumn("grade", F.when(F.coalesce(F.col("ee"), F.lit(0.0)) != 0, "high").otherwise("medium"))


def pair_grade(ratios: DataFrame, outcomes: DataFrame, tables: DataFrame, max_gap: int = 4000,
               max_ratios: int | None = None) -> DataFrame:
    """Rows per document: table rows win; one ratio takes its outcome (medium) or the nearest
    of several (low, none beyond ``max_gap``); several ratios stand without an outcome.

    ``ratios`` have role order and evidence (``ordered_mentions``), ``outcomes`` evidence. The evidence of a row
    is the text around its ratio, and around its outcome if it has one; that of table rows is empty.
    """
    uniq = ratios.groupBy("doc_id", "ratio").agg(
        F.min("start").alias("first"), F.max("start").alias("start"), F.max_by("evidence", "start").alias("evidence"))
    # small mention rows, written once so that no text is read again
    uniq = materialise(uniq, "ratio-mentions")
    counts = uniq.groupBy("doc_id").agg(F.count("*").alias("nr"))
    uniq = uniq.join(counts, "doc_id")
    values = outcomes.groupBy("doc_id", "ee").agg(
        F.max_by(F.struct("start", "approx", "evidence"), F.struct("pattern", "start")).alias("m"))
    single = uniq.where(F.col("nr") == 1)
    from_ratio = F.greatest(F.lit(0), F.col("start") - EVIDENCE)
    gap = F.abs(F.col("m.start") - from_ratio)
    paired = single.join(values, "doc_id").groupBy("doc_id", "ratio").agg(
        F.count("*").alias("ne"), F.first("evidence").alias("evidence"),
        F.min(F.struct(gap.alias("gap"), F.col("m.start").alias("at"), F.col("ee").alias("ee"),
                       F.col("m.approx").alias("approx"), F.col("m.evidence").alias("evidence"))).alias("p"))
    lone = F.col("ne") == 1
    near = lone | (F.col("p.gap") <= max_gap)
    alone = F.substring("evidence", 1, 200)
    both = F.concat(F.substring("evidence", 1, 150), F.lit(" -> outcome: "), F.substring("p.evidence", 1, 150))
    paired = paired.select(
        "doc_id", "ratio", F.when(near, F.col("p.ee")).alias("ee"),
        F.when(near, F.col("p.approx")).otherwise(F.lit(False)).alias("approx"),
        F.when(lone, "medium").otherwise("low").alias("grade"), F.when(near, both).otherwise(alone).alias("evidence"))
    paired = materialise(paired, "paired-mentions")
    rest = uniq.join(paired.select("doc_id"), "doc_id", "left_anti")
    if max_ratios is not None:
        rest = top_rows(rest, ["doc_id"], [F.col("first")], max_ratios, "_rn")
    rest = rest.select("doc_id", "ratio", F.lit(None).cast("double").alias("ee"),
                       F.lit(False).alias("approx"), F.lit("low").alias("grade"), alone.alias("evidence"))
    text = paired.unionByName(rest).withColumn("source", F.lit("text"))
    text = text.join(tables.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = tables.select("doc_id", "ratio", "ee", F.lit(False).alias("approx"), "grade",
                         F.lit("").alias("evidence"), F.lit("table").alias("source"))
    return rows.unionByName(text)


def harvest_yield(documents: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables, rows, usable rows and status per document."""
    n_rows = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count("ee").alias("n_usable"))
    n_tables = cells.groupBy("doc_id").agg(F.count_distinct("tbl_no").alias("n_tables"))
    zero = F.lit(0)
    out = documents.select("doc_id").join(n_rows, "doc_id", "left").join(n_tables, "doc_id", "left")
    out = out.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_tables", "n_rows", "n_usable")])
    return out.withColumn("status", F.when(F.col("n_usable") > 0, "ok").when(
        F.col("n_rows") > 0, "ratio_only").otherwise("none"))


def excerpt(texts: DataFrame, key: str, text: str, maxlen: int | None = None) -> DataFrame:
    """The stretches around ratio and outcome mentions, overlapping ones merged.

    Ratio mentions reach from 600 characters ahead to 500 behind, outcome mentions from 500
    to 400; stretches closer than 80 characters become one.
    """
    body, size = F.col(text), F.length(text)

    def reach(pattern, ahead, behind, keep):
        return F.transform(F.filter(spans(body, pattern), keep), lambda s: F.struct(
            F.greatest(F.lit(0), s["start"] - ahead).alias("s"),
            F.least(size, s["end"] + behind).alias("e")))

    long_enough = lambda s: F.size(F.split(s["hit"], "[:/]")) >= 3
    reached = F.array_sort(F.concat(
        reach(V.RATIO_TOKEN, 600, 500, long_enough),
        reach(V.OUTCOME_ANCHORED, 500, 400, lambda s: F.lit(True))))

    def join(rows):
        """A stretch begins where it starts beyond all ends before it."""
        ends = running(F.transform(rows, lambda r: r["e"]), F.greatest)

        def pieces(reach_to):
            numbered = F.transform(rows, lambda r, i: F.struct(
                i.alias("i"), r["s"].alias("s"),
                (F.get(reach_to, i - 1).isNull() | (r["s"] > F.get(reach_to, i - 1) + 80)).alias("new")))
            return let(F.filter(numbered, lambda r: r["new"]), lambda first: F.transform(
                first, lambda r, k: F.struct(r["s"].alias("s"), F.get(reach_to, F.coalesce(
                    F.get(first, k + 1)["i"], F.size(rows)) - 1).alias("e"))))

        return let(ends, pieces)

    merged = let(reached, join)
    cut = F.transform(merged, lambda p: F.substring(body, p["s"] + 1, p["e"] - p["s"]))
    out = F.array_join(cut, "\n[...]\n")
    return texts.select(key, (out if maxlen is None else F.substring(out, 1, maxlen)).alias("excerpt"))


def excerpt_tables(cells: DataFrame, captions: DataFrame, max_tables: int | None = None,
                   max_rows: int | None = None, caption_chars: int | None = None,
                   row_chars: int | None = None) -> DataFrame:
    """Text block of the relevant tables of every document; limits hold where they are given."""
    table = ["doc_id", "tbl_no"]
    kept = cells if max_rows is None else cells.where(F.col("row_no") < max_rows)

    def cut(text: Column, most: int | None) -> Column:
        return text if most is None else F.substring(text, 1, most)

    lines = kept.groupBy(*table, "row_no").agg(
        F.array_sort(F.collect_list(F.struct("col_no", "cell"))).alias("c"))
    lines = lines.select(*table, "row_no", F.array_join(F.col("c.cell"), " ").alias("words"),
                         cut(F.array_join(F.col("c.cell"), " | "), row_chars).alias("line"))
    blocks = lines.groupBy(*table).agg(
        F.max(F.when(F.col("row_no") == 0, F.col("words"))).alias("head"),
        F.array_join(F.array_sort(F.collect_list(F.struct("row_no", "line")))["line"], "\n").alias("rows"))
    cap = cut(F.col("caption"), caption_chars)
    first = blocks.join(captions, table).where(
        F.lower(F.concat(cap, "head")).rlike(V.EXCERPT_TABLE_WORDS))
    if max_tables is not None:
        first = top_rows(first, ["doc_id"], [F.col("tbl_no")], max_tables, "_rn")
    first = first.select(
        *table, F.concat(F.lit("\n[TABLE] "), cap, F.lit("\n"), "rows").alias("block"))
    return first.groupBy("doc_id").agg(F.array_join(
        F.array_sort(F.collect_list(F.struct("tbl_no", "block")))["block"], "").alias("tables"))


def paged(candidates: DataFrame, starts: DataFrame) -> DataFrame:
    """Candidates with the page they stand on; those of tables have positions of their own and no page."""
    at = F.when(F.col("source") != "table", F.col("pos"))
    return with_page(candidates.withColumn("_text_pos", at), starts, "doc_id", "_text_pos").drop("_text_pos")


def draft_rows(ranked: DataFrame, meta: DataFrame, doc_cargo: DataFrame, per_doc: int | None = None) -> DataFrame:
    """Ranked and paged candidates in the draft schema, with repair notes; the first ``per_doc`` if given."""
    rows = ranked if per_doc is None else ranked.where(F.col("rank") <= per_doc)
    rows = rows.join(meta, "doc_id", "left").join(
        doc_cargo.withColumnRenamed("cargo", "doc_cargo"), "doc_id", "left")
    notes = F.concat_ws(
        " | ", F.when(F.col("raw") != F.col("ratio"), "ratio rewritten in canonical form"),
        F.when(~F.col("order_detected"), "component order not certain"),
        F.when(F.col("ee").isNull(), "no outcome in the text"))
    none = F.lit(None).cast("string")
    return rows.select(
        "doc_id", F.col("doi").alias("reference_doi"), F.col("ratio").alias("lipid_molar_ratio"),
        F.coalesce("ionizable", F.lit("")).alias("ionizable_lipid_name"),
        F.col("ee").alias("encapsulation_efficiency_percent_std_num"),
        F.col("np").alias("np_ratio_std_num"), F.col("ph").alias("buffer_ph_std_num"),
        F.coalesce("cargo", "doc_cargo").alias("cargo_type"),
        F.coalesce("helper", F.lit("")).alias("helper_lipid_name"),
        F.coalesce("peg", F.lit("")).alias("peg_lipid_name"),
        F.col("size").alias("particle_size_nm_std_num"), F.col("pdi").alias("pdi_std_num"),
        F.col("zeta").alias("zeta_potential_mv_std_num"), none.alias("ionizable_lipid_smiles"),
        F.coalesce(F.concat(F.lit("page "), F.col("page").cast("string")), F.lit("table")).alias("source_note"), "source", F.col("score").alias("confidence_score"),
        F.col("context").alias("evidence"), "title", F.col("warnings").alias("chem_warnings"),
        "pmcid", F.col("approx").alias("ee_is_approximate"), notes.alias("repair_note"))


def candidate_summary(ranked: DataFrame) -> DataFrame:
    """Ranked and paged candidates in short."""
    return ranked.select(
        "doc_id", "page", "ratio", "total", "ee", "ionizable", "helper",
        "peg", "score", "rank")
