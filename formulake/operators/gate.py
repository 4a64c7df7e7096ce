"""Claims checked against their source text, policies, and audits of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions.numbers import parse_number
from formulake.functions.ratio import (
    colon_parts, content_key, malformed_reason, multiset_contains, plain_number, reduce_ratio,
)
from formulake.functions.text import cargo_cascade
from formulake.operators.groups import attach

PLAIN = r"[- \u2010]"


def source_index(df: DataFrame, text: str) -> DataFrame:
    """What the checks need from a source text, cut once per document: the distinct digit
    runs, every ratio as numbers in order, and the flattened lower-case text."""
    numbers = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[0-9.]+"), F.lit(0)))
    tokens = F.regexp_extract_all(F.col(text), F.lit(V.RATIO_TOKEN), F.lit(0))
    ratios = F.array_distinct(F.transform(tokens, lambda t: F.transform(
        F.split(t, r"\s*[:/]\s*"), lambda v: F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))))
    flat = F.regexp_replace(F.lower(text), PLAIN, "")
    return df.select("doc_id", numbers.alias("src_numbers"), ratios.alias("src_ratios"),
                     flat.alias("src_flat"))


def with_source(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Claims next to the index of their document; documents without claims are not indexed.

    A claim whose document is missing stays, without an index.
    """
    wanted = articles.select("doc_id", "body").join(
        claims.select("doc_id").distinct(), "doc_id", "left_semi")
    return claims.join(source_index(wanted, "body"), "doc_id", "left")


SOURCE = ["src_numbers", "src_ratios", "src_flat"]


def number_in_source(value: Column) -> Column:
    """A value counts as found in its shortest, one-decimal or whole-number spelling, at the
    start of a digit run and not followed by another digit."""
    one, whole = F.bround(value, 1), F.bround(value, 0)
    spelled = F.array_distinct(F.array(
        plain_number(value), one.try_cast("decimal(18,1)").cast("string"),
        whole.try_cast("decimal(18,0)").cast("string")))
    return F.exists(spelled, lambda s: F.exists(
        F.col("src_numbers"), lambda n: (n == s) | F.startswith(n, F.concat(s, F.lit(".")))))


def claim_values(ratio: Column) -> Column:
    return F.transform(colon_parts(ratio), parse_number)


def ratio_in_source(ratio: Column) -> Column:
    """Same values in any order, or all claimed values inside a longer source ratio."""
    want = F.array_sort(claim_values(ratio))
    return (F.size(want) >= 3) & F.exists(F.col("src_ratios"), lambda got: (
        F.array_sort(got) == want) | ((F.size(got) > F.size(want)) & multiset_contains(got, want)))


def ratio_as_written(ratio: Column) -> Column:
    return F.exists(F.col("src_ratios"), lambda got: got == claim_values(ratio))


def name_in_source(name: Column, strict: bool = False) -> Column:
    """Name, flattened name, or (lenient) a part of three letters or more occurs in the text."""
    low = F.lower(F.trim(name))
    cands = F.array(low, F.regexp_replace(low, "[- ]", ""))
    if not strict:
        cands = F.concat(cands, F.split(low, r"[-\s]"))
    usable = F.filter(F.array_distinct(cands), lambda c: F.length(c) >= 3)
    # a name that occurs in the text also occurs flattened in the flattened text
    return F.exists(usable, lambda c: F.contains(F.col("src_flat"), F.regexp_replace(c, PLAIN, "")))


VALUE_COLUMNS = {"ee": "ee", "np": "np", "ph": "ph", "size": "size", "pdi": "pdi", "zeta": "zeta"}


def gate_reason(strict: bool = False) -> Column:
    """First failing check of a claim row joined with its source index, NULL when it passes."""
    ee, name = F.col("ee"), F.trim(F.coalesce("name", F.lit("")))
    named = (name != "") & (name != V.UNNAMED)
    malformed = malformed_reason(F.col("ratio"))
    reason = (
        F.when(F.col("src_flat").isNull(), "no source document")
        .when(ee.isNull(), "no outcome")
        .when(~ee.between(*V.RANGES["ee"]), "outcome out of range")
        .when(~number_in_source(ee), "outcome not in text")
        .when(F.col("ratio_reason").isNotNull(), F.col("ratio_reason"))
        .when(malformed.isNotNull(), F.concat(F.lit("malformed ratio: "), malformed))
        .when(~ratio_in_source(F.col("ratio")), "ratio not in text")
        .when(named & F.lower(name).isin(V.NOT_IONIZABLE), "not an ionizable name")
        .when(named & ~name_in_source(name, strict), "name not in text")
    )
    for column, rule in VALUE_COLUMNS.items():
        reason = reason.when(~F.col(column).between(*V.RANGES[rule]), f"{rule} out of range")
    return reason


def with_reduced_ratio(claims: DataFrame) -> DataFrame:
    r = reduce_ratio(F.replace(F.coalesce("ratio", F.lit("")), F.lit(" "), F.lit("")))
    return claims.withColumn("_r", r).withColumns({
        "ratio": F.coalesce("_r.ratio", F.lit("")), "repair_note": F.col("_r.note"),
        "ratio_reason": F.col("_r.reason")}).drop("_r")


def gate_claims(claims: DataFrame, articles: DataFrame, strict: bool = False) -> DataFrame:
    """Claims with the reason they fail against the whole text of their document.

    A document is indexed once, next to its text; claims meet the index in one equi-join.
    """
    rows = with_source(with_reduced_ratio(claims), articles)
    return rows.withColumn("why", gate_reason(strict)).drop(*SOURCE)


def to_harvest(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Claims in the harvest schema: generic names folded, approximate flag, grade, numbers
    outside their range emptied, study id from the DOI or the document number."""
    meta = articles.select("doc_id", "doi", "title", F.col("body").alias("_body"))
    found = meta.select("doc_id", "doi", cargo_cascade(F.col("title"), F.col("_body")).alias("_cargo"))
    rows = with_reduced_ratio(claims).join(found, "doc_id", "left")
    name = F.trim(F.coalesce("name", F.lit("")))
    name = F.when((name == "") | F.lower(name).isin(V.GENERIC_NAMES), V.UNNAMED).otherwise(name)
    own = cargo_cascade(F.col("cargo_claim"))
    rows = rows.withColumns({
        "name": name, "approx": F.col("evidence").rlike(V.APPROXIMATE),
        "cargo": F.coalesce(F.nullif(own, F.lit("other")), F.col("_cargo"), own),
        "generic_name": F.when(name == V.UNNAMED, F.col("name")),
        "study": F.when(F.col("doi") != "", F.col("doi")).otherwise(
            F.concat(F.lit("PMC"), F.col("doc_id").cast("string"))),
    })
    for c in ("np", "ph", "size", "pdi", "zeta"):
        rows = rows.withColumn(c, F.when(F.col(c).between(*V.RANGES[c]), F.col(c)))
    grade = F.when(F.col("name") == V.UNNAMED, "low").when(F.col("approx"), "medium").otherwise("high")
    return rows.withColumn("grade", grade).drop("_cargo", "doi")


def policy_reason(named: bool = True, exact: bool = True, nucleic: bool = True) -> Column:
    """Unnamed, approximate, not a nucleic acid - in that order; each rule can be switched off."""
    return (
        F.when(F.lit(named) & F.col("name").isin("", V.UNNAMED), "unnamed")
        .when(F.lit(exact) & F.col("approx"), "approximate outcome")
        .when(F.lit(nucleic) & ~F.col("cargo").isin(V.NUCLEIC_CARGO),
              F.concat(F.lit("not nucleic: "), "cargo")))


def harvest(claims: DataFrame, articles: DataFrame, order: str, strict: bool = False,
            stored_keys: DataFrame | None = None, **policy: bool) -> DataFrame:
    """The whole verification of claims: schema, gate, duplicates, policy - one flagged table.

    A row is a duplicate when an accepted row with its content key came before it, or when its
    key is among those of the stored rows (``content_key``).
    """
    rows = with_source(to_harvest(claims, articles), articles)
    rows = rows.withColumn("_gate", gate_reason(strict)).drop(*SOURCE)
    rows = rows.withColumn("content_key", content_key(
        F.col("study"), F.col("name"), F.col("ratio"), F.col("ee")))
    if stored_keys is not None:
        held = stored_keys.select("content_key").distinct().withColumn("_held", F.lit(True))
        rows = rows.join(held, "content_key", "left").withColumn("_gate", F.coalesce(
            "_gate", F.when(F.col("_held"), "already stored"))).drop("_held")
    rows = rows.withColumn("_policy", F.when(F.col("_gate").isNull(), policy_reason(**policy)))
    good = F.col("_gate").isNull() & F.col("_policy").isNull()
    first = rows.where(good).groupBy("content_key").agg(
        F.count("*").alias("_n"), F.min(order).alias("_first"))
    rows = attach(rows, first, ["content_key"], "_n")
    later = F.col("_gate").isNull() & (F.col(order) > F.col("_first"))
    why = F.when(F.col("_gate").isNotNull(), F.col("_gate")).when(later, "duplicate").otherwise(
        F.col("_policy"))
    return rows.withColumn("why", why).drop("_gate", "_policy", "_n", "_first")


def acceptance(flagged: DataFrame) -> DataFrame:
    ok = F.col("why").isNull()
    return flagged.agg(
        F.count_if(ok).alias("n_accepted"), F.count_if(~ok).alias("n_rejected"),
        F.avg(ok.cast("double")).alias("rate"), F.count_distinct("doc_id").alias("n_documents"))


def audit(stored: DataFrame, articles: DataFrame) -> DataFrame:
    """Stored rows against their documents, field by field, with an overall verdict."""
    rows = with_source(stored, articles)
    want = F.array_sort(claim_values(F.col("ratio")))
    same_set = F.exists(F.col("src_ratios"), lambda got: F.array_sort(got) == want)
    name = F.trim(F.coalesce("name", F.lit("")))
    missing = F.col("src_flat").isNull()
    rows = rows.withColumns({
        "ratio_verdict": F.when(missing, "no source document").when(
            ratio_as_written(F.col("ratio")), "ok").when(same_set, "wrong_order").otherwise("not_found"),
        "ee_verdict": F.when(missing, "no source document").when(F.coalesce(number_in_source(F.col("ee")), F.lit(False)), "ok").otherwise(
            "not_found"),
        "name_verdict": F.when(missing, "no source document").when(F.lower(name).isin(V.NOT_IONIZABLE), "not_ionizable").when(
            name_in_source(name), "ok").otherwise("not_found"),
    })
    drop = (F.col("name_verdict") == "not_ionizable") | (F.col("ratio_verdict") == "not_found")
    fix = (F.col("ratio_verdict") == "wrong_order") | (F.col("ee_verdict") != "ok") | (
        F.col("name_verdict") != "ok")
    return rows.withColumn("overall", F.when(missing, "drop").when(drop, "drop").when(fix, "fix").otherwise("keep")).drop(*SOURCE)
