"""Lookups, canonical names, anti and semi joins, nearest mentions, pair counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions.text import by_spelling, flat_name, lookup_map
from formulake.operators.groups import attach, parted, value_ranks


def lookup_backfill(df: DataFrame, lookup: DataFrame, name: str, value: str) -> DataFrame:
    """Fill blank values from a (name, value) table; values already there stay.

    A name that the table has several times gives its smallest value, so no row is multiplied.
    """
    dim = lookup.toDF("_name", "_value").groupBy("_name").agg(F.min("_value").alias("_value"))
    current = F.trim(F.coalesce(F.col(value), F.lit("")))
    blank = current.isin("", "nan", "None")
    joined = df.join(dim, F.trim(F.col(name)) == F.col("_name"), "left")
    filled = F.when(blank, F.col("_value")).otherwise(F.col(value))
    return joined.withColumn(value, filled).drop("_name", "_value")


def unresolved_names(df: DataFrame, lookup: DataFrame, name: str, value: str) -> DataFrame:
    """Distinct names without a value that the lookup does not know."""
    plain = F.trim(F.coalesce(F.col(name), F.lit("")))
    blank = F.trim(F.coalesce(F.col(value), F.lit(""))).isin("", "nan", "None")
    names = df.where(blank & ~plain.isin("", "nan", "None")).select(plain.alias("name")).distinct()
    return names.join(lookup.select("name"), "name", "left_anti")


def dictionary_name(name: Column) -> Column:
    """Canonical spelling of an ionizable name by exact, then by flattened spelling."""
    table = lookup_map(by_spelling(V.ION_CANON))
    plain = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(F.try_element_at(table, F.lower(plain)),
                      F.try_element_at(table, flat_name(plain)), plain)


def canonical_names(df: DataFrame, existing: DataFrame, name: str, peg: str, smiles: str,
                    order: str) -> DataFrame:
    """Names by dictionary, then by the spelling already stored; structure text by name."""
    df = df.withColumn("_dict", dictionary_name(F.col(name)))
    known = existing.where(F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    spelled = known.groupBy(F.lower(F.trim(name)).alias("_low")).agg(
        F.count("*").alias("_n"), F.max_by(F.trim(name), F.col(order)).alias("_stored"))
    df = attach(df.withColumn("_low", F.lower("_dict")), spelled, ["_low"], "_n")
    fixed = list(V.ION_CANON)
    final = F.when(F.col("_dict").isin(fixed), F.col("_dict")).otherwise(
        F.coalesce("_stored", "_dict"))
    df = df.drop("_n", "_low").withColumn("_final", final)
    structure = existing.where(F.trim(F.coalesce(F.col(smiles), F.lit(""))) != "").groupBy(
        F.lower(F.trim(name)).alias("_low")).agg(
        F.count("*").alias("_n"), F.max_by(F.col(smiles), F.col(order)).alias("_smiles"))
    df = attach(df.withColumn("_low", F.lower("_final")), structure, ["_low"], "_n")
    unnamed = F.col("_final").isin("", V.UNNAMED)
    pegs = lookup_map(V.PEG_CANON)
    return df.withColumns({
        name: F.col("_final"),
        smiles: F.when(unnamed, "").otherwise(F.coalesce("_smiles", F.lit(""))),
        peg: F.coalesce(F.try_element_at(pegs, F.lower(F.trim(peg))), F.trim(peg)),
    }).drop("_dict", "_stored", "_final", "_low", "_n", "_smiles")


def without_existing(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; hot keys are spread."""
    have = existing.groupBy(*keys).agg(F.count("*").alias("_have"))
    return attach(df, have, keys, "_have").where(F.col("_have").isNull()).drop("_have")


def document_number(value: Column) -> Column:
    return F.trim(F.replace(F.replace(value, F.lit(".0"), F.lit("")), F.lit("PMC"), F.lit("")))


def new_documents(candidates: DataFrame, harvested: DataFrame, doc: str, position: str,
                  limit: int | None = None) -> DataFrame:
    """Candidate document ids that were not harvested, first position each, in order."""
    ids = candidates.select(document_number(F.col(doc)).alias("doc"), position).groupBy("doc").agg(
        F.min(position).alias(position))
    done = harvested.select(document_number(F.col(doc)).alias("doc")).distinct()
    fresh = ids.join(done, "doc", "left_anti")
    return fresh.orderBy(position).limit(limit) if limit is not None else fresh


def eligible_studies(df: DataFrame, study: str, min_rows: int) -> DataFrame:
    """Rows of studies with at least min_rows rows, with the study size."""
    sizes = df.groupBy(study).agg(F.count("*").alias("study_rows"))
    return attach(df, sizes, [study], "study_rows").where(F.col("study_rows") >= min_rows)


def claims_with_source(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Claims next to the whole source text: their excerpt and the article body."""
    joined = claims.join(articles.select("doc_id", "body"), "doc_id", "left")
    return joined.withColumn(
        "source", F.concat_ws(" ", "evidence", "body")
    ).drop("body")


def nearest_mention(ratios: DataFrame, outcomes: DataFrame, max_gap: int = 4000) -> DataFrame:
    """For every ratio mention the outcome mention nearest in position, if close enough.

    Both kinds are laid on one line per document; only the last outcome before and the
    first outcome after a ratio can be nearest, so no pairs are formed.
    """
    none = F.lit(None)
    line = ratios.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("kind"), "ratio",
                         none.cast("double").alias("ee"))
    line = line.unionByName(outcomes.select(
        "doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"),
        none.cast("string").alias("ratio"), "ee"))
    mention = F.when(F.col("kind") == 0, F.struct("at", "ee"))
    before = W.partitionBy("doc_id").orderBy("at", "kind", "ee").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("doc_id").orderBy(F.desc("at"), "kind", F.desc("ee")).rowsBetween(
        W.unboundedPreceding, 0)
    line = line.select(
        "*", F.last(mention, ignorenulls=True).over(before).alias("_b"),
        F.last(mention, ignorenulls=True).over(after).alias("_a"),
    ).where(F.col("kind") == 1)
    gap_b, gap_a = F.col("at") - F.col("_b.at"), F.col("_a.at") - F.col("at")
    use_b = gap_b.isNotNull() & (gap_a.isNull() | (gap_b <= gap_a))
    gap = F.when(use_b, gap_b).otherwise(gap_a)
    ee = F.when(use_b, F.col("_b.ee")).otherwise(F.col("_a.ee"))
    near = gap <= max_gap
    return line.select("doc_id", F.col("at").alias("start"), "ratio",
                       F.when(near, ee).alias("ee"), F.when(near, gap).alias("gap"))


def product(a: str, b: str) -> Column:
    """Product of two counts, which may be beyond 64 bits."""
    wide = "decimal(38,0)"
    return (F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast(wide)


def pair_agreement(df: DataFrame, study: str, y: str, pred: str, min_gap: float) -> DataFrame:
    """Per study: pairs whose outcomes differ by at least min_gap, and how many of them the
    prediction orders the same way - counted without forming a pair.

    Rows are counted per (study, outcome, prediction). Two predictions are ordered by the
    highest bit in which their ranks differ: at that bit the lower one has 0, the higher
    one 1, and all higher bits agree. So every count is sent once to each bit level, and
    inside (study, level, shared prefix) the low counts with an outcome at least min_gap
    smaller are summed by a range frame over distinct outcomes. Work grows with n log n.

    Rows are exchanged once, by study, and the levels are counted in place; those of the few heavy studies
    (``parted``) are exchanged by level, so that no task has all of one.
    """
    rows, heavy = parted(df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).select(study, y, pred), [study])
    rows = rows.repartition(study)
    counts = rows.groupBy(study, y, pred).agg(F.count("*").alias("_c"))
    whole = W.partitionBy(study)
    counts = counts.withColumns({
        "below": F.sum("_c").over(whole.orderBy(pred)) - F.sum("_c").over(W.partitionBy(study, pred)),
        "total": F.sum("_c").over(whole)})
    out = agreeing(rows, counts.where(F.col(study).isNotNull()), study, y, min_gap)
    if heavy is None:
        return out
    counts = heavy.groupBy(study, y, pred).agg(F.count("*").alias("_c"))
    ranks = value_ranks(heavy, [study], pred, 0.1).select(study, pred, "below", "total")
    return out.unionByName(agreeing(heavy, counts.join(ranks, [study, pred]), study, y, min_gap))


def agreeing(rows: DataFrame, counts: DataFrame, study: str, y: str, min_gap: float) -> DataFrame:
    """``pair_agreement`` from rows and their counts with the rows ``below`` each prediction and in ``total``."""
    bits = F.ceil(F.log2(F.col("total").cast("double"))).cast("int")
    levels = counts.where(F.col("total") > 1).withColumn(
        "_level", F.explode(F.sequence(F.lit(0), bits))
    )
    low = F.expr("shiftright(below, _level) & 1") == 0
    groups = [study, "_level", "_prefix"]
    table = levels.withColumn("_prefix", F.expr("shiftright(below, _level + 1)")).groupBy(
        *groups, y
    ).agg(
        F.sum(F.when(low, F.col("_c")).otherwise(0)).alias("_low"),
        F.sum(F.when(low, 0).otherwise(F.col("_c"))).alias("_high"),
    )
    # outcomes in integer millionths keep the range frame exact
    table = table.withColumn("_y", F.round(F.col(y) * 1000000).cast("bigint"))
    gap = round(min_gap * 1000000)
    smaller = W.partitionBy(*groups).orderBy("_y").rangeBetween(W.unboundedPreceding, -gap)
    agree = table.withColumn("_below", F.coalesce(F.sum("_low").over(smaller), F.lit(0))).groupBy(
        study).agg(F.sum(product("_high", "_below")).alias("n_agree"))
    outcomes = rows.groupBy(study, y).agg(F.count("*").alias("_c")).withColumn(
        "_y", F.round(F.col(y) * 1000000).cast("bigint"))
    lower = W.partitionBy(study).orderBy("_y").rangeBetween(W.unboundedPreceding, -gap)
    pairs = outcomes.withColumn("_below", F.coalesce(F.sum("_c").over(lower), F.lit(0))).groupBy(
        study).agg(F.sum(product("_c", "_below")).alias("n_pairs"))
    return pairs.join(agree, study, "left").select(
        study, "n_pairs", F.coalesce("n_agree", F.lit(0)).alias("n_agree"))


def distinct_ordered(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(value).agg(F.min(position).alias("first_at"))
