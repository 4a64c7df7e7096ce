"""Formulation, article and prediction tables derived from the given tables.

Each view exists as a DataFrame here and as SQL in sqlviews.py. Text is built from
integers only, so both engines print the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formulake.functions.numbers import r6, where_known
from formulake.functions.outcome import clean_outcome
from formulake.functions.ratio import COMPONENTS, components, derived, peg_share
from formulake.operators.folds import attach_folds
from formulake.operators.evaluate import linear_oof
from formulake.session import materialise, spread, tune

NAMES = ["SM-102", "sm102", "ALC-0315", "MC3", "DLin-MC3-DMA", "dlin-mc3-dma", "c12200",
         "Lipid 5", "ionizable lipid", "DSPC"]
PEGS = ["DMG-PEG", "PEG-DMG", "DMG-PEG2000", "C14-PEG 2000"]
CARGOS = ["mRNA", "siRNA", "m-RNA", "plasmid DNA", "protein", "ovalbumin", "", "Curcumin"]
ARTICLE_NAMES = ["SM-102", "ALC-0315", "MC3", "DLin-MC3-DMA", "C12-200", "Lipid 5"]
ARTICLE_CARGOS = ["mRNA", "siRNA", "plasmid", "peptide", "antisense oligo"]
FILLER = "blank filler words without any number "


STORED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; spark.sql.files.maxPartitionBytes decides its splits."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(name: str):
    """Write a view once per session and folder, as the formulation store would hold it."""

    def wrap(build):
        def run(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
            label = "-".join([name, *map(str, args)])
            key = (spark.sparkContext.applicationId, sf_dir, label)
            if key not in STORED:
                STORED[key] = materialise(build(spark, sf_dir, *args), label)
            return STORED[key]

        run.__name__ = name
        return run

    return wrap


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def text(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def tenths_text(value: Column) -> Column:
    return F.concat(text(F.floor(value / 10).cast("bigint")), F.lit("."), text(value % 10))


def with_parts(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """Line items with the name of their part."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # joined while the rows are narrow
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")


def as_with_parts(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """The rows of ``with_parts`` without the name: a part that is listed again gives its line items again.

    Parts that are listed more than once are looked for when the plan is made; without any, nothing is joined.
    """
    listed = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.count("*").cast("int").alias("_times"))
    again = listed.where((F.col("_times") > 1) & F.col("p_partkey").isNotNull())
    if again.isEmpty():
        return items
    rows = items.join(again, F.col("l_partkey") == F.col("p_partkey"), "left")
    times = F.sequence(F.lit(1), F.coalesce("_times", F.lit(1)))
    return rows.select(*items.columns, F.explode(times).alias("_time")).drop("_time")


def form_rows(spark: SparkSession, sf_dir: str, named: bool = True) -> DataFrame:
    """Messy formulation rows, one per line item; without the columns of the part's name if not ``named``."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    items = spread(table(spark, sf_dir, "lineitem").select(*columns), "l_orderkey", "l_linenumber")
    items = (with_parts if named else as_with_parts)(spark, sf_dir, items)
    order, line, part, supp = (
        F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey"),
        F.col("l_suppkey"),
    )
    qty = F.col("l_quantity").cast("bigint")
    disc = F.round(F.col("l_discount") * 100).cast("bigint")
    tax = F.round(F.col("l_tax") * 100).cast("bigint")
    base = items.select(
        F.concat_ws(
            "-", text(order), text(part), text(supp), text(line), text(qty),
            text(F.col("l_shipdate").cast("date")),
        ).alias("row_id"),
        F.concat(F.lit("10.1000/o"), text(order)).alias("study_small"),
        F.concat(F.lit("10.1000/s"), text(supp)).alias("study_big"),
        order.alias("order_no"), line.alias("line_no"), part.alias("part_no"),
        (qty + 10).alias("c1"),
        F.when(line != 7, 3 * line).alias("c2"),
        (20 + part % 30).alias("c3"),
        (5 + 10 * tax).alias("c4t"),
        F.when(order % 211 == 0, F.lit(0)).otherwise(
            F.least(
                F.lit(1000), 550 + 30 * (supp % 7) + 20 * disc - 25 * tax + 2 * qty,
            )
        ).cast("bigint").alias("y10"),
        (1 + qty % 60).cast("double").alias("np"),
        (3 + line).cast("double").alias("ph"),
        (20 + part % 600).cast("double").alias("size"),
        ((supp % 120).cast("double") / 100).alias("pdi"),
        (order % 150 - 75).cast("double").alias("zeta"),
        pick(NAMES + [""], F.least(F.lit(10), part % 14)).alias("_name"),
        pick(PEGS, part % 4).alias("peg_name"),
        pick(CARGOS, (part + line) % 8).alias("cargo_raw"),
        qty.alias("qty"), *(["p_name"] if named else []),
    )
    sep = pick([":", "/", ";", "|"], F.col("order_no") % 4)
    extra = F.when(
        F.col("line_no") == 6, F.when(F.col("part_no") % 2 == 0, F.lit("2")).otherwise(F.lit("60"))
    )
    joined = F.concat_ws(
        ":", text("c1"), text("c2"), text("c3"), tenths_text(F.col("c4t")), extra
    )
    y10 = F.col("y10")
    shown = tenths_text(y10)
    whole = F.floor(y10 / 10).cast("bigint")
    kind = F.col("order_no") % 8
    outcome = (
        F.when(kind == 0, shown)
        .when(kind == 1, F.concat(shown, F.lit(" ± 2.5")))
        .when(kind == 2, F.concat(text(whole), F.lit("-"), text(whole + 5)))
        .when(kind == 3, F.concat(shown, F.lit(" (n=3)")))
        .when(kind == 4, F.concat(F.lit("0."), F.lpad(text(F.least(F.lit(99), whole)), 2, "0")))
        .when(kind == 5, F.concat(F.lit(">"), shown))
        .when(kind == 6, F.when(F.col("line_no") == 1, F.lit("n.d.")).otherwise(shown))
        .otherwise(F.when(F.col("line_no") == 2, text(whole + 40)).otherwise(shown))
    )
    names = [
        F.when(F.col("_name") != "", F.col("_name"))
        .when(F.col("order_no") % 2 == 0, F.upper("p_name"))
        .otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("name_raw"),
        F.col("p_name").alias("part_name"),
    ]
    return base.select(
        "row_id", "study_small", "study_big", "order_no", "line_no", "part_no",
        F.when(F.col("part_no") % 97 == 0, "n.r.")
        .otherwise(F.replace(joined, F.lit(":"), sep)).alias("ratio_raw"),
        "y10", (y10 / 10).alias("y"), outcome.alias("outcome_raw"),
        *(names if named else []), "peg_name", "cargo_raw",
        "np", "ph", "size", "pdi", "zeta", "qty",
    )


@stored("form")
def form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formulation rows as a store holds them; evaluation views read the rows as they are made."""
    return form_rows(spark, sf_dir)


def colon(df: DataFrame) -> DataFrame:
    """Formulations with the ratio already written with colons."""
    return df.withColumn("ratio", F.translate("ratio_raw", "/;|", ":::"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Rows, first lines also with two components swapped; each row is read once."""
    part = F.split("ratio", ":")
    swapped = F.concat_ws(
        ":", F.get(part, F.lit(1)), F.get(part, F.lit(0)), F.slice(part, F.lit(3), F.size(part))
    )
    same = F.struct("row_id", "ratio")
    copy = F.struct(F.concat("row_id", F.lit("-r")).alias("row_id"), swapped.alias("ratio"))
    both = F.when((F.col("line_no") == 1) & (F.size(part) >= 3), F.array(same, copy)).otherwise(F.array(same))
    out = rows.select(*[c for c in rows.columns if c not in ("row_id", "ratio")], F.explode(both).alias("_one"))
    return out.select(*[F.col(f"_one.{c}").alias(c) if c in ("row_id", "ratio") else F.col(c) for c in rows.columns])


BATCH = ["row_id", "study_big", "ratio", "outcome_raw", "name_raw", "peg_name", "cargo_raw", "part_no", "line_no"]


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows: all orders, plus copies of first lines with two components swapped."""
    return with_copies(colon(form(spark, sf_dir)).select(*BATCH))


def batch_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study and ratio of the incoming rows, as they are made: no part is joined, nothing is written."""
    rows = colon(form_rows(spark, sf_dir, named=False))
    return with_copies(rows.select("row_id", "study_big", "ratio", "part_no", "line_no"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows already stored: the other orders and a fifth of the incoming ones."""
    rows = colon(form(spark, sf_dir))
    return rows.where((F.col("order_no") % 10 != 0) | (F.col("part_no") % 5 == 0))


def evaluated(rows: DataFrame) -> DataFrame:
    """Rows with a readable outcome and last component: their outcome ``y`` and share ``x``."""
    found = {"y": r6(clean_outcome(F.col("outcome_raw"))), "x": r6(peg_share(F.col("ratio_raw")))}
    return where_known(rows, found, ["y", "x"]).drop("ratio_raw", "outcome_raw")


@stored("obs")
def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows: readable outcome and ratio, and study keys. No part is joined for them."""
    rows = form_rows(spark, sf_dir, named=False)
    return evaluated(rows.select("row_id", "study_small", "study_big", "qty", "ratio_raw", "outcome_raw"))


@stored("obs_named")
def obs_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows with their name."""
    return evaluated(form_rows(spark, sf_dir).select("row_id", "study_big", "name_raw", "ratio_raw", "outcome_raw"))


def composed(rows: DataFrame) -> DataFrame:
    """Rows with a readable outcome and composition: outcome, shares and the features that follow from them."""
    found = {"y": r6(clean_outcome(F.col("outcome_raw"))), "_c": components(F.col("ratio_raw"))}
    rows = where_known(rows, found, ["y", "_c.peg"])
    return derived(rows.select(*[c for c in rows.columns if c != "_c"], "_c.*"))


@stored("featured")
def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composed(form_rows(spark, sf_dir))


@stored("shares")
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compositions of ``featured`` alone. No part is joined for them."""
    rows = form_rows(spark, sf_dir, named=False)
    return composed(rows.select("row_id", "study_big", "ratio_raw", "outcome_raw")).select(
        "row_id", "study_big", *COMPONENTS)


@stored("oof")
def oof(spark: SparkSession, sf_dir: str, study: str = "study_big", k: int = 5) -> DataFrame:
    """Out-of-fold predictions of the outcome from the last component, by study folds."""
    rows = obs(spark, sf_dir).select("row_id", F.col(study).alias("study"), "x", "y")
    return linear_oof(attach_folds(rows, "study", k), "x", "y")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article bodies: every document with a title, ids and a formulation paragraph."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    name = pick(ARTICLE_NAMES, k % 6)
    n = 60 + k % 39
    ratio = F.concat(
        text(40 + k % 15), F.lit(":"), text(5 + k % 10), F.lit(":"), text(30 + k % 9),
        F.lit(".5:1.5"),
    )
    ratio2 = F.concat(
        text(41 + k % 15), F.lit(":"), text(5 + k % 10), F.lit(":"), text(30 + k % 9),
        F.lit(".5:1.5"),
    )

    def mixed(r):
        return F.concat(
            F.lit("\nThe "), name,
            F.lit(", DSPC, cholesterol and DMG-PEG2000 were mixed at a molar ratio of "), r,
            F.lit(" and formed particles."),
        )

    eff = F.concat(F.lit(" The encapsulation efficiency was "), text(n), F.lit("%."))
    later = F.concat(
        F.lit(" After storage the encapsulation efficiency was "), text(n - 10), F.lit("%.")
    )
    about = F.concat(
        F.lit(" The encapsulation efficiency was approximately "), text(n), F.lit("%.")
    )
    process = F.concat(
        F.lit(" At pH "), text(4 + k % 3), F.lit(".0 and N/P "), text(3 + k % 6),
        F.lit(", particle size "), text(80 + k % 60), F.lit(" nm, PDI 0."),
        F.lpad(text(k % 40), 2, "0"), F.lit(", zeta -"), text(k % 20), F.lit(" mV."),
    )
    caption = F.when(
        k % 9 == 0,
        F.concat(F.lit("\nFigure 1. Particles at "), ratio, F.lit(" with EE of "), text(n),
                 F.lit("%.")),
    ).otherwise("")
    kind = k % 8
    para = (
        F.when(kind == 0, F.concat(mixed(ratio), eff, process))
        .when(kind == 1, F.concat(mixed(ratio), eff, later, process))
        .when(kind == 2, F.concat(mixed(ratio), mixed(ratio2), eff, later))
        .when(kind == 3, F.concat(mixed(ratio), F.repeat(F.lit(FILLER), 150), eff, later))
        .when(kind == 4, F.concat(F.lit("\n"), eff))
        .when(kind == 5, F.concat(
            mixed(ratio), F.lit(" EE (%) = (m2 - m1) / m2 × 100%."),
            F.lit(" The encapsulation efficiency typically exceeds 90%."),
        ))
        .when(kind == 6, F.lit(""))
        .otherwise(F.concat(mixed(F.concat(ratio, F.lit(":2"))), about))
    )
    title = F.concat(
        F.lit("Delivery study "), text(k), F.lit(" of "), pick(ARTICLE_CARGOS, k % 5),
        F.lit(" particles in vivo"),
    )
    ids = F.when(k % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("doi: 10.5555/st."), text(k), F.lit(" ref PMC"), text(1000000 + k))
    )
    body = F.concat(title, F.lit("\n"), ids, F.lit("\n"), F.col("text"), para, caption)
    return docs.select("doc_id", title.alias("title"), body.alias("body"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten claims per article that has a ratio and an outcome: true and altered ones.

    A few more name documents that don't exist.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    v = F.col("variant")
    missing = docs.where(k % 40 == 0).select((1000000002 + k).alias("doc_id"))
    rows = docs.where((k % 8).isin(0, 1, 7)).unionByName(missing).withColumn(
        "variant", F.explode(F.sequence(F.lit(0), F.lit(9)))
    )
    a, b, c = text(40 + k % 15), text(5 + k % 10), F.concat(text(30 + k % 9), F.lit(".5"))
    ratio = F.concat_ws(":", a, b, c, F.lit("1.5"))
    return rows.select(
        F.concat(text(k), F.lit("-"), text(v)).alias("claim_id"), k.alias("doc_id"),
        v.cast("bigint").alias("variant"),
        F.when(v == 3, "DSPC").when(v == 5, "FTT5").when(k % 11 == 0, "cationic lipid")
        .otherwise(pick(ARTICLE_NAMES, k % 6)).alias("name"),
        F.when(v == 2, F.concat_ws(":", F.lit("1.5"), c, b, a))
        .when(v == 4, F.concat_ws(":", a, b, c, F.lit("2.75")))
        .when(v == 9, F.concat_ws(":", a, b, c, F.lit("1.5"), F.lit("60")))
        .otherwise(ratio).alias("ratio"),
        F.when(v == 8, F.lit(None)).when(v == 6, F.lit(120.0))
        .when(v == 1, (60 + k % 39) + F.lit(0.7)).otherwise((60 + k % 39).cast("double"))
        .alias("ee"),
        F.when(v == 7, F.lit(12.0)).otherwise((4 + k % 3).cast("double")).alias("ph"),
        (3 + k % 6).cast("double").alias("np"), (80 + k % 60).cast("double").alias("size"),
        F.lit(0.15).alias("pdi"), (-(k % 20)).cast("double").alias("zeta"),
        pick(PEGS, k % 4).alias("peg_name"), F.lit("DSPC").alias("helper_name"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "unclear").otherwise("mRNA").alias("cargo_claim"),
        F.concat(
            F.when(k % 8 == 7, "approximately ").otherwise("measured "), text(60 + k % 39),
            F.lit("% encapsulation"),
        ).alias("evidence"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells of every fifth article: a header row and three data rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    k, r = F.col("doc_id"), F.col("row_no")
    rows = docs.where(k % 5 == 0).withColumn(
        "row_no", F.explode(F.sequence(F.lit(0), F.lit(3)))
    )
    head = ["Sample", "Lipid molar ratio", "EE (%)", "Size (nm)", "PDI", "Zeta (mV)"]
    body = [
        F.concat(F.lit("F"), text(r)),
        F.when((k % 25 == 0) & (r == 3), "n.r.").otherwise(F.concat_ws(
            ":", text(40 + (k + r) % 15), text(5 + k % 10), F.concat(text(30 + r), F.lit(".5")),
            F.lit("1.5"))),
        F.when((k + r) % 4 == 0, "-").otherwise(F.concat(text(60 + (k + 7 * r) % 40), F.lit(" ± 2"))),
        text(70 + (k + r) % 50), F.concat(F.lit("0."), text(10 + (k + r) % 30)),
        F.concat(F.lit("-"), text((k + r) % 30)),
    ]
    line = F.array(*[
        F.when(r == 0, F.lit(h)).otherwise(b) for h, b in zip(head, body)
    ])
    wide = rows.select(
        k.alias("doc_id"), F.lit(1).cast("bigint").alias("tbl_no"), r.cast("bigint").alias("row_no"),
        F.when(k % 10 == 0, F.slice(line, 1, 5)).otherwise(line).alias("line"),
    )
    return wide.select(
        "doc_id", "tbl_no", "row_no", F.posexplode("line").alias("col_no", "cell")
    ).withColumn("col_no", F.col("col_no").cast("bigint"))


def lipid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name to structure text, one row per part name."""
    parts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    k = F.col("k").cast("int")
    return parts.where(F.col("k") % 7 != 0).select(
        F.col("p_name").alias("name"),
        F.concat(
            F.lit("C"), F.repeat(F.lit("C"), k % 5), F.lit("N("), F.repeat(F.lit("C"), k % 3 + 1),
            F.lit(")CC(=O)O"), F.repeat(F.lit("n"), k % 2),
        ).alias("smiles"),
    )
