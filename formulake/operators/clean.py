"""Column discovery, cleaning, validation and quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions.numbers import parse_number
from formulake.functions.outcome import as_percent, clean_outcome, naive_outcome
from formulake.functions.ratio import array_total, ratio_numbers
from formulake.operators.groups import first_rows, top_rows

# Name parts that give a column its role, and exact names of study keys.
PROCESS_WORDS = ["np_ratio", "n_p_ratio", "flow", "buffer_ph", "total_lipid", "lipid_conc",
                 "weight_ratio", "mixing", "dilution", "ionic"]
MEASURED_WORDS = ["particle_size", "pdi", "zeta"]
CATEGORY_WORDS = ["cargo", "nucleic_acid", "payload", "helper_lipid_name", "peg_lipid_name",
                  "ionizable_lipid_name", "apparatus", "method"]
STUDY_NAMES = ["reference_doi", "doi", "DOI", "ref_doi", "pmid", "PMID", "reference",
               "reference_id", "study_id", "paper_id", "source_id", "citation", "publication",
               "reference_title", "title"]
STUDY_WORDS = ["doi", "pmid", "referen", "citation", "study"]


def has_word(name: str, words: list[str]) -> bool:
    return any(w in name.lower() for w in words)


def discover_columns(df: DataFrame) -> DataFrame:
    """(position, column, role) by name and one pass of data tests."""
    first: dict[str, str] = {}
    for name in df.columns:
        if has_word(name, ["molar_ratio", "lipid_ratio"]):
            first.setdefault("ratio", name)
        if "smiles" in name.lower():
            first.setdefault("smiles", name)
        if "encapsulation" in name.lower():
            first.setdefault("target", name)
    if V.OUTCOME in df.columns:
        first["target"] = V.OUTCOME
    process = [c for c in df.columns if has_word(c, PROCESS_WORDS)]
    measured = [c for c in df.columns if has_word(c, MEASURED_WORDS)]
    category = [c for c in df.columns if has_word(c, CATEGORY_WORDS)]

    def numeric(c):
        return F.avg(parse_number(F.col(c).cast("string")).isNotNull().cast("double"))

    tests = df.agg(
        *[numeric(c).alias(f"s{i}") for i, c in enumerate(df.columns) if c in process + measured],
        *[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(df.columns)
          if c in category],
    )
    found = [
        F.struct(F.lit(df.columns.index(c)).cast("bigint").alias("position"),
                 F.lit(c).alias("column"), F.lit(role).alias("role"), F.lit(True).alias("keep"))
        for role, c in first.items()
    ]
    for i, c in enumerate(df.columns):
        checks: list[tuple[str, Column]] = []
        if c in process:
            checks.append(("process", F.col(f"s{i}") > 0.1))
        if c in measured:
            checks.append(("measured", F.col(f"s{i}") > 0))
        if c in category:
            checks.append(("category", (F.col(f"d{i}") > 1) & (F.col(f"d{i}") <= 40)))
        found += [
            F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column"),
                     F.lit(role).alias("role"), test.alias("keep"))
            for role, test in checks
        ]
    return tests.select(F.explode(F.array(*found)).alias("f")).where("f.keep").select(
        "f.position", "f.column", "f.role"
    )


def discover_group_key(df: DataFrame) -> DataFrame:
    """One row: the study key column, whether one was found, and the number of studies."""
    ranked = [c for c in STUDY_NAMES if c in df.columns]
    ranked += [c for c in df.columns if has_word(c, STUDY_WORDS) and c not in ranked]
    stats = df.agg(
        F.count("*").alias("n"),
        *[F.count(F.col(c)).alias(f"f{i}") for i, c in enumerate(ranked)],
        *[F.count_distinct(F.lower(F.trim(F.col(c)))).alias(f"d{i}") for i, c in enumerate(ranked)],
    )

    def usable(i):
        return F.col(f"f{i}") > 0.5 * F.col("n")

    name = F.coalesce(*[F.when(usable(i), F.lit(c)) for i, c in enumerate(ranked)], F.lit(None))
    count = F.coalesce(*[F.when(usable(i), F.col(f"d{i}")) for i, _ in enumerate(ranked)],
                       F.col("n"))
    return stats.select(name.alias("key_column"), name.isNotNull().alias("found"),
                        count.alias("n_studies"))


def study_defaults(df: DataFrame, defaults: DataFrame, study: str, columns: list[str]) -> DataFrame:
    """Fill empty cells from the study's defaults; rows without a study are marked."""
    other = defaults.select(study, *[F.col(c).alias(f"_d_{c}") for c in columns])
    joined = df.join(other, study, "left")
    kept = [c for c in df.columns if c not in columns]
    filled = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_d_{c}")).alias(c) for c in columns]
    known = F.trim(F.coalesce(F.col(study), F.lit(""))) != ""
    return joined.select(
        *kept, *filled, F.when(known, "ok").otherwise("no study id").alias("status")
    )


def outcome_recovery(df: DataFrame, text: str) -> DataFrame:
    """Rows the text parser reads, the naive rule reads, and the gain between them."""
    new, old = clean_outcome(F.col(text)), naive_outcome(F.col(text))
    rows = df.select(new.between(0, 100).alias("new"), old.between(0, 100).alias("old"))
    good, was = F.coalesce("new", F.lit(False)), F.coalesce("old", F.lit(False))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_clean"), F.count_if(was).alias("n_naive"),
        F.count_if(good & ~was).alias("n_recovered"),
    )


def working_frame(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """First row per key, outcome read, unreadable outcomes dropped."""
    rows = first_rows(df, [k for k in keys if k in df.columns], [F.col(order)])
    return rows.withColumn("y", clean_outcome(F.col(text))).where(F.col("y").isNotNull())


def working_waterfall(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Counts per step, without running the steps one by one."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.first(text).alias("_t"))
    return per_key.agg(
        F.sum("n").alias("n_input"), F.count("*").alias("n_deduped"),
        F.count_if(clean_outcome(F.col("_t")).isNotNull()).alias("n_working"),
    )


def range_checks(columns: dict[str, str]) -> Column:
    """First column outside its physical range, NULL when all fit."""
    rules = [
        F.when(~F.col(c).between(*V.RANGES[r]), F.lit(f"{r} out of range"))
        for c, r in columns.items()
    ]
    return F.coalesce(*rules)


def range_nullify(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({
        c: F.when(F.col(c).between(*V.RANGES[r]), F.col(c)) for c, r in columns.items()
    })


def profile_outcome(df: DataFrame, value: str) -> DataFrame:
    """Counts of suspicious values and the cleaned distribution, one row."""
    raw = F.col(value)
    y = as_percent(raw, keep_zero=True)
    return df.withColumn("_y", y).agg(
        F.count("*").alias("n"), F.count(raw).alias("n_valid"),
        F.count_if((raw > 0) & (raw <= 1)).alias("n_fraction"),
        F.count_if(raw > 100).alias("n_over"), F.count_if(raw < 0).alias("n_negative"),
        F.count("_y").alias("n_clean"), F.avg("_y").alias("mean"),
        F.stddev_samp("_y").alias("sd"),
        F.avg((F.col("_y") > 90).cast("double")).alias("share_over_90"),
    )


def unknown_spellings(df: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    """Distinct values that are not accepted after lower case and removal of blanks, dashes."""
    plain = F.translate(F.lower(F.trim(F.col(column))), "- ", "")
    return (
        df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").where(~plain.isin(accepted))
        .select(F.trim(F.col(column)).alias("value")).distinct()
    )


def validate_report(df: DataFrame, study: str, ratio: str, outcome: str, cargo: str, smiles: str,
                    strict: bool = False) -> DataFrame:
    """Rule, level, count and up to three sample values, one row per rule.

    All counts come from one aggregate; samples are the three smallest distinct values of
    the rules that show some.
    """
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (study, ratio, outcome)}
    rows = df.select(
        text[study].alias("study"), text[ratio].alias("ratio"), text[outcome].alias("ee_text"),
        F.trim(F.coalesce(F.col(cargo), F.lit(""))).alias("cargo"),
        F.trim(F.coalesce(F.col(smiles), F.lit(""))).alias("smiles"),
        ratio_numbers(F.col(ratio)).alias("nums"),
    ).select(
        "*", parse_number(F.col("ee_text")).alias("ee"),
        F.size(F.filter("nums", lambda v: v.isNotNull())).alias("k"),
        array_total(F.col("nums")).alias("total"),
    )
    flags = {
        "empty_study": F.col("study") == "",
        "empty_ratio": F.col("ratio") == "",
        "empty_outcome": F.col("ee_text") == "",
        "unreadable_ratio": ~F.col("k").isin(3, 4),
        "odd_total": (F.col("k") == 4) & ((F.col("total") < 80) | (F.col("total") > 120)),
        "unreadable_outcome": F.col("ee").isNull(),
        "fraction_outcome": (F.col("ee") > 0) & (F.col("ee") <= 1),
        "outcome_out_of_range": (F.col("ee") < 0) | (F.col("ee") > 100),
        "odd_study_id": ~F.col("study").rlike(r"^(10\.\d{4,9}/|PMID|pmid|https?://)"),
        "unknown_cargo": (F.col("cargo") != "") & ~F.translate(
            F.lower("cargo"), "- ", "").isin(V.CARGO_SPELLINGS),
        "smiles_missing": (F.col("smiles") == "") | (F.lower("smiles") == "nan"),
    }
    fails = ["empty_study", "empty_ratio", "empty_outcome", "unreadable_ratio",
             "unreadable_outcome", "outcome_out_of_range"]
    shows = {"unreadable_ratio": "ratio", "odd_study_id": "study", "unknown_cargo": "cargo"}
    counts = rows.agg(
        *[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in flags.items()],
        F.count_distinct(F.lower("study")).alias("few_studies"),
    )
    parts = []
    for name in [*flags, "few_studies"]:
        n = F.col(name)
        level = (
            F.when(n == 0, "ok").otherwise("fail" if name in fails else "info"
                                           if name == "smiles_missing" else "warn")
            if name != "few_studies"
            else F.when(n < 10, "fail" if strict else "warn").otherwise("ok")
        )
        parts.append(F.struct(F.lit(name).alias("rule"), level.alias("level"), n.alias("n")))
    report = counts.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    marked = F.array(*[
        F.when(flags[name], F.struct(F.lit(name).alias("rule"), F.col(c).alias("sample")))
        for name, c in shows.items()
    ])
    seen = (
        rows.select(F.explode(F.filter(marked, lambda s: s.isNotNull())).alias("s")).select("s.*")
        .distinct()
    )
    samples = (
        top_rows(seen, ["rule"], [F.col("sample")], 3, "_rn").groupBy("rule")
        .agg(F.array_join(F.array_sort(F.collect_list("sample")), ", ").alias("samples"))
    )
    return report.join(samples, "rule", "left").withColumn(
        "samples", F.coalesce("samples", F.lit(""))
    )


def validate_upload(df: DataFrame, columns: dict[str, str], required: list[str], strict: bool = False) -> DataFrame:
    """``validate_report`` of a table that may lack columns, with an overall verdict.

    ``columns`` names the table's study, ratio, outcome, cargo and smiles columns. If a ``required`` one of
    these is not there, only that is reported. A missing optional column counts as empty. The rule
    ``missing_columns`` says which are missing, the rule ``passed`` how many rules failed: "ok" if none.
    """
    spark = df.sparkSession
    there = {c.lower() for c in df.columns}
    missing = [columns[role] for role in required if columns[role].lower() not in there]
    head = spark.createDataFrame(
        [("missing_columns", "fail" if missing else "ok", len(missing), ", ".join(missing))],
        "rule string, level string, n bigint, samples string")
    if missing:
        report = head
    else:
        empty = {name: F.lit(None).cast("string") for name in columns.values() if name.lower() not in there}
        report = head.unionByName(validate_report(df.withColumns(empty), **columns, strict=strict))
    failed = F.count_if(F.col("level") == "fail")
    verdict = report.agg(
        F.lit("passed").alias("rule"), F.when(failed == 0, "ok").otherwise("fail").alias("level"),
        failed.alias("n"), F.lit("").alias("samples"))
    return report.unionByName(verdict)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that fires, in order."""
    return F.coalesce(*[F.when(cond, F.lit(reason)) for cond, reason in rules])


def all_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
