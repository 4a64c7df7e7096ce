"""Composition ratio text to components, keys and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulake.functions.numbers import let, parse_number

COMPONENTS = ["ionizable", "helper", "chol", "peg"]
FEATURES = COMPONENTS + ["ion_to_helper", "ion_plus_chol", "log_peg"]


def ratio_numbers(text: Column) -> Column:
    """Every part as a double, unreadable parts as NULL, positions kept."""
    unified = F.translate(F.trim(text), "/-,;|", ":::::")
    return F.transform(F.split(unified, ":"), parse_number)


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def components(text: Column) -> Column:
    """Struct(n_valid, ionizable, helper, chol, peg): shares of 100, three parts mean no helper."""
    def at(nums, i):
        return F.get(nums, F.lit(i))

    def shares(nums):
        count = F.size(F.filter(nums, lambda v: v.isNotNull()))
        four = F.when(count == 4, F.array(*[at(nums, i) for i in range(4)])).when(
            count == 3, F.array(at(nums, 0), F.lit(0.0), at(nums, 1), at(nums, 2))
        )
        share = let(four, lambda c: let(array_total(c), lambda t: F.when(
            t > 0, F.transform(c, lambda v: v / t * 100))))
        return let(share, lambda c: F.struct(
            count.cast("bigint").alias("n_valid"),
            *[at(c, i).alias(name) for i, name in enumerate(COMPONENTS)],
        ))

    return let(ratio_numbers(text), shares)


def with_components(df: DataFrame, ratio: str) -> DataFrame:
    rows = df.withColumn("_c", components(F.col(ratio)))
    return rows.select(*df.columns, "_c.*")


def with_ratio_features(df: DataFrame, ratio: str) -> DataFrame:
    return derived(with_components(df, ratio))


def derived(df: DataFrame) -> DataFrame:
    """Rows with components and the features that follow from them."""
    return df.select(
        "*",
        F.try_divide(F.col("ionizable"), F.nullif(F.col("helper"), F.lit(0.0))).alias(
            "ion_to_helper"
        ),
        (F.col("ionizable") + F.col("chol")).alias("ion_plus_chol"),
        F.log1p("peg").alias("log_peg"),
    )


def peg_share(text: Column) -> Column:
    """Last component of a three- or four-part ratio as a share of 100."""
    def share(nums):
        return let(F.size(F.filter(nums, lambda v: v.isNotNull())), lambda k: F.when(
            k.isin(3, 4),
            let(array_total(F.slice(nums, F.lit(1), k)), lambda t: F.when(
                t != 0, F.get(nums, k - 1) / t * 100)),
        ))

    return let(ratio_numbers(text), share)


def colon_parts(text: Column) -> Column:
    """Trimmed non-empty parts of a ratio already written with colons."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ":"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def plain_number(value: Column) -> Column:
    """A double as its shortest plain text, never rounded; in scientific form when too large."""
    # most numbers need no decimal: whole ones, and those whose own text is plain and ends with no zero
    whole, shown = value.try_cast("bigint"), value.cast("string")
    near = F.abs(value).between(1e-3, 9_999_999)
    plain = F.regexp_replace(
        F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", ""
    )
    exact = plain.try_cast("double") == value
    return F.when(near & (whole == value), whole.cast("string")).when(near & ~F.endswith(shown, F.lit("0")), shown).when(
        exact, plain).otherwise(shown)


def ratio_text(values: Column) -> Column:
    return F.array_join(F.transform(values, plain_number), ":")


def ratio_key(text: Column) -> Column:
    """Order-free key of a ratio: parts sorted as numbers; unreadable text keys as itself."""
    raw = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return let(ratio_numbers(text), lambda nums: F.when(
        F.forall(nums, lambda v: v.isNotNull()), ratio_text(F.sort_array(nums))
    ).otherwise(raw))


def content_key(study: Column, name: Column, ratio: Column, outcome: Column) -> Column:
    """Study, name, order-free ratio and outcome in tenths."""
    def low(c):
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    tenths = F.coalesce(F.round(outcome * 10).cast("bigint").cast("string"), F.lit(""))
    return F.concat_ws("|", low(study), low(name), ratio_key(ratio), tenths)


def reduce_ratio(text: Column, keep_share: float = 0.15) -> Column:
    """Struct(ratio, note, reason): more than four parts are cut to four when the rest is small.

    ``reason`` is set when the ratio cannot be reduced.
    """
    fields = "struct<ratio:string,note:string,reason:string>"

    def long(parts, nums):
        rest = F.slice(nums, F.lit(5), F.size(nums))
        count = F.size(nums).cast("string")
        kept = F.struct(
            ratio_text(F.slice(nums, 1, 4)).alias("ratio"),
            F.concat(F.lit("first 4 of "), count, F.lit(" parts kept; dropped "),
                     ratio_text(rest)).alias("note"),
            F.lit(None).cast("string").alias("reason"),
        )

        def failed(reason):
            none = F.lit(None).cast("string")
            return F.struct(none.alias("ratio"), none.alias("note"), reason.alias("reason"))

        return (
            F.when(F.exists(nums, lambda v: v.isNull()), failed(F.lit("ratio not numeric")))
            .when(array_total(rest) > keep_share * array_total(nums),
                  failed(F.concat(F.lit("irreducible ratio of "), count, F.lit(" parts"))))
            .otherwise(kept)
        )

    def reduce(parts):
        short = F.struct(
            F.array_join(parts, ":").alias("ratio"), F.lit(None).cast("string").alias("note"),
            F.lit(None).cast("string").alias("reason"),
        )
        return F.when(F.size(parts) <= 4, short.cast(fields)).otherwise(
            let(F.transform(parts, parse_number), lambda nums: long(parts, nums).cast(fields))
        )

    return let(colon_parts(text), reduce)


def malformed_reason(text: Column, max_spread: float = 500.0) -> Column:
    """First failing form rule of a colon ratio, NULL when well formed."""
    def rule(nums):
        return (
            F.when(F.size(nums) < 3, "fewer than 3 parts")
            .when(F.exists(nums, lambda v: v.isNull()), "not numeric")
            .when(F.array_min(nums) <= 0, "value not positive")
            .when(F.array_max(nums) / F.array_min(nums) > max_spread, "extreme spread")
        )

    return let(F.transform(colon_parts(text), parse_number), rule)


def malformed_reason_wide(text: Column, max_spread: float = 10000.0) -> Column:
    """The wider rule of text mentions: 3-4 parts, zeros allowed, positive total."""
    def rule(nums):
        least = F.array_min(F.filter(nums, lambda v: v > 0))
        return (
            F.when(F.exists(nums, lambda v: v.isNull()), "not numeric")
            .when(~F.size(nums).isin(3, 4), "not 3 or 4 parts")
            .when(F.array_min(nums) < 0, "negative value")
            .when(array_total(nums) <= 0, "total not positive")
            .when(
                F.array_max(nums) / F.greatest(least, F.lit(0.0001)) > max_spread,
                "extreme spread",
            )
        )

    return let(ratio_numbers(text), rule)


def composition_warnings(text: Column) -> Column:
    """Array of warnings about a ratio, empty when there is nothing to say."""
    def warn(nums):
        def at(i):
            return F.get(nums, F.lit(i))

        detail = F.array(
            F.when(F.array_min(nums) < 0, "negative value"),
            F.when(at(0) == 0, "ionizable is 0"),
            F.when(at(3) > 10, "peg above 10"),
            F.when(at(1) > 50, "helper above 50"),
            F.when(array_total(nums) > 150, "total above 150"),
        )
        return (
            F.when(F.exists(nums, lambda v: v.isNull()), F.array(F.lit("not numeric")))
            .when(F.size(nums) != 4, F.array(F.lit("not 4 parts")))
            .otherwise(F.filter(detail, lambda w: w.isNotNull()))
        )

    return let(ratio_numbers(text), warn)


def multiset_contains(source: Column, claim: Column) -> Column:
    """Every value of claim occurs in source at least as often as in claim."""
    def count(values, v):
        return F.size(F.filter(values, lambda s: s == v))

    return F.forall(
        F.array_distinct(claim), lambda v: count(claim, v) <= count(source, v)
    )
