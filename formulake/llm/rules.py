"""Quality rules as a short-circuit cascade, in built-in expressions only.

Each rule is an expression over a text and the list of its words, which is split once for all rules.
``plan_cascade`` runs every rule alone over a bounded sample, notes its time beyond the split and its
share of rejected rows, and orders the rules by rejection per second. ``first_failed`` is one
CASE over the rules in that order, so Spark computes a later rule only for rows that passed the
earlier ones. The verdict of a row doesn't depend on the order; only the reason's name does.

Rows: a null text counts as empty, and fails for having too few words. Repeated rows and ties
get the same verdict, an empty table gives an empty result, extra columns are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulake.functions.numbers import let
from formulake.llm.common import BLANK_CHARS, fresh, known_text, words
from formulake.session import materialise

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MEAN_WORD = (2.0, 16.0)  # code points
MAX_SYMBOLS = 0.1  # per word
MAX_DUPLICATE_LINES = 0.6  # of the lines with a word
SAMPLE_ROWS = 2000
RUNS = 3  # of a rule over the sample; the median counts


def n_words(list_of: Column) -> Column:
    return F.size(list_of).cast("bigint")


def word_chars(list_of: Column) -> Column:
    return F.length(F.array_join(list_of, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint")


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, BLANK_CHARS, "")) > 0)


def n_dup_lines(text: Column) -> Column:
    return let(
        filled_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))
    ).cast("bigint")


def covered(starts: Column, width: int) -> Column:
    """Positions in windows of this width that begin at these ascending starts."""
    own = F.transform(
        starts, lambda at, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - at, F.lit(width)))
    )
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, n: total + n)


def n_repeat_words(list_of: Column, width: int = 3) -> Column:
    """Words of a list inside windows of three words that occur twice or more in it.

    Windows are compared by a 64-bit hash of their words. Only a text in which some hash comes
    twice is sorted by (hash, position), which costs n log n of its words.
    """

    def place(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def mark(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda x, k: (
                F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))
            ))
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(starts, lambda s: covered(s, width))

        sorted_out = let(pairs, mark)
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unique, F.lit(0).cast("bigint")).otherwise(sorted_out)

    last = F.size(list_of) - width
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get(list_of, i + k) for k in range(width)]),
    )
    return F.when(last < 1, F.lit(0).cast("bigint")).otherwise(let(windows, place))


def base_failed(words_: Column, repeated: Column) -> Column:
    return (words_ < MIN_WORDS) | (100 * repeated > MAX_REPEATED * words_)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Column, Column], Column]  # of a text and its words


RULES = (
    Rule("few_words", lambda t, w: n_words(w) < MIN_WORDS),
    Rule("repeated_words", lambda t, w: 100 * n_repeat_words(w) > MAX_REPEATED * n_words(w)),
    Rule("word_length", lambda t, w: ~F.coalesce(
        (word_chars(w) / F.nullif(n_words(w), F.lit(0))).between(*MEAN_WORD), F.lit(True))),
    Rule("symbols", lambda t, w: n_symbols(t) > MAX_SYMBOLS * n_words(w)),
    Rule("duplicate_lines", lambda t, w: n_dup_lines(t) > MAX_DUPLICATE_LINES * F.size(filled_lines(t))),
)


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float  # share of the sample

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


def plan_cascade(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS
) -> list[Measured]:
    """The rules by rejection per cost, each timed alone over about ``sample_rows`` rows, less the split.

    The sample is drawn where the rows are. It serves the order alone and never decides a verdict.
    """
    share = min(1.0, sample_rows / max(df.count(), 1))
    sample = materialise(
        df.select(known_text(text).alias("text")).sample(share, seed=42), "rule-sample"
    )
    total = max(sample.count(), 1)
    text_of = F.col("text")

    def timed(condition: Column) -> tuple[float, int]:
        """Median time of a pass over the sample, and the rows that meet a condition."""
        seconds, found = [], 0
        for _ in range(RUNS):
            start = time.perf_counter()
            found = sample.agg(F.count_if(condition)).first()[0] or 0
            seconds.append(time.perf_counter() - start)
        return median(seconds), found

    def split_then(fails: Callable[[Column, Column], Column]) -> Column:
        return let(words(text_of), lambda w: fails(text_of, w))

    timed(split_then(lambda t, w: F.size(w) < 0))  # start-up and compilation count for no rule
    split, _ = timed(split_then(lambda t, w: F.size(w) < 0))
    measured = []
    for rule in rules:
        seconds, rejected = timed(split_then(rule.fails))
        measured.append(Measured(rule.name, max(seconds - split, 0.0), rejected / total))
    return sorted(measured, key=lambda m: (-m.worth, m.seconds, m.name))


def failed_first(text: Column, list_of: Column, order: list[str], rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the first rule in this order that a text with these words fails; null if it passes all."""
    by_name = {rule.name: rule for rule in rules}
    out = F.when(by_name[order[0]].fails(text, list_of), F.lit(order[0]))
    for name in order[1:]:
        out = out.when(by_name[name].fails(text, list_of), F.lit(name))
    return out


def first_failed(text: Column, order: list[str], rules: tuple[Rule, ...] = RULES) -> Column:
    """``failed_first`` of a text, its words split once."""
    return let(words(text), lambda w: failed_first(text, w, order, rules))


def judge(df: DataFrame, text: str = "text", reason: str = "rejected_by") -> DataFrame:
    """All rows and columns plus the reason, null for the rows to keep."""
    order = [m.name for m in plan_cascade(df, text)]
    return df.withColumn(reason, first_failed(known_text(text), order))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass every rule, with their columns as they were."""
    reason = fresh(df, "rejected_by")
    return judge(df, text, reason).where(F.col(reason).isNull()).select(*df.columns)


def measures(df: DataFrame) -> DataFrame:
    """The contract's counts of every document and the cascade's verdict.

    The counts are asked for by name and so are computed for every row; they feed the base rule,
    and the cascade decides the rest from the remaining rules in its order.
    """
    order = [m.name for m in plan_cascade(df)]
    left = [name for name in order if name not in ("few_words", "repeated_words")]
    text = F.col("text")

    def count(w: Column) -> Column:
        return F.struct(
            n_words(w).alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(text).alias("n_symbols"),
            n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"),
            failed_first(text, w, left).isNull().alias("rest"),
        )

    rows = df.select("doc_id", known_text().alias("text")).select("doc_id", let(words(text), count).alias("c"))
    counted = rows.select("doc_id", "c.*").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return counted.withColumn("kept", ~F.col("base_failed") & F.col("rest")).drop("rest")


MEASURES_SQL = r"""
with texts as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), word_lists as (
  select r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from texts
), windows as (
  select r, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) as g
  from (select r, w, unnest(range(1, len(w) - 1)) as i from word_lists)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from windows) where n > 1
), repeated as (
  select r, count(distinct i + k) as n_repeat_words
  from twice, (select unnest([0, 1, 2]) as k) group by r
), counted as (
  select doc_id, len(w)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from word_lists left join repeated using (r)
), base as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2.0 and 16.0 and n_symbols <= 0.1 * n_words
    and n_dup_lines <= 0.6 * n_lines as kept
from base
"""
