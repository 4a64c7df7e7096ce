"""Positions, windows and dictionaries over whole texts, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions.numbers import let

SPAN = "array<struct<start:int,end:int,hit:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Every match of a pattern with its 0-based start and end, as one array per text."""
    empty = F.array().cast(SPAN)

    def place(hits):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        steps = F.zip_with(hits, gaps, lambda h, g: F.length(g) + F.length(h))

        def cut(ends):
            return F.zip_with(hits, ends, lambda h, e: F.struct(
                (e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))

        placed = let(running(steps, lambda a, b: a + F.coalesce(b, F.lit(0))), cut)
        return F.when(F.size(hits) > 0, placed).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of all values up to each one (totals, maxima), in n log n steps.

    In round k every value is joined with the one 2^k places ahead of it, which is null where
    there is none, so no array grows value by value.
    """
    rounds = F.array(*[F.lit(1 << k) for k in range(31)])

    def step(acc, ahead):
        joined = F.transform(acc, lambda x, i: join(x, F.get(acc, i - ahead)))
        return F.when(ahead < F.size(acc), joined).otherwise(acc)

    return F.aggregate(rounds, values, step)


def clean_text(text: Column) -> Column:
    """No-break spaces and dash variants to their plain forms, runs of blanks to one."""
    plain = F.translate(text, " –—−", " ---")
    return F.trim(F.regexp_replace(plain, r"[ \t]+", " "))


def window(text: Column, start: Column, end: Column, before: int, after: int | None = None) -> Column:
    """The text from ``before`` characters ahead of a span to ``after`` behind it."""
    after = before if after is None else after
    left = F.greatest(F.lit(0), start - before)
    return F.substring(text, left + 1, end + after - left)


def first_number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def term_count(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a literal term."""
    cut = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return (cut / F.length(term)).cast("bigint")


def terms(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def first_term(text: Column, words: list[str]) -> Column:
    """The longest dictionary term that occurs in the text."""
    return let(F.lower(text), lambda low: first_term_of(low, words))


def first_term_of(low: Column, words: list[str]) -> Column:
    """``first_term`` of a text in lower case, a variable of ``let``: an expression would be computed for every word."""
    ordered = sorted(words, key=lambda w: -len(w))
    return F.get(F.filter(terms(ordered), lambda w: F.contains(low, F.lower(w))), F.lit(0))


def role_position(low: Column, words: list[str]) -> Column:
    """Position of the first listed term that occurs (dictionary order decides), 0 if none."""
    found = let(low, lambda t: F.transform(terms([w.lower() for w in words]), lambda w: F.instr(t, w)))
    return F.coalesce(F.get(F.filter(found, lambda p: p > 0), F.lit(0)), F.lit(0))


def component_order(text: Column) -> Column:
    """The four roles that occur, by their first position."""
    low = F.lower(text)
    words = {
        "ionizable": V.IONIZABLE, "helper": V.HELPER,
        "cholesterol": V.CHOLESTEROL, "peg": V.PEG_LIPID,
    }
    found = F.array(*[
        F.struct(role_position(low, words[r]).alias("at"), F.lit(i).alias("tie"),
                 F.lit(r).alias("role"))
        for i, r in enumerate(["ionizable", "helper", "peg", "cholesterol"])
    ])
    return F.transform(
        F.array_sort(F.filter(found, lambda s: s["at"] > 0)), lambda s: s["role"]
    )


def cargo_from_words(text: Column) -> Column:
    """Cargo class of article text; the first class with a word in the text wins."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for label, words in reversed(V.CARGO_WORDS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def cargo_class(text: Column) -> Column:
    """Cargo class of a claim field: empty stays empty, unknown is ``other``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("other")
    for label, pattern in reversed(V.CARGO_CLASSES):
        out = F.when(low.rlike(pattern), F.lit(label)).otherwise(out)
    return F.when(low == "", F.lit("")).otherwise(out)


def cargo_cascade(*texts: Column) -> Column:
    """First informative class along the given fields."""
    known = [F.nullif(F.nullif(cargo_class(t), F.lit("other")), F.lit("")) for t in texts]
    return F.coalesce(*known, F.lit("other"))


def lookup_map(table: dict[str, str]) -> Column:
    """A small fixed dictionary as a map literal."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def by_spelling(table: dict[str, list[str]]) -> dict[str, str]:
    """Canonical value of every spelling."""
    return {spelling: canon for canon, own in table.items() for spelling in own}


def flat_name(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), "- ", "")
