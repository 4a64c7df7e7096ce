"""Reply-ordered conversations from nested quotations, in built-in expressions only.

A line's quote level is the number of ``>`` before its text. Lines of one level that follow each
other are a passage; a blank line ends it. A passage is normalised (marks dropped, white space
evened out, lower case) and hashed. The passages of level 0, and every single line of them, are
what a message says itself; they are joined to the quoted passages of the same conversation.

A message replies to the first earlier message of its conversation that says a passage quoted
in it. With ``partial`` (as the query has it), a quoted passage that no earlier message says as a
whole goes by its lines or by its sentences: to an earlier message that lines (or sentences) with at
least half of the passage's characters were first said in. Of several, the one with the most weight
decides, where a piece weighs its characters over the number of messages of the conversation that say
it, then the latest. So a common line alone links nothing but itself. Of a message's passages the one
with the lowest level decides, then one found as a whole, then the latest turn. A message without such
a quotation begins a thread. Threads are followed by pointer jumping: after k rounds every reply knows
the message 2^k steps up. Order inside a conversation: by the turn of the thread's first message, then by the number of replies down to the message, then by turn, so
every message stands behind the one it replies to. ``sort_key`` sorts like that as text. The own
text is left without quotations, and formatted as one chat turn.

Counts and first turns are taken with partial aggregation and joined back, so a conversation or
a passage may hold a third of all rows. Rows that share conversation and turn are one message
for replies; each keeps its own text. Null texts count as empty; a null role becomes "unknown".
Rows without a conversation or turn begin a thread and nothing replies to them. Extra columns
are left out. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulake.functions.numbers import let
from formulake.llm.common import known_text
from formulake.session import materialise

SENTENCE_END = r"(?<=[.!?…。！？])\s+"
MARKS = r"^[ \t]*((?:>[ \t]*)*)"
ROUNDS = 40


def quote_lines(text: Column) -> Column:
    """Level and own text of every line."""

    def split_line(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        level = F.length(marks) - F.length(F.translate(marks, ">", ""))
        return F.struct(
            level.alias("level"),
            F.when(level > 0, F.regexp_replace(line, MARKS, "")).otherwise(line).alias("text"),
        )

    return F.transform(F.split(text, r"\r?\n", -1), split_line)


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def passages(lines: Column) -> Column:
    """Level, normalised text and lines of every passage, in order."""

    def cut(all_lines: Column) -> Column:
        blank = F.transform(all_lines, lambda x: F.struct(
            x["level"].alias("level"), normal(x["text"]).alias("text")))

        def join(plain: Column) -> Column:
            def begins(x: Column, i: Column) -> Column:
                before = F.get(plain, i - 1)
                return (x["text"] != "") & (
                    (i == 0) | (before["text"] == "") | (before["level"] != x["level"])
                )

            numbered = F.filter(F.transform(plain, lambda x, i: F.struct(
                i.alias("i"), begins(x, i).alias("first"))), lambda x: x["first"])
            starts = F.transform(numbered, lambda x: x["i"])

            def slices(at: Column) -> Column:
                return F.transform(at, lambda start, k: F.struct(
                    F.get(plain, start)["level"].alias("level"),
                    F.filter(F.transform(
                        F.slice(plain, start + 1, F.coalesce(F.get(at, k + 1), F.size(plain)) - start),
                        lambda x: x["text"]), lambda t: t != "").alias("lines"),
                ))

            return F.transform(let(starts, slices), lambda p: F.struct(
                p["level"].alias("level"), F.array_join(p["lines"], " ").alias("text"), p["lines"].alias("lines")))

        return let(blank, join)

    return let(lines, cut)


def own_text(lines: Column) -> Column:
    kept = F.filter(lines, lambda x: x["level"] == 0)
    return F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), r"^\s+|\s+$", ""))


LINE, SENTENCE = 0, 1
PIECES = "array<struct<kind:int,hash:bigint,chars:bigint>>"
WEIGHT = 1000  # of a character that a single message says


def pieces(passage: Column) -> Column:
    """The different lines and the different sentences of a passage, hashed, with their characters."""
    def of(texts: Column, kind: int) -> Column:
        return F.transform(F.array_distinct(texts), lambda t: F.struct(
            F.lit(kind).alias("kind"), F.xxhash64(t).alias("hash"), F.length(t).cast("bigint").alias("chars")))

    return F.concat(of(passage["lines"], LINE), of(F.split(passage["text"], SENTENCE_END, -1), SENTENCE))


def parsed(messages: DataFrame, partial: bool = False) -> DataFrame:
    """conv_id, turn, role, own text, what the message says itself, and what it quotes."""
    lines = messages.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        quote_lines(known_text()).alias("lines"),
    )
    cut = lines.select("conv_id", "turn", "role", "lines", passages(F.col("lines")).alias("passages"))
    said = F.filter("passages", lambda p: p["level"] == 0)
    single = F.filter(F.transform(
        F.filter("lines", lambda x: x["level"] == 0), lambda x: normal(x["text"])), lambda t: t != "")
    says = F.transform(F.concat(F.transform(said, lambda p: p["text"]), single), lambda t: F.xxhash64(t))
    if partial:
        says = F.concat(says, F.transform(F.flatten(F.transform(said, pieces)), lambda x: x["hash"]))
    none = F.array().cast(PIECES)
    return cut.select(
        "conv_id", "turn", "role", own_text(F.col("lines")).alias("own"), F.array_distinct(says).alias("says"),
        F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: F.struct(
            p["level"].alias("level"), F.xxhash64(p["text"]).alias("hash"),
            (pieces(p) if partial else none).alias("pieces"))).alias("quotes"),
    )


def reply_links(rows: DataFrame) -> DataFrame:
    """conv_id, turn and parent of every message that quotes an earlier one.

    Sayings matter only where something is quoted, so quoted hashes are looked for first.
    """
    placed = "conv_id is not null and turn is not null"
    quoted = rows.where(placed).select("conv_id", "turn", F.explode("quotes").alias("q")).select(
        "conv_id", "turn", "q.level", "q.hash", "q.pieces")
    whole = quoted.select("conv_id", "hash")
    wanted = whole.unionByName(quoted.select("conv_id", F.explode("pieces.hash").alias("hash"))).distinct()
    said = rows.where(placed).select("conv_id", "turn", F.explode("says").alias("hash"))
    sayings = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("parent"), F.count("*").alias("sayers"))
    first = materialise(sayings.join(wanted, ["conv_id", "hash"], "left_semi"), "sayings")
    passage = ["conv_id", "turn", "level", "hash"]
    found = quoted.join(first.drop("sayers"), ["conv_id", "hash"]).where(F.col("parent") < F.col("turn")).select(
        *passage, "parent").distinct()
    # the message that holds half of a passage, by its lines or by its sentences
    parts = quoted.join(found, passage, "left_anti").select(*passage, F.explode("pieces").alias("piece")).distinct()
    parts = parts.select(*passage, "piece.kind", "piece.chars", F.col("piece.hash").alias("piece"))
    sizes = parts.groupBy(*passage, "kind").agg(F.sum("chars").alias("size"))
    agreed = parts.join(first.withColumnRenamed("hash", "piece"), ["conv_id", "piece"]).where(
        F.col("parent") < F.col("turn")).groupBy(*passage, "kind", "parent").agg(
        F.sum("chars").alias("same"), F.sum(F.floor(F.col("chars") * WEIGHT / F.col("sayers"))).alias("weight"))
    enough = agreed.join(sizes, [*passage, "kind"]).where(2 * F.col("same") >= F.col("size"))
    most = enough.groupBy(*passage).agg(F.max(F.struct("weight", "parent")).alias("m")).select(
        *passage, F.col("m.parent").alias("parent"))
    either = found.withColumn("part", F.lit(0)).unionByName(most.withColumn("part", F.lit(1)))
    best = F.min(F.struct("level", "part", (-F.col("parent")).alias("back")))
    return either.groupBy("conv_id", "turn").agg(best.alias("b")).select(
        "conv_id", "turn", (-F.col("b.back")).alias("parent"))


def followed(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, the thread's first turn and the number of replies from it."""
    state = materialise(
        links.select("conv_id", "turn", "parent", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("steps")),
        "threads",
    )
    for _ in range(ROUNDS):
        above = state.select(
            "conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        joined = state.join(above, ["conv_id", "up"], "left")
        if joined.where("next is not null").limit(1).count() == 0:
            break
        state = materialise(joined.select(
            "conv_id", "turn", "parent", F.coalesce("next", "up").alias("up"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        ), "threads")
    return state.withColumnsRenamed({"up": "root", "steps": "depth"})


def padded(number: Column) -> Column:
    """Sorts as text like the number does."""
    shifted = number.cast("decimal(38,0)") + F.lit(str(2**63)).cast("decimal(38,0)")
    return F.lpad(shifted.cast("string"), 20, "0")


def reply_ordered(messages: DataFrame, partial: bool = False) -> DataFrame:
    """Every message without quotations, with its place in its thread and conversation.

    With ``partial``, passages that nothing says as a whole count by their lines and sentences.
    """
    rows = materialise(parsed(messages, partial), "messages")
    threads = followed(reply_links(rows))
    placed = rows.join(threads, ["conv_id", "turn"], "left")
    root, depth = F.coalesce("root", "turn"), F.coalesce("depth", F.lit(0))
    return placed.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.col("parent").alias("reply_to"),
        root.alias("thread"), depth.cast("bigint").alias("depth"),
        F.concat_ws("-", *[F.coalesce(padded(c), F.lit("")) for c in (root, depth, F.col("turn"))]).alias("sort_key"),
        F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("own"), F.lit("<|im_end|>\n")).alias("formatted"),
        F.size("quotes").cast("bigint").alias("n_quotes"),
    )
