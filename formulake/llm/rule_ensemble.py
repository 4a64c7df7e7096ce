"""Quality scores from a sparse ensemble of rules over text statistics.

Fit: a forest of shallow trees is grown on the statistics of labelled texts. Every path from a root
to a node is a rule, a conjunction of bounds ``low < statistic <= high``; paths that say the same are
one rule. Each rule is a column of zeros and ones, and a logistic model with a lasso penalty weighs
them; most weights become zero and those rules go. The penalty is the one with the least log loss on
a quarter of the sample that the weights of that trial haven't seen.

Score: the rules that are left become one column expression over the statistics, which are
expressions over the whole text, so no Python runs on the rows that are scored.

Bounds: the fit sees at most ``SAMPLE_DOCS`` labelled documents of each class, drawn by a hash of
the id, and weighs the classes by their shares among all labelled documents that are not held back.
Everything else covers all rows.

Rows: a null text counts as empty; an empty text or one without words has the value 0 for every
share and is scored like any other. Repeated rows get equal scores. A document with several labels
counts as good if one of them says so; labels other than 0 and 1 and null ids are left out. If there
are no labelled documents of one of the classes, every score is the share of good ones among the
labels (0.5 without labels). Empty tables give empty results, extra columns are kept.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulake.functions.numbers import let
from formulake.llm.common import fresh, known_text, words
from formulake.session import materialise

FOLDS = 4
HELD_OUT = 2  # the remainder of documents that no label is learned from
THRESHOLD = 0.7
SAMPLE_DOCS = 3000  # labelled documents of a class that the fit sees, at most
TREES, DEPTH = 40, 3
MIN_LEAF = 15
SUPPORT = 0.002  # share of the sample that a rule must hold for, and not hold for
PENALTIES = (0.0003, 0.001, 0.003, 0.01)
SEED = 42


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def signs(text: Column, others: str) -> Column:
    """How many characters are left without these, given as a character class."""
    return F.length(F.regexp_replace(text, others + "+", ""))


def statistics(text: Column) -> Column:
    """A struct of doubles about a whole text, none of them null."""

    def of(list_of: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")
        chars, n = F.length(text), F.size(list_of)
        again = F.size(F.filter(list_of, lambda w, i: F.coalesce(F.get(list_of, i - 1) == w, F.lit(False))))
        return F.struct(
            n.cast("double").alias("n_words"),
            share(F.length(F.array_join(list_of, "")), n).alias("mean_word"),
            share(signs(text, r"\P{Lu}"), chars).alias("upper"),
            share(signs(text, r"\P{L}"), chars).alias("letters"),
            share(signs(text, r"\P{N}"), chars).alias("digits"),
            share(signs(text, r"[^.,;:]"), chars).alias("stops"),
            share(signs(text, r"[^!?]"), chars).alias("calls"),
            share(signs(text, r"[^\p{S}#*%&@/\\_]"), chars).alias("symbols"),
            share(F.size(F.array_distinct(list_of)), n).alias("distinct_words"),
            share(again, n).alias("repeated_neighbours"),
            let(lines, lambda own: share(F.size(F.array_distinct(own)), F.size(own))).alias("distinct_lines"),
            share(chars, F.size(F.split(text, "\n", -1))).alias("line_length"),
        )

    return let(words(text), of)


STATISTICS = (
    "n_words", "mean_word", "upper", "letters", "digits", "stops", "calls", "symbols", "distinct_words",
    "repeated_neighbours", "distinct_lines", "line_length",
)

#: A rule: for some statistics, by name, the bounds of an interval that is open below.
Rule = tuple[tuple[str, float, float], ...]


def holds(rule: Rule, stats: Column) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        value = stats[name]
        if low > -math.inf:
            out = out & (value > low)
        if high < math.inf:
            out = out & (value <= high)
    return out


def as_text(rule: Rule) -> str:
    parts = [
        (f"{low:g} < " if low > -math.inf else "") + name + (f" <= {high:g}" if high < math.inf else "")
        for name, low, high in rule
    ]
    return " and ".join(parts)


LINE = re.compile(r"^( +)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(tree: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The rules of a tree in the printed form of the library's models, one for each node below the root."""
    out: list[Rule] = []
    above: list[tuple[int, str, str, float]] = []  # indent, statistic, side, bound
    for line in tree.splitlines():
        found = LINE.match(line)
        if not found:
            continue
        indent = len(found[1])
        above = [a for a in above if a[0] < indent]
        above.append((indent, names[int(found[2])], found[3], float(found[4])))
        box: dict[str, tuple[float, float]] = {}
        for _, name, side, bound in above:
            low, high = box.get(name, (-math.inf, math.inf))
            box[name] = (low, min(high, bound)) if side == "<=" else (max(low, bound), high)
        out.append(tuple((name, *box[name]) for name in sorted(box)))
    return out


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and an offset; without rules every score is the same."""

    rules: tuple[tuple[Rule, float], ...]
    offset: float

    def score(self, text: Column) -> Column:
        def of(stats: Column) -> Column:
            total = F.lit(self.offset)
            for rule, weight in self.rules:
                total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

        return let(statistics(text), of) if self.rules else of(F.lit(None))

    def __str__(self) -> str:
        ranked = sorted(self.rules, key=lambda r: -abs(r[1]))
        return "\n".join([f"{self.offset:+.3f}"] + [f"{w:+.3f}  {as_text(r)}" for r, w in ranked])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """Statistics, label and weight of at most ``per_class`` documents a class, and all labels by class."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for label, n in sorted(sizes.items()):
        weight = n / min(n, per_class)
        own = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        own = own.withColumn("weight", F.lit(weight))
        drawn = own if drawn is None else drawn.unionByName(own)
    if drawn is None:
        return known, sizes
    texts = documents.select("doc_id", known_text().alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id")  # as many rows as the two bounds allow
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(4))
    return rows.select("doc_id", statistics(F.col("text")).alias("stats"), "label", "weight", part.alias("part")), sizes


def grown_rules(rows: DataFrame, trees: int, depth: int) -> list[Rule]:
    """All rules of a forest on these rows, each once, in a fixed order."""
    flat = rows.select("label", "weight", *[F.col(f"stats.{s}").alias(s) for s in STATISTICS])
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(flat)
    forest = RandomForestClassifier(
        labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=MIN_LEAF,
        featureSubsetStrategy="onethird", subsamplingRate=0.5, maxBins=64, seed=SEED,
    ).fit(vectors)
    return sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString)})


def weighed_rules(rows: DataFrame, rules: list[Rule], penalties: tuple[float, ...]) -> Ensemble:
    """Lasso logistic weights for the rules that hold for some of the rows and not for others."""
    marks = F.array(*[holds(rule, F.col("stats")).cast("double") for rule in rules])
    marked = materialise(rows.select("doc_id", "label", "weight", "part", marks.alias("marks")), "rule-marks")
    mean = marked.agg(F.count("*").alias("n"), F.array(*[
        F.avg(F.get("marks", F.lit(i))) for i in range(len(rules))]).alias("share")).first()
    used = [i for i, s in enumerate(mean["share"]) if SUPPORT <= s <= 1 - SUPPORT]
    if not used:
        raise ValueError("no rule tells the sample's documents apart")
    vector = array_to_vector(F.array(*[F.get("marks", F.lit(i)) for i in used]))
    # few rows: one task for each pass of the fit, in an order of its own
    table = materialise(marked.select("label", "weight", "part", vector.alias("features"), "doc_id").coalesce(1)
                        .sortWithinPartitions("doc_id").drop("doc_id"), "rule-vectors")

    def fitted(train: DataFrame, penalty: float):
        return LogisticRegression(
            labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-4).fit(train)

    best = penalties[0]
    if len(penalties) > 1:
        own, other = table.where("part > 0"), table.where("part = 0")
        losses = []
        for penalty in penalties:
            chance = F.get(vector_to_array("probability"), F.col("label"))
            seen = fitted(own, penalty).transform(other)
            loss = seen.agg(F.sum(-F.log(F.greatest(chance, F.lit(1e-12))) * F.col("weight"))).first()[0]
            losses.append((math.inf if loss is None else loss, -penalty))
        best = -min(losses)[1]
    model = fitted(table, best)
    weights = model.coefficients.toArray()
    kept = [(rules[i], float(w)) for i, w in zip(used, weights) if abs(w) > 1e-9]
    return Ensemble(tuple(kept), float(model.intercept))


def fit(
    documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS, trees: int = TREES, depth: int = DEPTH,
    penalties: tuple[float, ...] = PENALTIES,
) -> Ensemble:
    """The ensemble from the labelled documents that are not held out."""
    rows, sizes = labelled_sample(documents, labels, per_class)
    total = sum(sizes.values())
    if len(sizes) == 2:
        rows = materialise(rows, "rule-sample")
        there = {r["label"] for r in rows.select("label").distinct().collect()}
    if len(sizes) < 2 or len(there) < 2:
        good = (sizes.get(1, 0) + 0.5) / (total + 1)
        return Ensemble((), math.log(good / (1 - good)))
    rows = materialise(rows.coalesce(1).sortWithinPartitions("doc_id"), "rule-sample")
    rules = grown_rules(rows, trees, depth)
    return weighed_rules(rows, rules, penalties)


def keep_good(df: DataFrame, model: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that reach the threshold, with their columns as they were."""
    return df.where(model.score(known_text()) >= threshold).select(*df.columns)


def with_score(df: DataFrame, model: Ensemble, out: str = "score") -> DataFrame:
    return df.withColumn(fresh(df, out), model.score(known_text()))


def scored_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted class of every document."""
    model = fit(documents, labels)
    scored = documents.select("doc_id", held_out().alias("held_out"), model.score(known_text()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
