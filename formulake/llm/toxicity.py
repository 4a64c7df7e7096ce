"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel counts the subsequences of five symbols that two sentences share. A subsequence may
skip up to two symbols inside a window of seven and weighs ``DECAY ** span``, so ``i-d-i-o-t``,
``idd1ot`` and ``idiot`` still share most of theirs. A sentence is divided by the root of its
self-kernel without gaps, so repeating a word adds nothing. Symbols are folded letters (accents dropped), one symbol each for digits,
other signs and blanks, and three for letters of other scripts.

Training (bounded, on the driver): up to ``SAMPLE_DOCS`` labelled documents and about
``SAMPLE_SENTENCES`` sentences of each class, all drawn by hash from rows that are not held back.
Landmarks are the words that tell the classes apart best and some drawn by hash. Sentences are
mapped to Nyström features ``K_ZZ^(-1/2) k_Z(x)`` and a squared-hinge machine is fitted by
Newton steps. Only some sentences of a toxic document are toxic, so positives are re-labelled by
the machine between fits: those that exceed nearly all clean ones, and the best of each toxic
document. The last fit adds sentences of both classes in which one word has a character between
its letters. As the kernel is an inner product, the machine folds into one weight for each
subsequence, which is what scoring reads; ``tests`` hold both forms against each other. A
logistic step maps a document's sentences (the best, the three best, the best twentieth, their
number) to a score from 0 to 1, at the share of toxic rows among all labels that are not held
back.

Scoring reads whole texts in pieces of ``PIECE`` symbols; the end of a piece ends a sentence.
Null texts count as empty and are scored like any other. Without labelled rows of both classes
in each part of the sample the score is the share of toxic labels (0 without any label). Labels
that name a document more than once count as toxic if one of them does; null labels and ids are
ignored. Repeated rows get equal scores. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulake.llm.common import fresh, held_back, known_text, small_batches

ORDER, WINDOW, DECAY = 5, 7, 0.7
SYMBOLS = 32
BLANK, DIGIT, SIGN, OTHER = 0, 27, 28, 29
LONGEST, SHORTEST = 120, 20  # symbols of a sentence before it is cut; least length to divide by
PIECE = 1 << 20
FOLDS = 5
SAMPLE_DOCS = 1500
SAMPLE_SENTENCES = 12_000  # of a class, dealt evenly to its documents
LANDMARKS = (320, 64)  # telling words, drawn words
PARTED = 48  # telling words that also become landmarks with a sign between their letters
BETWEEN = (" ", "-", ".", "*", "x")
ROUNDS = 4
CLEAR = 0.995  # share of clean sentences that a positive one must exceed
PENALTY = 1e-5
BLOCK = 2048  # sentences that the fit holds in double precision at once
GAPS = list(itertools.combinations(range(1, WINDOW), ORDER - 1))


def fold_table() -> np.ndarray:
    """Symbol of every code point below 65536."""
    out = np.empty(65536, np.uint8)
    for point in range(65536):
        char = chr(point)
        base = unicodedata.normalize("NFKD", char)[0].lower() if not 0xD800 <= point < 0xE000 else " "
        if "a" <= base <= "z":
            out[point] = 1 + ord(base) - ord("a")
        elif char.isspace():
            out[point] = BLANK
        elif char.isdigit():
            out[point] = DIGIT
        elif char.isalpha():
            out[point] = OTHER + point % 3
        else:
            out[point] = SIGN
    return out


TABLE = fold_table()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(codes: np.ndarray) -> np.ndarray:
    out = np.take(TABLE, codes, mode="clip").astype(np.int64)
    out[codes > 65535] = OTHER
    return out


def sentence_starts(codes: np.ndarray) -> np.ndarray:
    """First positions of sentences: after ``. ! ?`` and a blank, after a line end, or when too long."""
    if not len(codes):
        return np.zeros(1, np.int64)
    blank = np.take(TABLE, codes, mode="clip") == BLANK
    ends = (codes == 0x2E) | (codes == 0x21) | (codes == 0x3F)
    first = np.zeros(len(codes), bool)
    first[0] = True
    first[1:] = (codes[:-1] == 0x0A)
    first[2:] |= ends[:-2] & blank[1:-1]
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(codes)))
    pieces = np.maximum(1, -(-length // LONGEST))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(at, pieces) + nth * LONGEST


def feature_numbers(code: np.ndarray, gaps: tuple[int, ...], n: int) -> np.ndarray:
    """Number of the subsequence at each of n positions, its later symbols at these gaps."""
    return numbers_from(powers(code), gaps, n)


def powers(code: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """The code times each power that its place in a subsequence calls for, first symbol first."""
    return [code * SYMBOLS**k for k in range(order - 1, -1, -1)]


def numbers_from(scaled: list[np.ndarray], gaps: tuple[int, ...], n: int) -> np.ndarray:
    out = scaled[0][:n].copy()
    for part, gap in zip(scaled[1:], gaps):
        out += part[gap : gap + n]
    return out


def weight_of(gaps: tuple[int, ...]) -> float:
    return DECAY ** (gaps[-1] + 1)


def padded(code: np.ndarray) -> np.ndarray:
    return np.concatenate((code, np.zeros(WINDOW - 1, np.int64)))


def landmark_features(word: str) -> dict[int, float]:
    """The subsequences of a landmark between two blanks, with their weights."""
    code = np.concatenate(([BLANK], symbols(points(word)), [BLANK])).astype(np.int64)
    out: dict[int, float] = {}
    for gaps in GAPS:
        n = len(code) - gaps[-1]
        if n > 0:
            for number in feature_numbers(code, gaps, n).tolist():
                out[number] = out.get(number, 0.0) + weight_of(gaps)
    scale = max(len(code), SHORTEST) ** -0.5
    return {k: v * scale for k, v in out.items()}


def two_level(numbers: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each beginning (all symbols but the last), and its values by the last symbol.

    Beginnings without values share place 0. Both stay small, so that lookups read memory near
    the processor.
    """
    heads, row = np.unique(numbers // SYMBOLS, return_inverse=True)
    places = np.zeros(SYMBOLS ** (ORDER - 1), np.int64)
    places[heads] = np.arange(1, len(heads) + 1) * SYMBOLS
    table = np.zeros((len(heads) + 1) * SYMBOLS, values.dtype)
    table[(row + 1) * SYMBOLS + numbers % SYMBOLS] = values
    return places, table


class Landmarks:
    """Kernel values of sentences with landmarks, in blocks of bounded size."""

    def __init__(self, words: list[str]):
        self.words = words
        rows = [landmark_features(word) for word in words]
        numbers = np.array(sorted({k for row in rows for k in row}), np.int64)
        at = {number: i + 1 for i, number in enumerate(numbers.tolist())}
        self.features = np.zeros((len(numbers) + 1, len(words)), np.float32)
        for j, row in enumerate(rows):
            for number, weight in row.items():
                self.features[at[number], j] = weight
        self.places, self.nth = two_level(numbers, np.arange(1, len(numbers) + 1, dtype=np.int64))
        self.weights = np.array([weight_of(gaps) for gaps in GAPS], np.float32)

    def own(self) -> np.ndarray:
        return self.features.T @ self.features

    def kernel(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.words)), np.float32)
        for i, text in enumerate(texts):
            code = symbols(points(text))
            n = len(code)
            long = padded(code)
            scaled = powers(long, ORDER - 1)
            seen = np.stack([
                self.nth[self.places[numbers_from(scaled, gaps[:-1], n)] + long[gaps[-1] : gaps[-1] + n]]
                for gaps in GAPS
            ])
            gap, at = np.nonzero(seen)
            out[i] = self.weights[gap] @ self.features[seen[gap, at]]
        return out * scales(texts)[:, None]

    def mapped(self, texts: list[str], root: np.ndarray) -> np.ndarray:
        """Nyström features of sentences and a one for the offset."""
        out = np.ones((len(texts), root.shape[1] + 1), np.float32)
        for at in range(0, len(texts), BLOCK):
            out[at : at + BLOCK, :-1] = self.kernel(texts[at : at + BLOCK]) @ root
        return out


def scales(texts: list[str]) -> np.ndarray:
    return np.array([norm(symbols(points(t)), np.zeros(1, np.int64))[0] for t in texts], np.float32)


def norm(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What each sentence is multiplied by: one over the root of its gapless self-kernel."""
    n = len(code)
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    together = tuple(range(1, ORDER))
    number = np.sort(sentence * SYMBOLS**ORDER + feature_numbers(padded(code), together, n))
    first = np.flatnonzero(np.diff(number, prepend=-1))
    counts = np.diff(np.append(first, n)).astype(np.float64)
    squares = np.bincount(number[first] // SYMBOLS**ORDER, counts * counts, len(starts))
    return np.maximum(squares, SHORTEST) ** -0.5


@dataclass(frozen=True)
class Model:
    """Weights of the subsequences that have one, the offset, and the step from sentences to a score."""

    numbers: np.ndarray
    values: np.ndarray
    offset: float
    step: tuple[float, ...] = ()
    constant: float | None = None

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        return two_level(self.numbers, self.values)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def contributions(self, code: np.ndarray) -> np.ndarray:
        """What begins at each position, summed over gaps."""
        n = len(code)
        rows, weights = self.table
        code = padded(code)
        scaled = powers(code, ORDER - 1)
        out = np.zeros(n, np.float32)
        for head, group in itertools.groupby(GAPS, key=lambda gaps: gaps[:-1]):
            row = np.take(rows, numbers_from(scaled, head, n), mode="clip")
            for gaps in group:
                own = np.take(weights, row + code[gaps[-1] : gaps[-1] + n], mode="clip")
                own *= np.float32(weight_of(gaps))
                out += own
        return out

    def sentence_values(self, codes: np.ndarray) -> np.ndarray:
        starts = sentence_starts(codes)
        if not len(codes):
            return np.array([self.offset])
        code = symbols(codes)
        return np.add.reduceat(self.contributions(code), starts) * norm(code, starts) + self.offset

    def signals_of(self, text: str | None) -> tuple[float, float, float, float]:
        """The best sentence, the mean of the three best, the value that a twentieth of the
        sentences exceed, and the logarithm of their number."""
        text = text or ""
        values = np.concatenate([
            self.sentence_values(points(text[at : at + PIECE])) for at in range(0, max(len(text), 1), PIECE)
        ])
        high = np.sort(values)[::-1]
        return high[0], high[:3].mean(), high[len(high) // 20], np.log(len(high))

    def signals(self, texts) -> np.ndarray:
        return np.array([self.signals_of(t) for t in texts]).reshape(-1, 4)

    def scores(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.signals(texts) @ np.array(self.step[:-1]) + self.step[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nystroem(landmark_kernel: np.ndarray) -> np.ndarray:
    """``K_ZZ^(-1/2)``, without directions that rounding alone has made."""
    values, vectors = np.linalg.eigh(landmark_kernel.astype(np.float64))
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


def squared_hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights of a linear machine by Newton steps over the active rows; the last is the offset."""
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-8
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(20):
        square, right = np.diag(ridge), np.zeros(len(w))
        for at in range(0, len(x), BLOCK):
            mine = slice(at, at + BLOCK)
            part = x[mine][active[mine]].astype(np.float64)
            rows = share[mine][active[mine]]
            square += (part * rows[:, None]).T @ part
            right += part.T @ (rows * y[mine][active[mine]])
        w = np.linalg.solve(square, right)
        now = y * (x @ w.astype(np.float32)) < 1
        if (now == active).all():
            break
        active = now
    return w


def class_shares(positive: np.ndarray) -> np.ndarray:
    """Equal weight for both classes, one in total."""
    n = max(positive.sum(), 1), max((~positive).sum(), 1)
    return np.where(positive, 0.5 / n[0], 0.5 / n[1])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def choose_landmarks(
    texts: list[str], owner: np.ndarray, toxic: np.ndarray
) -> tuple[list[str], list[str]]:
    """Words whose share of documents differs most between the classes, and words by hash.

    The first list has all landmarks, the second the most telling words.
    """
    seen: dict[tuple, set] = {}
    for text, doc, mark in zip(texts, owner.tolist(), toxic.tolist()):
        seen.setdefault((doc, mark), set()).update(text.lower().split())
    with_, without = Counter(), Counter()
    for (_, mark), own in seen.items():
        (with_ if mark else without).update(own)
    n = [max(sum(mark is value for _, mark in seen), 1) for value in (True, False)]

    def gap(word: str) -> float:
        p, q = with_[word] / n[0], without[word] / n[1]
        return (p - q) / np.sqrt((with_[word] + without[word] + 2) / sum(n))

    telling = sorted(with_, key=lambda w: (-gap(w), w))[: LANDMARKS[0]]
    rest = sorted((with_ | without).keys() - set(telling), key=lambda w: (hash_of(w), w))
    words = {w[:40] for w in telling + rest[: LANDMARKS[1]]}
    parted = {sign.join(w[:40]) for w in telling[:PARTED] for sign in BETWEEN[:2]}
    return sorted(words | parted), telling[:PARTED]


def parted_copy(text: str, words: set[str]) -> str | None:
    """The sentence with a character between the letters of one of these words, if it has any."""
    parts = text.split()
    found = [i for i, w in enumerate(parts) if w.lower() in words and len(w) > 2]
    if not found:
        return None
    at = found[hash_of(text) % len(found)]
    parts[at] = BETWEEN[hash_of(text + "+") % len(BETWEEN)].join(parts[at])
    return " ".join(parts)


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def fit_sentences(texts: list[str], owner: np.ndarray, toxic: np.ndarray) -> Model:
    """The machine from sentences, the document of each and that document's label."""
    landmarks, telling = choose_landmarks(texts, owner, toxic)
    marks = Landmarks(landmarks)
    root = nystroem(marks.own())
    x = marks.mapped(texts, root)
    # a toxic document begins with its sentences that hold a telling word, or with all of them
    holds = np.array([not set(telling).isdisjoint(t.lower().split()) for t in texts], bool)
    positive = toxic & holds
    first = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
    for start, stop in zip(first, np.append(first[1:], len(owner))):
        if not positive[start:stop].any():
            positive[start:stop] = toxic[start:stop]
    for _ in range(ROUNDS):
        w = squared_hinge(x, np.where(positive, 1.0, -1.0), class_shares(positive))
        value = x @ w
        again = toxic & (value > np.quantile(value[~toxic], CLEAR))
        for start, stop in zip(first, np.append(first[1:], len(owner))):
            if toxic[start] and not again[start:stop].any():
                again[start + value[start:stop].argmax()] = True
        if (again == positive).all():
            break
        positive = again
    copies, hits = [], []
    usual = set(landmarks) - set(telling) | {w for t in texts[:200] for w in t.lower().split()}
    for text, mark, hit in zip(texts, toxic, positive):
        copy = parted_copy(text, set(telling) if hit else usual - set(telling)) if hit or not mark else None
        if copy is not None:
            copies.append(copy)
            hits.append(bool(hit))
    x = np.concatenate((x, marks.mapped(copies, root)))
    positive = np.concatenate((positive, np.array(hits, bool)))
    w = squared_hinge(x, np.where(positive, 1.0, -1.0), class_shares(positive))
    beta = root @ w[:-1]
    folded: dict[int, float] = {}
    for j, word in enumerate(landmarks):
        for number, weight in landmark_features(word).items():
            folded[number] = folded.get(number, 0.0) + beta[j] * weight
    numbers = np.array(sorted(folded), np.int64)
    return Model(numbers, np.array([folded[n] for n in numbers.tolist()], np.float32), float(w[-1]))


# -- Spark -----------------------------------------------------------------------------------


def labelled_sample(labels: DataFrame, per_class: int) -> tuple[dict[int, int], float]:
    """Up to ``per_class`` ids of each class by hash, and the share of toxic ids among all.

    Neither has ids that are held back.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .where(~held_back("doc_id", FOLDS)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    out: dict[int, int] = {}
    for mark in (0, 1):
        drawn = known.where(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        out |= {row.doc_id: mark for row in drawn.collect()}
    share = known.agg(F.avg("toxic")).first()[0]
    return out, float(share or 0.0)


def sentences_of(batches: Iterator[pd.DataFrame], most: dict[int, int]) -> Iterator[pd.DataFrame]:
    """Up to ``most[doc_id]`` sentences of each document, by hash."""
    for frame in batches:
        ids, texts = [], []
        for doc, text in zip(frame["doc_id"], frame["text"]):
            starts = sentence_starts(points(text))
            ends = np.append(starts[1:], len(text))
            picked = sorted(zip(starts.tolist(), ends.tolist()), key=lambda p: hash_of(f"{doc}:{p[0]}"))
            ids += [doc] * len(picked[: most[doc]])
            texts += [text[a:b] for a, b in picked[: most[doc]]]
        yield pd.DataFrame({"doc_id": ids, "text": texts})


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> Model:
    """A model from the labelled documents that are not held back.

    The logistic step is fitted on a quarter of the sample with a machine from the other three;
    the machine that scores is fitted on all of it.
    """
    small_batches(documents.sparkSession)
    marks, share = labelled_sample(labels, per_class)
    ids = sorted(marks)
    rows = documents.where(F.col("doc_id").isin(ids)).select("doc_id", known_text().alias("text"))
    first = [i for i in ids if hash_of(f"part:{i}") % 4]
    held = sorted(set(ids) - set(first))
    if not {0, 1} <= {marks[i] for i in first} or not {0, 1} <= {marks[i] for i in held}:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, constant=share)
    sizes = Counter(marks.values())
    most = {i: 1 + SAMPLE_SENTENCES // sizes[marks[i]] for i in ids}
    drawn = rows.mapInPandas(
        lambda b: sentences_of(b, most), "doc_id bigint, text string"
    ).toPandas().sort_values(["doc_id", "text"])
    part = drawn[drawn["doc_id"].isin(first)]

    def machine(sentences: pd.DataFrame) -> Model:
        owner = sentences["doc_id"]
        return fit_sentences(
            sentences["text"].tolist(), owner.to_numpy(), owner.map(marks).to_numpy() == 1
        )

    model = machine(part)
    sizes = Counter(marks[i] for i in held)

    def signals(batches):
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": list(model.signals(frame["text"]))})

    seen = rows.where(F.col("doc_id").isin(held)).mapInPandas(
        signals, "doc_id bigint, x array<double>"
    ).toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(seen["x"].to_list())
    step = logistic(x, (seen["doc_id"].map(marks).to_numpy() == 1).astype(float))
    step[-1] += np.log(share / (1 - share)) - np.log(sizes[1] / sizes[0])
    final = machine(drawn)
    return Model(final.numbers, final.values, final.offset, tuple(step.tolist()))


def with_score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns plus the score of the whole text."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)  # as large as its landmarks, whatever the input

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts))

    return df.withColumn(out, score(known_text(text)))


def drop_toxic(df: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows below the threshold, with their columns as they were."""
    out = fresh(df, "toxicity")
    return with_score(df, model, out=out).where(F.col(out) < threshold).select(*df.columns)


def scored_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted class of every document."""
    model = fit(documents, labels)
    rows = documents.select("doc_id", "text", held_back("doc_id", FOLDS).alias("held_out"))
    scored = with_score(rows, model).select("doc_id", "held_out", "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
