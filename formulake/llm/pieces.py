"""SentencePiece encoding by suffix-array matching, and decoding.

Text is cut before each run of spaces that follows a word, which no piece crosses. The distinct
words of a batch that aren't known yet are concatenated and indexed by a suffix array over the
first symbols of each suffix, as many as the longest piece has. Every piece is looked up by
binary search, which gives the range of its occurrences; each occurrence is an edge from its
first to behind its last character. Edges are sorted by position and relaxed from left to right.

The model's pieces are merges (BPE), so the best path isn't the one with the largest sum but the
one that merging would leave. A sequence of pieces is that one if every two neighbours are: no
merge across their border would have come before the merges that made them. So relaxing an edge
means to ask whether its piece can stand behind the piece that ends where it begins; for every
position exactly one does. The question is answered once for each pair of pieces and remembered.
Words that hold runs of spaces, whose pieces all have the same rank, and very long ones are
merged directly.

Characters that no piece has become byte pieces. Spaces become the mark ``▁``, and one is put in
front. Decoding joins pieces and bytes, gives spaces back and drops the one in front; a text that
itself holds the mark comes back with spaces in its place, as with the model's own library.
Null texts give no ids and decode to a null; empty texts give no ids. Repeated rows give
repeated rows; extra columns are kept. Empty tables give empty results.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulake.llm.common import small_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KNOWN_WORDS = 500_000  # words that a worker remembers before it starts again
KNOWN_PAIRS = 2_000_000
BATCH = 1000  # texts that are indexed together
LONG_WORD = 20_000  # characters from which a word is merged directly
INDEXED = 300_000  # characters that are indexed at once
SEPARATOR = "\0"
NONE = -1


class Model:
    """Pieces of a model file: ids by text, ranks, byte ids."""

    def __init__(self, path: str):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        n = source.get_piece_size()
        self.texts = [source.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (source.is_byte(i) or source.is_control(i) or source.is_unknown(i))]
        self.ids = {self.texts[i]: i for i in plain}
        self.rank = {self.texts[i]: -source.get_score(i) for i in plain}
        self.byte_ids = {int(self.texts[i][3:5], 16): i for i in range(n) if source.is_byte(i)}
        self.raw = [
            bytes([int(t[3:5], 16)]) if source.is_byte(i) else b"" if source.is_control(i)
            else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)
        ]
        inner = [t for t in self.ids if MARK in t.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces cross words: {inner[:3]}")
        # single characters and pieces that merging leaves whole can stand in a result
        self.whole = {t: i for t, i in self.ids.items() if len(t) == 1 or self.merged(t) == [t]}
        self.longest = max(map(len, self.whole))
        self.whole_ids = np.array(list(self.whole.values()), np.int64)
        self.whole_sizes = np.array([len(t) for t in self.whole], np.int64)
        self.whole_codes = np.zeros((len(self.whole), self.longest), np.uint32)
        for k, text in enumerate(self.whole):
            self.whole_codes[k, : len(text)] = [ord(c) for c in text]
        self.forget()
        self.pair_keys, self.pair_answers = np.zeros(0, np.int64), np.zeros(0, bool)
        self._tree()

    def forget(self) -> None:
        """Starts with no known word; their ids stand one behind the other in ``flat``."""
        self.known: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def remember(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.flat.append(ids.astype(np.int32))
        self.sizes.append(sizes)

    def merged(self, word: str, keep: int = 1) -> list[str]:
        """Pieces that merging leaves: always the best ranked pair, the leftmost of equals.

        Stops early when only ``keep`` pieces are left.
        """
        parts: list[str | None] = list(word)
        behind = list(range(1, len(parts) + 1))
        ahead = list(range(-1, len(parts) - 1))
        heap = [
            (self.rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank
        ]
        heapify(heap)
        left = len(parts)
        while heap and left > keep:
            _, at, text = heappop(heap)
            to = behind[at]
            if parts[at] is None or to >= len(parts) or parts[at] + parts[to] != text:
                continue  # one side has changed since
            parts[at], parts[to] = text, None
            behind[at] = behind[to]
            if behind[at] < len(parts):
                ahead[behind[at]] = at
            left -= 1
            for first, second in ((ahead[at], at), (at, behind[at])):
                if first >= 0 and second < len(parts) and parts[first] + parts[second] in self.rank:
                    both = parts[first] + parts[second]
                    heappush(heap, (self.rank[both], first, both))
        return [p for p in parts if p is not None]

    def _tree(self) -> None:
        """The two parts that each whole piece was merged from last."""
        self.left, self.right = {}, {}
        for text in self.whole:
            if len(text) > 1:
                self.left[text], self.right[text] = self.merged(text, keep=2)

    def can_follow(self, first: int, second: int) -> bool:
        """Whether merging the two pieces' text leaves the two pieces.

        A piece's last part, that part's last part and so on are what touches the border while
        the piece grows; a merge across the border wins if both its sides are there at a time
        and its rank is before the ranks of the merges that swallow them. A tie goes to the left.
        """
        sides = []
        for text, part in ((self.texts[first], self.right), (self.texts[second], self.left)):
            spine = [(text, np.inf)]  # each with the rank of the merge that swallows it
            while text in part:
                rank = self.rank[text]
                text = part[text]
                spine.append((text, rank))
            sides.append(spine)
        for a, a_end in sides[0]:
            for b, b_end in sides[1]:
                cross = self.rank.get(a + b)
                if cross is None or not (cross < a_end and cross <= b_end):
                    continue
                born = max(self.rank[a] if len(a) > 1 else -1, self.rank[b] if len(b) > 1 else -1)
                if min(a_end, b_end) > born:  # both are there at some time
                    return False
        return True

    # -- encoding ----------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of whole texts."""
        ids, cuts = self.encode_flat(texts)
        return [
            None if t is None else ids[a:b] for t, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist())
        ]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one behind the other, and where each text's begin and end."""
        rows = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = [w for row in rows for w in row]
        new = set(words) - self.known.keys()
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.forget()
            new = set(words)
        odd = sorted(w for w in new if MARK * 2 in w or SEPARATOR in w or len(w) > LONG_WORD)
        if odd:
            spelled = [self.spelled(self.merged(w)) for w in odd]
            self.remember(odd, np.array([len(x) for x in spelled], np.int64), np.concatenate(spelled))
        self.learn(sorted(new.difference(odd)))
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        flat, sizes = self.flat[0], self.sizes[0]
        first = np.cumsum(sizes) - sizes
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = flat[np.arange(ends[-1]) + np.repeat(first[which] - ends + counts, counts)]
        return ids, np.concatenate(([0], ends))[np.cumsum([0, *map(len, rows)])]

    def spelled(self, parts: list[str]) -> np.ndarray:
        """Ids of pieces, bytes for what the model doesn't have."""
        out: list[int] = []
        for part in parts:
            if part in self.ids:
                out.append(self.ids[part])
            else:
                out += [self.byte_ids[b] for b in part.encode()]
        return np.array(out, np.int32)

    def learn(self, words: list[str]) -> None:
        """Encodes words by suffix array, edges and relaxation."""
        some: list[str] = []
        size = 0
        for word in words:
            some.append(word)
            size += len(word) + 1
            if size >= INDEXED:
                self.learn_some(some)
                some, size = [], 0
        if some:
            self.learn_some(some)

    def learn_some(self, words: list[str]) -> None:
        joined = SEPARATOR.join([*words, ""])
        if len(set(joined)) > 60_000:  # more characters than two bytes can number
            half = len(words) // 2
            for part in (words[:half], words[half:]):
                self.learn_some(part)
            return
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        begin, piece, size = self.occurrences(joined)
        # no edge leaves its word, as pieces hold no separator
        last = np.full(len(joined) + 1, NONE, np.int64)  # piece that ends at each position
        before = np.full(len(joined) + 1, NONE, np.int64)  # where that piece begins
        offset = np.arange(len(joined) + 1)
        offset -= np.repeat(np.append(starts, len(joined)), np.append(lengths + 1, 1))
        order = np.argsort(offset[begin] * len(joined) + begin)
        begin, piece, size = begin[order], piece[order], size[order]
        cuts = np.searchsorted(offset[begin], np.arange(int(lengths.max()) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            own = slice(a, b)
            ok = self.allowed(last[begin[own]], piece[own], offset[begin[own]] == 0)
            to = begin[own][ok] + size[own][ok]
            last[to], before[to] = piece[own][ok], begin[own][ok]
        self.trace(words, joined, starts, ends, last, before)

    def occurrences(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, piece and length of every occurrence of every whole piece, and of unknown characters."""
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, small = np.unique(codes, return_inverse=True)
        code = np.concatenate(((small + 1), np.zeros(self.longest, np.int64))).astype(">u2")
        windows = np.lib.stride_tricks.sliding_window_view(code, self.longest)[: len(codes)]
        keys = np.ascontiguousarray(windows).view(f"S{2 * self.longest}").reshape(-1)
        array = np.argsort(keys, kind="stable")
        ordered = keys[array]
        # pieces in the batch's alphabet; one that has a character from outside can't occur
        place = np.searchsorted(alphabet, self.whole_codes).clip(max=len(alphabet) - 1)
        filled = self.whole_codes > 0
        usable = ((alphabet[place] == self.whole_codes) | ~filled).all(axis=1)
        low = np.where(filled, place + 1, 0)[usable].astype(">u2")
        high = np.where(filled, place + 1, 65535)[usable].astype(">u2")
        kind = f"S{2 * self.longest}"
        first = np.searchsorted(ordered, np.ascontiguousarray(low).view(kind).reshape(-1), "left")
        after = np.searchsorted(ordered, np.ascontiguousarray(high).view(kind).reshape(-1), "right")
        counts = after - first
        where = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        ids, size = self.whole_ids[usable], self.whole_sizes[usable]
        begin = array[where]
        lone = np.flatnonzero(np.isin(codes, [c for c in alphabet.tolist() if chr(c) not in self.whole and c]))
        out = (begin, np.repeat(ids, counts), np.repeat(size, counts))
        extra = (lone, np.full(len(lone), NONE - 1, np.int64), np.ones(len(lone), np.int64))
        return tuple(np.concatenate(pair) for pair in zip(out, extra))

    def allowed(self, first: np.ndarray, second: np.ndarray, at_start: np.ndarray) -> np.ndarray:
        """Which edges may follow the piece that ends where they begin."""
        free = at_start | (first < NONE) | (second < NONE)
        out = free & (at_start | (first != NONE))
        ask = np.flatnonzero(~free & (first != NONE))
        pairs, place = np.unique(first[ask] << 20 | second[ask], return_inverse=True)
        if len(ask):
            out[ask] = self.answered(pairs)[place]
        return out

    def answered(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each of these different pairs can stand; what is new is remembered."""
        at = np.searchsorted(self.pair_keys, pairs)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == pairs[known]
        out = np.zeros(len(pairs), bool)
        out[known] = self.pair_answers[at[known]]
        new = pairs[~known]
        if len(new):
            out[~known] = [self.can_follow(p >> 20, p & 0xFFFFF) for p in new.tolist()]
            if len(self.pair_keys) + len(new) > KNOWN_PAIRS:
                self.pair_keys, self.pair_answers = self.pair_keys[:0], self.pair_answers[:0]
                at = np.zeros(len(pairs), np.int64)
            self.pair_answers = np.insert(self.pair_answers, at[~known], out[~known])
            self.pair_keys = np.insert(self.pair_keys, at[~known], new)
        return out

    def trace(self, words, joined, starts, ends, last, before) -> None:
        """Walks back from every word's end, all words at once."""
        at = ends.copy()
        steps = []
        rows = np.arange(len(words))
        while len(rows):
            steps.append((rows, last[at], before[at]))
            at = before[at]
            more = at > starts[rows]
            rows, at = rows[more], at[more]
        owner = np.concatenate([r for r, _, _ in steps])
        piece = np.concatenate([p for _, p, _ in steps])
        begin = np.concatenate([b for _, _, b in steps])
        order = np.lexsort((begin, owner))
        owner, piece, begin = owner[order], piece[order], begin[order]
        sizes = np.bincount(owner, minlength=len(words))
        strange = np.unique(owner[piece < NONE])
        if len(strange):  # words with characters that no piece has become bytes there
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            plain = ~np.isin(owner, strange)
            spelled = [
                self.spelled([
                    self.texts[piece[j]] if piece[j] >= 0 else joined[begin[j]]
                    for j in range(cuts[k], cuts[k + 1])
                ]) for k in strange.tolist()
            ]
            self.remember([words[k] for k in strange.tolist()], np.array([len(x) for x in spelled], np.int64),
                          np.concatenate(spelled))
            keep = np.ones(len(words), bool)
            keep[strange] = False
            words = [w for w, k in zip(words, keep) if k]
            sizes, piece = sizes[keep], piece[plain]
        self.remember(words, sizes, piece)

    # -- decoding ----------------------------------------------------------------------------

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


# -- Spark -----------------------------------------------------------------------------------


def id_lists(texts: pa.Array, path: str) -> pa.Array:
    """A list of ids for each text, null for null."""
    ids, cuts = model(path).encode_flat(texts.to_pylist())
    missing = pa.array(np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
    offsets = pc.if_else(missing, pa.scalar(None, pa.int32()), pa.array(cuts.astype(np.int32)))
    return pa.ListArray.from_arrays(offsets, pa.array(ids))


def texts_of(ids: pa.Array, path: str) -> pa.Array:
    """The text of each list of ids, null for null."""
    own = model(path)
    return pa.array([None if row is None else own.decode(row) for row in ids.to_pylist()], pa.string())


def encoded(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """The table with an array of ids for each text."""
    small_batches(df.sparkSession, BATCH)
    path = path or model_path()

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return id_lists(texts, path)

    return df.withColumn(ids, encode(F.col(text)))


def decoded(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """The table with the text of each array of ids."""
    small_batches(df.sparkSession, BATCH)
    path = path or model_path()

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        return texts_of(rows, path)

    return df.withColumn(text, decode(F.col(ids)))


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, their number, the bytes among them, and whether decoding gives the text back.

    Encodes and decodes where the text is, so that ids aren't sent to Python a second time.
    """
    small_batches(documents.sparkSession, BATCH)
    path = path or model_path()

    @F.arrow_udf("struct<ids:array<int>,same_text:boolean>")
    def both(texts: pa.Array) -> pa.Array:
        ids = id_lists(texts, path)
        back = texts_of(ids, path)
        same = [a == b for a, b in zip(texts.to_pylist(), back.to_pylist())]
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "same_text"])

    own = model(path)
    first, last = min(own.byte_ids.values()), max(own.byte_ids.values())
    found = documents.select("doc_id", both(F.col("text")).alias("b")).select("doc_id", "b.ids", "b.same_text")
    return found.select(
        "doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_ids"),
        F.size(F.filter("ids", lambda i: i.between(first, last))).cast("bigint").alias("n_bytes"), "same_text",
    )
