"""Alignment of two tokenizers over the same text: A, byte-level merges, and B, pieces with byte fallback.

Both encode a space and the text. Where a token of A and one of B end at the same byte, the text is
cut; the tokens between two cuts are a group, and two tokens are linked if their bytes overlap.

Lockstep: the texts of a chunk are lanes, and a state of two NumPy vectors holds the current token
of A and of B of every lane. Each step emits the link of every lane's two tokens, notes a cut where
both end together, and moves the pointer of the token that ends first, or both. Finished lanes are
taken out of the state. A lane needs no beginning of a text: at any byte, the token of A and the token
of B that hold it are a state the merge passes, so long texts are many lanes of ``LANE`` bytes.

Neither tokenizer has a token that goes on behind a character and then a space (checked when the
files are read), so a text is certainly cut before each space that follows something else. The pieces
between are encoded and aligned once for each chunk of texts, and the text is the sequence of its
pieces. Chunks are written once to the shared folder with the distinct linked id pairs of each and
how often each comes. Pairs are summed over all chunks by a shuffle, the highest sum of each B id is
joined to them (a table no larger than the vocabulary of B), and the sums go back to the chunks that
asked. No task sees more than a chunk or a share of the pairs.

Rows: texts null or empty, and texts whose tokens don't spell a space and the text byte for byte
(those with U+2581, which B writes for a space), have no tokens: zeros, no groups, an empty digest.
Strings of special tokens are plain text. Repeated rows count as often as they are there, a null id
stays null, empty tables give empty results, extra columns are left out. One word longer than a chunk
is encoded by itself as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulake.llm.common import small_batches
from formulake.llm.ngram_lm import plane_packed, plane_unpacked
from formulake.session import materialise

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
CHUNK_CHARS = 8 << 20  # text of a chunk, about
LANE = 64  # bytes of a lane, about
ENCODED = 4096  # pieces that a library encodes at once
MARK = "▁"  # B's space
#: A space that follows a space of any kind, or begins the text.
ODD = re.compile(r"\s |^ ")
CUT = re.compile(r"(?<=\S) ")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both libraries' encoders and the bytes of every id."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_letters()
        with open(a_file, encoding="utf-8") as file:
            added = {t["id"] for t in json.load(file)["added_tokens"]}
        names = {i: name for name, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [
            names[i].encode() if i in added or i not in names else bytes(letters[c] for c in names[i])
            for i in range(max(names) + 1)
        ]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.IsByte(i) else piece.replace(MARK, " ").encode()
            for i, piece in enumerate(self.b.IdToPiece(k) for k in range(self.b.GetPieceSize()))
        ]
        if any(re.search(rb"[^ ] ", token) for token in self.b_bytes):
            raise ValueError("a piece of B goes on behind a space, so texts have no certain cuts")
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        # ids as text with what follows: inside a group, at its end
        self.a_names = np.array([f"{i}{s}" for s in ",|" for i in range(len(self.a_bytes))], object)
        self.b_names = np.array([f"{i}{s}" for s in ",;" for i in range(len(self.b_bytes))], object)

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each piece. B adds its space by itself, but not to nothing."""
        a, b = [], []
        for at in range(0, len(pieces), ENCODED):
            part = pieces[at : at + ENCODED]
            a += [e.ids for e in self.a.encode_batch([" " + p for p in part], add_special_tokens=False)]
            b += [ids if p else [self.b.PieceToId(MARK)] for p, ids in zip(part, self.b.encode(part, num_threads=1))]
        return a, b

    def spelled(self, piece: str, a: list[int], b: list[int]) -> bool:
        """Whether both sides spell a space and the piece."""
        own = (" " + piece).encode()
        return (b"".join(map(self.a_bytes.__getitem__, a)) == own
                and b"".join(map(self.b_bytes.__getitem__, b)) == own)


@functools.lru_cache(maxsize=2)
def tokenizers_of(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def pieces_of(text: str) -> list[str]:
    """The text cut at every space that follows something else; those spaces are left out."""
    return CUT.split(text) if ODD.search(text) else text.split(" ")


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """All links and cuts between tokens that end at these bytes.

    ``starts`` are bytes where lanes begin, ascending, the first one 0; a lane goes on to the next.
    Returns the A and the B token of every link, and of every cut the last tokens before it.
    """
    a = np.searchsorted(a_ends, starts, "right")
    b = np.searchsorted(b_ends, starts, "right")
    a_stop, b_stop = np.append(a[1:], len(a_ends)), np.append(b[1:], len(b_ends))
    links: tuple[list, list] = ([], [])
    cuts: tuple[list, list] = ([], [])
    on = (a < a_stop) | (b < b_stop)
    while True:
        if not on.all():
            a, b, a_stop, b_stop = a[on], b[on], a_stop[on], b_stop[on]
        if not len(a):
            break
        links[0].append(a)
        links[1].append(b)
        a_end, b_end = a_ends[a], b_ends[b]
        both = a_end == b_end
        cuts[0].append(a[both])
        cuts[1].append(b[both])
        a, b = a + (a_end <= b_end), b + (b_end <= a_end)
        on = (a < a_stop) | (b < b_stop)
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(none + part) for part in (*links, *cuts))


class Aligned:
    """Some pieces, encoded and aligned. Pieces that aren't spelled have no tokens."""

    def __init__(self, tok: Tokenizers, pieces: list[str]):
        a, b = tok.encode(pieces)
        self.good = np.fromiter(map(tok.spelled, pieces, a, b), bool, len(pieces))
        for i in np.flatnonzero(~self.good):
            a[i], b[i] = [], []
        self.n_a = np.fromiter(map(len, a), np.int64, len(a))
        self.n_b = np.fromiter(map(len, b), np.int64, len(b))
        self.a = np.fromiter(chain.from_iterable(a), np.int64, int(self.n_a.sum()))
        self.b = np.fromiter(chain.from_iterable(b), np.int64, int(self.n_b.sum()))
        a_ends, b_ends = np.cumsum(tok.a_sizes[self.a]), np.cumsum(tok.b_sizes[self.b])
        last = np.cumsum(self.n_a)
        stops = np.where(last > 0, a_ends[last - 1], 0) if len(a_ends) else last
        sizes = np.diff(stops, prepend=0)
        lanes = -(-sizes // LANE)
        order = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts = np.repeat(stops - sizes, lanes) + order * LANE
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(a_ends, b_ends, starts)
        self.piece_of_a = np.repeat(np.arange(len(pieces)), self.n_a)
        by_piece = np.argsort(self.piece_of_a[self.link_a], kind="stable")
        self.link_a, self.link_b = self.link_a[by_piece], self.link_b[by_piece]
        self.n_links = np.bincount(self.piece_of_a[self.link_a], minlength=len(pieces))
        self.cut_a.sort()
        self.cut_b.sort()
        self.n_groups = np.bincount(self.piece_of_a[self.cut_a], minlength=len(pieces))

    def names(self, tok: Tokenizers) -> list[str]:
        """The groups of each piece as text, each with a semicolon behind it."""
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[self.cut_a], b_last[self.cut_b] = True, True
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out = np.empty(len(self.a) + len(self.b), object)
        b_before = np.concatenate(([0], self.cut_b + 1))
        out[np.arange(len(self.a)) + b_before[a_group]] = tok.a_names[self.a + a_last * len(tok.a_bytes)]
        out[np.arange(len(self.b)) + self.cut_a[b_group] + 1] = tok.b_names[self.b + b_last * len(tok.b_bytes)]
        parts = out.tolist()
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(parts[i:j]) for i, j in zip([0] + stops, stops)]


def sums_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of neighbouring values, so many for each; exact."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    stops = np.cumsum(lengths)
    return total[stops] - total[stops - lengths]


# -- Spark -----------------------------------------------------------------------------------

CHUNK = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())),
    *[(name, pa.list_(pa.int64())) for name in ("n_a", "n_b", "n_groups", "n_links", "lengths")],
    ("pieces", pa.binary()), ("piece_links", pa.binary()), ("n_pieces", pa.int64()), ("links", pa.binary()),
    ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
CHUNK_SQL = (
    "chunk bigint, doc_ids array<bigint>, digests array<string>, n_a array<bigint>, n_b array<bigint>, "
    "n_groups array<bigint>, n_links array<bigint>, lengths array<bigint>, pieces binary, piece_links binary, "
    "n_pieces bigint, links binary, pairs array<bigint>, counts array<bigint>"
)


def sequences(texts: list[str | None]) -> tuple[list[str], list[list[int]]]:
    """The distinct pieces of some texts, and each text as numbers of pieces; none for null and empty ones."""
    place: dict[str, int] = {}
    own = [[place.setdefault(p, len(place)) for p in pieces_of(t)] if t else [] for t in texts]
    return list(place), own


def chunk_row(number: int, ids: list, texts: list, tok: Tokenizers) -> dict:
    pieces, own = sequences(texts)
    found = Aligned(tok, pieces)
    bad = set(np.flatnonzero(~found.good).tolist())
    if bad:
        own = [[] if not bad.isdisjoint(s) else s for s in own]
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    flat = np.fromiter(chain.from_iterable(own), np.int64, int(lengths.sum()))
    names = found.names(tok)
    digests = [
        hashlib.sha256("".join([names[i] for i in s])[:-1].encode()).hexdigest() if s else "" for s in own
    ]
    codes, place = np.unique(found.b[found.link_b] * len(tok.a_bytes) + found.a[found.link_a], return_inverse=True)
    often = np.bincount(flat, minlength=len(pieces))
    counts = np.bincount(place, np.repeat(often, found.n_links), len(codes)).astype(np.int64)
    sums = {
        name: sums_of(getattr(found, name)[flat], lengths).tolist() for name in ("n_a", "n_b", "n_groups", "n_links")
    }
    return {
        "chunk": number, "doc_ids": ids, "digests": digests, "lengths": lengths.tolist(), **sums,
        "pieces": plane_packed(flat), "piece_links": plane_packed(found.n_links), "n_pieces": len(pieces),
        "links": plane_packed(place), "pairs": codes.tolist(), "counts": counts.tolist(),
    }


def chunks_of(batches: Iterator[pa.RecordBatch], chars: int, a_file: str, b_file: str) -> Iterator[pa.RecordBatch]:
    """Documents in chunks of about this many characters, inside a partition."""
    tok = tokenizers_of(a_file, b_file)
    number = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text or "") + 16
            if size >= chars:
                yield pa.RecordBatch.from_pylist([chunk_row(number, ids, texts, tok)], CHUNK)
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield pa.RecordBatch.from_pylist([chunk_row(number, ids, texts, tok)], CHUNK)


def numbers(data: bytes, n: int) -> np.ndarray:
    return plane_unpacked(data, n) if n else np.zeros(0, np.int64)


def chunk_answers(row: pd.Series, answers: pd.DataFrame) -> pd.DataFrame:
    """The contract's rows of a chunk, from the sums of its pairs over all chunks."""
    total = np.zeros(len(row["pairs"]), np.int64)
    best = np.zeros(len(total), np.int64)
    total[answers["place"]], best[answers["place"]] = answers["total"], answers["best"]
    n_links = numbers(row["piece_links"], row["n_pieces"])
    links = numbers(row["links"], int(n_links.sum()))
    lengths = np.array(row["lengths"], np.int64)
    pieces = numbers(row["pieces"], int(lengths.sum()))
    out = {name: row[name] for name in ("n_a", "n_b", "n_groups", "n_links")}
    return pd.DataFrame({
        "doc_id": pd.array([None if i is None or i != i else int(i) for i in row["doc_ids"]], "Int64"), **out,
        "n_best": sums_of(sums_of(best[links], n_links)[pieces], lengths),
        "count_sum": sums_of(sums_of(total[links], n_links)[pieces], lengths),
        "groups_sha256": row["digests"],
    })


RESULT_SQL = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string"
)


def pair_totals(chunks: DataFrame, a_size: int) -> tuple[DataFrame, DataFrame]:
    """``(asker, place, pair)`` for the pairs of every chunk, and ``(pair, total, best)`` for every pair."""
    zipped = F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")
    rows = chunks.select(F.col("chunk").alias("asker"), zipped).select(
        "asker", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = materialise(rows.groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals")
    other = F.floor(F.col("pair") / a_size)
    highest = totals.groupBy(other.alias("other")).agg(F.max("total").alias("most"))
    marked = totals.withColumn("other", other).join(F.broadcast(highest), "other")  # a row for each B id at most
    return rows.drop("n"), marked.select("pair", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))


def link_counts(
    df: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, chars: int = CHUNK_CHARS
) -> DataFrame:
    """The contract's row for every document (doc_id, text)."""
    small_batches(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chunks = materialise(docs.mapInArrow(lambda b: chunks_of(b, chars, a_file, b_file), CHUNK_SQL), "token-chunks")
    asked, totals = pair_totals(chunks, len(tokenizers_of(a_file, b_file).a_bytes))
    answers = asked.join(totals, "pair").select("asker", "place", "total", "best")

    def finish(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return chunk_answers(mine.iloc[0], known)

    return chunks.drop("counts").groupBy("chunk").cogroup(answers.groupBy("asker")).applyInPandas(finish, RESULT_SQL)


ALIGNED_SQL = "array<struct<start:bigint,stop:bigint,a:array<bigint>,b:array<bigint>>>"


def text_groups(texts: list[str | None], tok: Tokenizers) -> list[list[dict]]:
    """The groups of each text: their bytes in space and text, and the ids of both sides."""
    pieces, own = sequences(texts)
    found = Aligned(tok, pieces)
    a_stops, b_stops = found.cut_a + 1, found.cut_b + 1
    a_starts, b_starts = np.concatenate(([0], a_stops[:-1])), np.concatenate(([0], b_stops[:-1]))
    first = np.cumsum(found.n_groups) - found.n_groups
    out = []
    for sequence in own:
        groups: list[dict] = []
        if all(found.good[i] for i in sequence):
            at = 0
            for i in sequence:
                for g in range(first[i], first[i] + found.n_groups[i]):
                    a = found.a[a_starts[g] : a_stops[g]]
                    size = int(tok.a_sizes[a].sum())
                    b = found.b[b_starts[g] : b_stops[g]]
                    groups.append({"start": at, "stop": at + size, "a": a.tolist(), "b": b.tolist()})
                    at += size
        out.append(groups)
    return out


def with_groups(
    df: DataFrame, text: str = "text", out: str = "groups", a_file: str = A_FILE, b_file: str = B_FILE
) -> DataFrame:
    """All rows and columns plus the groups of the whole text; none for texts without tokens."""
    small_batches(df.sparkSession)

    @F.pandas_udf(ALIGNED_SQL)
    def groups(texts: pd.Series) -> pd.Series:
        return pd.Series(text_groups(texts.tolist(), tokenizers_of(a_file, b_file)))

    return df.withColumn(out, groups(F.col(text)))
