import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from formulake.llm import alignment as L
from formulake.llm.common import read

TOK = L.tokenizers_of(L.A_FILE, L.B_FILE)
WHOLE_A = Tokenizer.from_file(L.A_FILE)
WHOLE_A.encode_special_tokens = True
WHOLE_B = sentencepiece.SentencePieceProcessor(model_file=L.B_FILE)
MAP = L.byte_letters()


def naive_tokens(text):
    """Ids and bytes of both sides for a whole text; nothing if the bytes differ."""
    if not text:
        return [], []
    a = [(i, bytes(MAP[c] for c in WHOLE_A.id_to_token(i)))
         for i in WHOLE_A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in WHOLE_B.encode(text):
        piece = WHOLE_B.id_to_piece(i)
        b.append((i, bytes.fromhex(piece[3:5]) if WHOLE_B.is_byte(i) else piece.replace("▁", " ").encode()))
    own = (" " + text).encode()
    if b"".join(t for _, t in a) != own or b"".join(t for _, t in b) != own:
        return [], []
    return a, b


def naive(text):
    """Links as id pairs, and groups, by two pointers."""
    a, b = naive_tokens(text)
    links, groups, i, j = [], [([], [])], 0, 0
    a_end, b_end = len(a[0][1]) if a else 0, len(b[0][1]) if b else 0
    while i < len(a):
        links.append((a[i][0], b[j][0]))
        one, other = a_end <= b_end, b_end <= a_end
        if one:
            groups[-1][0].append(a[i][0])
            i += 1
        if other:
            groups[-1][1].append(b[j][0])
            j += 1
        if one and other:
            groups.append(([], []))
        a_end += len(a[i][1]) if one and i < len(a) else 0
        b_end += len(b[j][1]) if other and j < len(b) else 0
    return links, groups[:-1], len(a), len(b)


def digest(groups):
    if not groups:
        return ""
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    own = [(i, *naive(t)) for i, t in rows]
    counts = Counter(pair for _, links, *_ in own for pair in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((
        i, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links),
        sum(counts[p] for p in links), digest(groups),
    ) for i, links, groups, n_a, n_b in own), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "a  b \n c\t d "), (6, "with ▁ mark"), (7, "it's <|endoftext|> <s> plain </s>"),
    (8, "中文字符 Ünïcödé 👩‍👩‍👧   x  y"), (8, "中文字符 Ünïcödé 👩‍👩‍👧   x  y"), (None, "no id"), (9, "x" * 40_000),
    (10, "ab " * 30_000), (11, " " * 20_000 + "end"), (12, "\x00 nul \x1f sep"), (13, "\n\n  two\r\n lines  "), (14, "1234567 89,5 €"),
]


def test_odd_rows(docs_of):
    docs = docs_of(ODD)
    assert got(L.link_counts(docs)) == expected(ODD)
    assert got(L.link_counts(docs.repartition(5), chars=300)) == expected(ODD)
    assert got(L.link_counts(docs.limit(0))) == []
    assert got(L.link_counts(docs_of([(1, None), (2, "▁")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_given_table_against_whole_texts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    assert got(L.link_counts(docs, chars=100_000)) == expected([(r.doc_id, r.text) for r in docs.collect()])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(
    st.sampled_from(" \n\t aeinrst'.,0▁ 　éß中👍<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40),
    min_size=1, max_size=4))
def test_pieces_give_the_tokens_of_whole_texts(texts):
    found = L.text_groups(texts, TOK)
    for text, groups in zip(texts, found):
        links, own, *_ = naive(text)
        assert [(g["a"], g["b"]) for g in groups] == own
        raw = (" " + text).encode()
        for g in groups:
            assert b"".join(TOK.a_bytes[i] for i in g["a"]) == raw[g["start"] : g["stop"]]


@pytest.mark.parametrize("lane", [1, 3, 64, 10**9])
def test_lanes_of_any_size_give_the_same(monkeypatch, lane):
    text = "ungewöhnlichkeitszusammenhang" * 50 + "x中" * 300
    monkeypatch.setattr(L, "LANE", lane)
    found = L.Aligned(TOK, [text, "", "kurz", "▁"])
    links, groups, n_a, n_b = naive(text)
    own = found.piece_of_a[found.link_a] == 0
    pairs = Counter(zip(found.a[found.link_a[own]].tolist(), found.b[found.link_b[own]].tolist()))
    assert pairs == Counter(links)
    assert found.n_groups[0] == len(groups) and found.n_a[0] == n_a and found.n_b[0] == n_b
    assert found.good.tolist() == [True, True, True, False]


def test_all_ids_spell_their_bytes():
    assert len(TOK.a_bytes) == 50_257 and len(TOK.b_bytes) == 32_000
    assert TOK.a_bytes[50_256] == b"<|endoftext|>"
    assert sorted(t for t in TOK.a_bytes if len(t) == 1) == [bytes([b]) for b in range(256)]


def test_groups_keep_columns(docs_of):
    docs = docs_of(ODD)
    rows = L.with_groups(docs).collect()
    assert L.with_groups(docs).columns == [*docs.columns, "groups"]
    for row in rows:
        assert [(g.a, g.b) for g in row.groups] == naive(row.text)[1]
    assert np.all([r.groups == [] for r in rows if not r.text])
