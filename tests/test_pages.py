"""Pages of positions and the approximate flag of candidates."""

from formulake.operators import extract as X


def test_positions_find_their_page(spark):
    texts = spark.createDataFrame([(1, "one\ntwo\n\nfour"), (2, "no break"), (3, "")], "doc_id bigint, body string")
    starts = X.page_starts(texts, "doc_id", "body")
    assert sorted(map(tuple, starts.collect())) == [(1, 1, 0), (1, 2, 4), (1, 3, 8), (1, 4, 9), (2, 1, 0), (3, 1, 0)]
    asked = [(1, 0), (1, 3), (1, 4), (1, 7), (1, 8), (1, 9), (1, 400), (1, None), (2, 5), (9, 3), (2, 5)]
    rows = spark.createDataFrame([(*a, "x") for a in asked], "doc_id bigint, at bigint, source string")
    found = X.with_page(rows, starts, "doc_id", "at")
    assert found.columns == ["doc_id", "at", "source", "page"]
    got = sorted(((r.doc_id, r.at, r.page) for r in found.collect()), key=str)
    pages = {(1, 0): 1, (1, 3): 1, (1, 4): 2, (1, 7): 2, (1, 8): 3, (1, 9): 4, (1, 400): 4, (2, 5): 1}
    assert got == sorted(((*a, pages.get(a)) for a in asked), key=str)
    assert X.with_page(rows.limit(0), starts, "doc_id", "at").count() == 0


def test_drafts_name_the_page_and_the_approximation(spark):
    page = "Nothing here.\n"
    near = "The lipids were mixed at a ratio of 50:10:38.5:1.5 and the encapsulation efficiency was {} 92%."
    texts = spark.createDataFrame(
        [(1, page * 3 + near.format("above")), (2, near.format("")), (3, page + near.format("about"))],
        "doc_id bigint, body string")
    rows = X.text_candidates(texts, "doc_id", "body")
    found = {r.doc_id: (r.page, r.ee, r.approx) for r in X.paged(rows, X.page_starts(texts, "doc_id", "body")).collect()}
    assert {k: v[0] for k, v in found.items()} == {1: 4, 2: 1, 3: 2}
    assert {k: v[1] for k, v in found.items()} == {1: 92.0, 2: 92.0, 3: 92.0}
    assert found[2][2] is False and (found[1][2] or found[3][2])
