"""Quality counts and the cascade against plain Python."""

import random
import re
from collections import Counter

from formulake.llm import rules as R
from formulake.llm.queries import QUERIES, SQL
from formulake.plans.compare import connect, differences


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    n, chars = len(words), sum(map(len, words))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    dups = len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(repeated) > 50 * n
    kept = not failed and 2 <= chars / n <= 16 and symbols <= 0.1 * n and dups <= 0.6 * len(lines)
    return n, chars, symbols, dups, len(repeated), failed, kept


def texts():
    rng = random.Random(1)
    words = ["a", "bb", "ccc", "é€", "#x", "|", "word", "long" * 6, "😀"]
    out = [None, "", " \n\t", "one", "a a a a", "a b c a b c", "\x0b".join("abc") + " x\n\nx\r\nx"]
    for size in (5, 49, 50, 51, 200, 200, 200):
        for pool in (3, 5, 9):
            out.append("".join(rng.choice(words[:pool]) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(size)))
    out += [" ".join(f"w{rng.randint(0, 400)}" for _ in range(300)) for _ in range(5)]
    out += ["line one here\n" * 60 + " ".join(f"v{i}" for i in range(90)), "x " * 30_000]
    return out


def test_counts_equal_plain_python(spark, docs_of):
    given = texts()
    got = {r.doc_id: r for r in R.measures(docs_of(list(enumerate(given)))).collect()}
    for i, text in enumerate(given):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(text), text


def test_every_order_gives_the_same_verdict(spark, docs_of):
    given = texts()
    table = docs_of(list(enumerate(given)))
    want = {i for i, t in enumerate(given) if brute(t)[-1]}
    names = [r.name for r in R.RULES]
    for order in (names, names[::-1]):
        kept = table.where(R.first_failed(R.known_text(), order).isNull())
        assert {r.doc_id for r in kept.collect()} == want
    kept = R.keep_good(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == want
    assert R.keep_good(table.limit(0)).count() == R.measures(table.limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark, docs_of):
    order = R.plan_cascade(docs_of(list(enumerate(texts()))))
    assert sorted(m.name for m in order) == sorted(r.name for r in R.RULES)
    assert [m.worth for m in order] == sorted((m.worth for m in order), reverse=True)


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(QUERIES["op8_quality_rules"](spark, sf_dir), connect(sf_dir), SQL["op8_quality_rules"]) == []
