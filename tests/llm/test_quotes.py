"""Quotation linking against plain Python."""

import random
import re

from formulake.llm import quotes as Q


def norm(text):
    return re.sub(r"\s+", " ", text).strip(" ").lower()


def parse(text, partial=False):
    lines = []
    for line in re.split(r"\r?\n", text or ""):
        marks = re.match(r"[ \t]*((?:>[ \t]*)*)", line)
        level = marks[1].count(">")
        lines.append((level, line[marks.end():] if level else line))
    passages, before = [], None
    for level, body in lines:
        body = norm(body)
        if body and before == level:
            passages[-1][1].append(body)
        elif body:
            passages.append((level, [body]))
        before = level if body else None
    own = "\n".join(b for v, b in lines if v == 0).strip()
    joined = [(v, " ".join(b)) for v, b in passages]
    says = {b for v, b in joined if v == 0} | {norm(b) for v, b in lines if v == 0 and norm(b)}
    for v, b in passages:
        if v == 0 and partial:
            says |= set(b) | set(sentences(" ".join(b)))
    return own, says, [(v, " ".join(b), b) for v, b in passages if v > 0]


def sentences(text):
    return re.split(r"(?<=[.!?…。！？])\s+", text)


def part_of(c, t, text, lines, first, sayers):
    """The earlier message that half of a passage was first said in, the weightiest one."""
    best = []
    for pieces in (set(lines), set(sentences(text))):
        same, weight = {}, {}
        for x in pieces:
            p = first.get((c, x))
            if p is not None and p < t:
                same[p] = same.get(p, 0) + len(x)
                weight[p] = weight.get(p, 0) + len(x) * 1000 // sayers[c, x]
        best += [(weight[p], p) for p, n in same.items() if 2 * n >= sum(map(len, pieces))]
    return max(best)[1] if best else None


def brute(rows, partial=False):
    parsed = [(c, t, *parse(x, partial)) for c, t, _, x in rows]
    first, sayers, parent = {}, {}, {}
    for c, t, _, says, _ in parsed:
        for s in says:
            if c is not None and t is not None:
                first[c, s] = min(t, first.get((c, s), t))
                sayers[c, s] = sayers.get((c, s), 0) + 1
    for c, t, _, _, quotes in parsed:
        for v, b, lines in quotes:
            p = first.get((c, b))
            if c is None or t is None:
                continue
            if p is not None and p < t:
                parent.setdefault((c, t), []).append((v, 0, -p))
            elif partial and (p := part_of(c, t, b, lines, first, sayers)) is not None:
                parent.setdefault((c, t), []).append((v, 1, -p))
    parent = {k: -min(v)[2] for k, v in parent.items()}

    def up(c, t):
        depth = 0
        while (c, t) in parent:
            t, depth = parent[c, t], depth + 1
        return t, depth

    return [(c, t, own, parent.get((c, t)), *up(c, t)) for c, t, own, _, _ in parsed]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, thread string, own int"


def run(spark, rows, partial=False):
    table = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA)
    return Q.reply_ordered(table, partial)


def by_text(rows):
    return sorted(rows, key=str)


def test_threads_equal_plain_python(spark):
    rng = random.Random(3)
    said = ["One line.", "Two  words\nand a second line", "ok", "A longer saying, here", "yes\n\nno"]
    rows = []
    for conv in range(6):
        for turn in range(14):
            parts = []
            for _ in range(rng.randint(0, 3)):
                level = rng.randint(0, 3)
                body = rng.choice([*said, f"unique {conv} {turn}", f"unique {conv} {rng.randint(0, 13)}"])
                parts += [("> " * level if rng.random() < 0.5 else ">" * level) + x for x in body.split("\n")]
                if rng.random() < 0.4:
                    parts.append("")
            rows.append((conv, turn, rng.choice(["user", None]), "\n".join(parts)))
    rows += [(1, 3, "user", "again"), (None, 1, "user", "> ok"), (2, None, "user", "> ok"), (3, 5, "user", None)]
    rows += [(4, 9, "user", "ok")] * 2 + [(5, 20, "user", "\r\n> " + "ok\r\nmine")]
    got = run(spark, rows).collect()
    assert by_text((r.conv_id, r.turn, r.text, r.reply_to, r.thread, r.depth) for r in got) == by_text(brute(rows))
    for r in got:
        assert r.formatted.startswith("<|im_start|>" + (r.role or "")) and r.role in ("user", "unknown")
    place = {(r.conv_id, r.turn): r.sort_key for r in got}
    assert all(place[r.conv_id, r.reply_to] < r.sort_key for r in got if r.reply_to is not None)


def test_parts_equal_plain_python(spark):
    rng = random.Random(8)
    lines = ["Thanks.", "ok", "A first sentence. And a second one.", "short", "some longer line that was said",
             "Another one! Really?", "the last of these lines"]
    rows = []
    for conv in range(8):
        for turn in range(12):
            parts = []
            for _ in range(rng.randint(1, 3)):
                level = rng.choice([0, 0, 1, 1, 2])
                body = rng.sample([*lines, f"only {conv} {turn}", f"only {conv} {rng.randint(0, 11)}"], rng.randint(1, 4))
                parts += ["> " * level + x for x in body]
                if rng.random() < 0.5:
                    parts.append("")
            rows.append((conv, turn, "user", "\n".join(parts)))
    rows += [(None, 1, "user", "> ok\n> x"), (2, None, "user", "> ok\n> x"), (4, 9, "user", "> Thanks.\n> ok")]
    expected = brute(rows, True)
    assert sum(r[3] is not None for r in expected) > sum(r[3] is not None for r in brute(rows)) + 5
    got = run(spark, rows, True).collect()
    assert by_text((r.conv_id, r.turn, r.text, r.reply_to, r.thread, r.depth) for r in got) == by_text(expected)


def test_a_common_line_links_nothing(spark):
    quoted = "> Nobody ever said this line.\n> Nor this one, for that matter.\n> Thanks.\n> And this is new as well."
    rows = [(1, 0, "user", "Hello there"), (1, 1, "user", "Thanks."), (1, 2, "user", quoted), (1, 3, "user", "> Thanks.")]
    assert {r.turn: r.reply_to for r in run(spark, rows, True).collect()} == {0: None, 1: None, 2: None, 3: 1}


def test_a_long_chain_and_a_hot_message(spark):
    chain = [(1, 0, "user", "start 0")] + [(1, k, "user", f"> start {k - 1}\nstart {k}") for k in range(1, 70)]
    fans = [(2, 0, "user", "the root")] + [(2, k, "user", "> The  ROOT\nok") for k in range(1, 300)]
    got = {(r.conv_id, r.turn): r for r in run(spark, chain + fans).collect()}
    assert got[1, 69].depth == 69 and got[1, 69].thread == 0 and got[1, 69].reply_to == 68
    assert all(got[2, k].reply_to == 0 and got[2, k].text == "ok" for k in range(1, 300))
    assert run(spark, chain).limit(0).count() == 0


def test_long_text_and_no_rows(spark):
    text = "\n".join(f"> line {k}" if k % 3 else f"mine {k}" for k in range(20_000))
    assert len(run(spark, [(1, 1, "user", text)]).first().text) == len(parse(text)[0])
    table = spark.createDataFrame([], SCHEMA)
    assert Q.reply_ordered(table).count() == 0


def test_parts_of_a_passage_find_their_message(spark):
    rows = [
        (1, 0, "user", "first line\nsecond line\nthird line"),
        (1, 1, "user", "One sentence here. Another sentence there. And a last one."),
        (1, 2, "user", "para one\n\npara two"),
        (1, 3, "user", "second line"),
        (1, 4, "user", "> first line\n> second line\nmine"),  # two of three lines
        (1, 5, "user", "> Another sentence\n> there. And a last\n> one.\nmine"),  # folded, begun late
        (1, 6, "user", "> para one\n> para two\nmine"),  # no quoted blank line between
        (1, 7, "user", "> third line\n> para one\n> para two"),  # most agree on turn 2
        (1, 8, "user", "> nothing that was said"),
        (1, 9, "user", "> first line\n> other words\n>\n> One sentence here. Another sentence there. And a last one."),
    ]
    table = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA)
    got = {r.turn: r.reply_to for r in Q.reply_ordered(table, partial=True).collect()}
    # turn 9: the whole passage comes before the partial one
    assert got == {0: None, 1: None, 2: None, 3: None, 4: 0, 5: 1, 6: 2, 7: 2, 8: None, 9: 1}
