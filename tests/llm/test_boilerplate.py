"""Line dedup of documents that are boilerplate but for a line or two, next to copies that keep their text."""

import random

from flowlens.llm import line_templates


def words(draw, n):
    return " ".join("".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(draw.randrange(2, 5))) for _ in range(n))


def test_boilerplate_beside_copies(spark):
    draw = random.Random(1)
    rows, want = [], {}

    def add(text, kept):
        want[len(rows)] = kept
        rows.append((len(rows), text))

    for docs, shared, own in ((100, 40, 1), (100, 30, 2), (40, 40, 1), (1000, 35, 1), (300, 20, 3)):
        stock = [words(draw, 8) for _ in range(shared)]
        for _ in range(docs):
            mine = [words(draw, 8) for _ in range(own)]
            lines = stock + mine
            draw.shuffle(lines)
            add("\n".join(lines), "\n".join(x for x in lines if x in mine))
    # pairs of near copies of such documents count as one of each pair
    stock = [words(draw, 8) for _ in range(40)]
    for _ in range(30):
        mine = words(draw, 9).split()
        for k in range(2):
            lines = [*stock, " ".join([*mine[: 3 + k], words(draw, 1), *mine[4 + k :]])]
            add("\n".join(lines), lines[-1])
    # near copies of one text, each with some other words, and copies of another
    text = [words(draw, 9).split() for _ in range(30)]
    for _ in range(60):
        lines = [list(x) for x in text]
        for _ in range(4):
            line = draw.choice(lines)
            line[draw.randrange(len(line))] = words(draw, 1)
        kept = "\n".join(" ".join(x) for x in lines)
        add(kept, kept)
    same = "\n".join(words(draw, 7) for _ in range(12))
    for _ in range(25):
        add(same, same)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(table).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, (len(wrong), wrong[:5], got[wrong[0]][:200], want[wrong[0]][:200])
