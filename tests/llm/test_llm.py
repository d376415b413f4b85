"""The text and vector operators against brute force, exact round trips, planted cases and edge cases."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import ann, bpe, chat, decontamination, html_text, licenses, line_templates, passages, simhash, toxicity
from flowlens.llm.graph import connected_components
from flowlens.llm.license_texts import MIT
from flowlens.llm.queries import byte_bpe

BYTE_BPE = byte_bpe()

DOCS = "doc_id bigint, text string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(seed, n, base="ka lo mi ne pu ra se ti vo zu".split()):
    draw = random.Random(seed)
    return [draw.choice(base) + draw.choice(base) + draw.choice(base) + draw.choice(base) for _ in range(n)]


def test_bpe_matches_library():
    from tokenizers import Tokenizer

    with open(BYTE_BPE, encoding="utf-8") as f:
        mine = bpe.Vocabulary(f.read())
    theirs = Tokenizer.from_file(BYTE_BPE)
    draw = random.Random(1)
    letters = ["a", "B", "é", "中", "\U0001f600", " ", "  ", "\t", "\n", "\r", "\x1c", "\x85", " ", "​", "'", "'s", "'re", "1", "²", "<|endoftext|>", "<|", "_", "﻿", "́", "ſ", "\x00", "the", "ing"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 14))) for _ in range(5000)] + ["ab" * 400, "é" * 300, "".join(draw.choices("abcde", k=700)), ""]
    found = mine.encode_all(texts)
    assert found == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert [mine.decode(i) for i in found] == [theirs.decode(i, skip_special_tokens=False) for i in found] == texts


def test_bpe_columns(spark):
    rows = spark.createDataFrame([(1, None, "x", 5), (2, "héllo the", "y", 6), (2, "héllo the", "y", 6)], "doc_id bigint, text string, ids string, extra int")
    out = bpe.round_trip(rows, BYTE_BPE).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == ["", "héllo the", "héllo the"] and out[0]["ids"] == [] and out[0]["extra"] == 5
    assert bpe.decode(bpe.encode(rows.drop("ids"), BYTE_BPE), BYTE_BPE).where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.round_trip(rows.limit(0), BYTE_BPE).count() == 0


def slow_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_all_pairs(spark):
    draw = random.Random(3)
    texts = [" ".join(prose(i, draw.randint(1, 80))) for i in range(40)]
    for i in range(60):
        words = texts[draw.randrange(10)].split()
        words[draw.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " \t\n", texts[0], "A b C d", "a B c D"]
    rows = docs(spark, list(enumerate(texts)))
    fp = [slow_fingerprint(t or "") for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for block in (2048, 3):
        got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.digest_columns(simhash.near_duplicates(rows, block=block)).collect()}
        assert got == {i: (fp[i], root(i)) for i in range(len(texts))}
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
    kept = simhash.keep_one(rows.withColumn("id", F.lit("clash")))
    assert kept.columns == ["doc_id", "text", "id"] and kept.count() == len({root(i) for i in range(len(texts))})


def test_covering_masks_cover():
    masks, draw = simhash.covering_masks(64, 4), random.Random(0)
    for _ in range(3000):
        flips = sum(1 << b for b in draw.sample(range(64), 4))
        assert any(m & flips == 0 for m in masks)


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_ann_exact_and_recall(spark):
    draw = np.random.default_rng(0)
    x = draw.standard_normal((600, 16)).astype(np.float32)
    x[300:330] = x[5]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, 2.0]), (1004, [None] + [1.0] * 15), (1020, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    best = {}
    for q in range(0, 600, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        best[q] = [int(i) for i in np.lexsort((np.arange(600), -np.round(s, 10)))[:5]]

    def found(**settings):
        out = {}
        for r in ann.search(df, k=5, centroids=6, **settings).orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["vec_id"])
            assert r["score"] == pytest.approx(float(x[r["query_id"]].astype(float) @ x[r["vec_id"]].astype(float)))
        return out

    assert found(share=1.0, block=100) == best
    some = found()
    assert sum(len(set(some[q]) & set(best[q])) for q in best) / (5 * len(best)) >= 0.9
    assert ann.search(df.limit(0)).count() == 0


def test_license_scan(spark):
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + MIT.upper().replace(",", " ;")), (2, "MIT License text"), (3, None), (4, "!!"), (5, MIT.replace("sublicense", "sub-licence")), (5, MIT)]
    got = [(r["doc_id"], r["license_id"]) for r in licenses.scan(docs(spark, rows).withColumn("license_id", F.lit("clash"))).orderBy("doc_id").collect()]
    assert got == [(1, "MIT"), (2, None), (3, None), (4, None), (5, "MIT"), (5, "MIT")]
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0


def test_license_sql(spark, tmp_path):
    import duckdb

    rows = docs(spark, [(1, "Copyright © 2020 X\n" + MIT), (2, "Fav'our\tthe LICENCE — whilst…"), (3, None)])
    rows.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    theirs = sorted(con.execute(licenses.oracle()).fetchall())
    mine = sorted(tuple(r) for r in licenses.scan(rows).select("doc_id", "canonical_chars", "canonical_sha256", "license_id").collect())
    assert mine == theirs


def test_chat_round_trip_and_rewrites(spark):
    draw = random.Random(5)
    parts = ["\\", "###", "</turn>", "\n", "a", ":", "### user:\n", "\\###"]
    for _ in range(300):
        turns = [("".join(draw.choices(["user", "assistant", ":", "\\", "\n"], k=2)), "".join(draw.choices(parts, k=draw.randint(0, 6)))) for _ in range(draw.randint(1, 4))]
        text, spans, rewrites = chat.render(turns)
        assert chat.read_turns(text) == turns and not rewrites
        assert [chat.unescape(text[s[3] : s[4]]) for s in spans] == [t for _, t in turns]
    latest = lambda turns: "".join(f"<{r}>" for r, _ in turns[-1:]) + "".join(t for _, t in turns)
    assert chat.render([("a", "x"), ("b", "y")], latest)[2] == [1]
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "hi"), (None, 0, None, "x"), (2, 0, "assistant", "### ok")], "conv_id bigint, turn bigint, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(rows.withColumn("spans", F.lit(1)))).collect()}
    assert out[1]["n_turns"] == 2 and out[1]["loss_chars"] == 0 and out[2]["loss_chars"] == 6 and out[None]["n_turns"] == 1
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_line_templates(spark):
    rows = [(i, "\n".join([" ".join(prose(i, 12)), f"Page {i} of 99 printed on demand today", " ".join(prose(1000 + i, 9))])) for i in range(30)]
    copies = [(100 + i, rows[0][1].split("\n")[0]) for i in range(30)]
    table = docs(spark, rows + copies + [(500, None), (501, ""), (502, "\n\n")]).withColumn("lines", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(table).collect()}
    assert all("Page" not in got[i] and got[i].count("\n") == 1 for i in range(30))
    assert got[100] == copies[0][1] and got[500] is None and got[501] == "" and got[502] == "\n\n"
    assert line_templates.drop_recurring(table).columns == table.columns
    assert line_templates.drop_recurring(table.limit(0)).count() == 0


def test_line_templates_count_documents(spark):
    draw = random.Random(3)
    logs = [(i, "\n".join(line for j in range(20) for line in (f"user {draw.randrange(10**6)} logged in from {draw.randrange(256)} today", f"job {draw.randrange(10**6)} ended after {draw.randrange(10**4)} seconds"))) for i in range(30)]
    base = [prose(4000 + i, 50) for i in range(20)]
    copies = []
    for i in range(1000):  # each copy has one edit among the first words of some line
        lines = [list(x) for x in base]
        lines[draw.randrange(20)][draw.randrange(3)] = f"edit{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"
        copies.append((1000 + i, "\n".join(map(" ".join, lines))))
    one = [(5000, "\n".join(f"this line is held by one document only {i}" for i in range(40)))]
    table = docs(spark, logs + copies + one)
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(table).collect()}
    assert all(got[i] == "" for i in range(30))
    assert all(got[i] == t for i, t in copies + one)


def test_line_templates_at_two_sizes(spark):
    names, places = prose(81, 60), prose(82, 40)
    for n in (400, 8000):  # 60 x 40 combinations; each name and place is in over 10 of the larger number of documents
        draw = random.Random(n)
        rows = [(i, "\n".join([" ".join(prose(i, 8)), f"Article posted online today by {draw.choice(names)} in {draw.choice(places)}", " ".join(prose(20000 + i, 9))])) for i in range(n)]
        out = line_templates.drop_recurring(docs(spark, rows)).select("text").collect()
        assert sum("posted" in r["text"] for r in out) == 0 and all(r["text"].count("\n") == 1 for r in out)


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="ad">Buy now and here</div>{}<aside>Related things to see</aside><form>Sign up now</form><footer>&copy; site words in footer</footer>'


def test_main_text(spark):
    body = "<article><h1>Head &amp; line</h1><p><b>First   one<br>two</p><div class=\"advert\">Spam spam</div><p>Second\n text &lt;x&gt;</p><section class='comments'><p>nice!</p></section></article>"
    train = [(i, "u", PAGE.format(f"<article><h1>{' '.join(prose(i, 5))}</h1><p>{' '.join(prose(i, 40))}</p></article>")) for i in range(20)]
    table = spark.createDataFrame(train + [(100, "u", PAGE.format(body)), (101, None, None), (102, "u", ""), (103, "u", "<p")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(table).collect()}
    assert got[100] == "Head & line\nFirst one two\nSecond text <x>"
    assert got[101] == got[102] == "" and got[0] == " ".join(prose(0, 5)) + "\n" + " ".join(prose(0, 40))
    assert html_text.main_text(table.limit(0)).count() == 0


def test_passages(spark):
    shared = prose(7, 80)
    fuzzy = shared.copy()
    for i in (11, 29, 47, 66):
        fuzzy[i] = "edited"
    rows = [(i, " ".join(prose(100 + i, 150))) for i in range(12)]
    rows += [(20, " ".join(prose(200, 60) + shared + prose(201, 30))), (21, " ".join(prose(202, 10) + fuzzy + prose(203, 90)).upper())]
    rows += [(30, rows[3][1]), (31, rows[3][1]), (40, None), (41, ""), (42, "few words only"), (43, " ".join(["same"] * 500)), (30, rows[3][1])]
    out = passages.repeated_passages(docs(spark, rows)).collect()
    spans = {(r["doc_id"], r["partner_id"]): (r["start_word"], r["end_word"]) for r in out}
    assert {r["doc_id"] for r in out} == {20, 21, 3, 30, 31}
    a, b = spans[21, 20]
    assert abs(a - 10) <= 2 and abs(b - 90) <= 2 and spans[30, 3] == (0, 150)
    assert passages.repeated_passages(docs(spark, rows).limit(0)).count() == 0


def test_chain_prefers_collinear_matches():
    found = passages.segments(np.array([0, 20, 40, 60]), np.array([5, 25, 500, 65]), 8)
    assert [s[:3] for s in passages.chains(found, 8)[0]] == [(0, 8, 5), (20, 28, 5), (60, 68, 5)]


def test_common_subsequence():
    draw = random.Random(0)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(a, b) == table[-1][-1]


def test_decontamination(spark):
    items = [(i, " ".join(prose(500 + i, 14 + 4 * i))) for i in range(10)] + [(90, None), (91, "")]
    rows = [(i, " ".join(prose(i, 200))) for i in range(40)]
    planted = {}
    for i in range(10):
        words = items[i][1].split()
        if i % 2:
            words[2] = "other"  # a paraphrase that keeps the answer
        rows.append((100 + i, " ".join(prose(300 + i, 37 + i) + words + prose(400 + i, 80)).title()))
        planted[100 + i] = i
    table = docs(spark, rows + [(200, None), (201, ""), (100, rows[-10][1])])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(table, bench).collect()}
    assert got == set(planted.items())
    assert {r["doc_id"] for r in decontamination.without_matches(table, bench).collect()} == {*range(40), 200, 201}
    assert decontamination.matches(table.limit(0), bench).count() == 0 and decontamination.matches(table, bench.limit(0)).count() == 0


def test_toxicity(spark):
    bad = ["slur", "rotten", "vile"]
    rows = [(i, " ".join(prose(i, 40) + ([bad[i % 3], bad[(i + 1) % 3]] if i % 4 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(10**6, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    table = docs(spark, rows + [(900, None), (901, "")]).withColumn("toxic", F.lit("clash"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxic(table, labels, rounds=12).collect()}
    held = range(300, 400)
    assert sum(got[i] == (i % 4 == 0) for i in held) >= 98 and not got[900] and not got[901]
    assert toxicity.toxic(table, labels.limit(0)).where("toxic").count() == 0
