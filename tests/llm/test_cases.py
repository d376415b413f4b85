"""Null, empty, long, tied, repeated and clashing inputs of every operator, and brute force where SQL has no words."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import ann, bpe, chat, decontamination, html_text, licenses, line_templates, passages, simhash, toxicity
from flowlens.llm.common import narrow_join, spread_join, unused
from flowlens.llm.license_texts import FILES, MIT, known
from flowlens.llm.queries import byte_bpe

VOCABULARY = [a + b + c for a in "ka lo mi ne pu ra".split() for b in "se ti vo zu".split() for c in ("", "n", "r", "st")]


def prose(seed, n):
    draw = random.Random(seed)
    return [draw.choice(VOCABULARY) + draw.choice(VOCABULARY) for _ in range(n)]


def docs(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


# Work columns of the operators, and output columns, in another case: none may hide or be hidden.
CLASH = ["_ID", "_Gone", "_HIT", "_WORDS", "_x", "_features", "P_TOXIC", "Toxic", "p_low_quality", "ROW", "hit", "gone", "key", "digest", "salt", "form", "License_ID", "lines", "H", "leaf", "place", "component", "FP", "n", "words", "rep", "CONTENT", "spans", "rank", "score", "query_id", "url", "ids", "decoded"]


def with_clashes(df):
    taken = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASH if c.lower() not in taken))


def labelled(spark):
    bad = ["slur", "rotten", "vile"]
    rows = [(i, " ".join(prose(i, 30) + ([bad[i % 3], bad[(i + 1) % 3]] if i % 4 == 0 else []))) for i in range(160)]
    return docs(spark, rows), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, quality int, toxic int")


def test_clashing_columns(spark):
    small, labels = labelled(spark)
    table = with_clashes(small)
    bench = with_clashes(spark.createDataFrame([(1, " ".join(prose(900, 20)))], "item_id bigint, text string"))
    mine = {c: f"mine {c}" for c in table.columns if c not in ("doc_id", "text")}

    def kept(df, replaced=()):
        row = df.where("doc_id = 1").first()
        values = dict(zip(df.columns, row, strict=True))
        for c, v in mine.items():
            if c.lower() not in replaced:
                assert values[c] == v, c

    kept(line_templates.drop_recurring(table))
    kept(decontamination.without_matches(table, bench))
    kept(simhash.keep_one(table))
    kept(licenses.scan(table), {"license_id"})
    kept(bpe.round_trip(table, byte_bpe()), {"ids", "decoded"})
    kept(toxicity.toxic(table, with_clashes(labels), rounds=3), {"p_toxic", "p_low_quality", "toxic"})
    assert toxicity.non_toxic(table, labels, rounds=3).columns == table.columns
    kept(toxicity.non_toxic(table, labels, rounds=3))
    assert passages.repeated_passages(table).count() == 0 and simhash.near_duplicates(table).count() == 160
    pages = with_clashes(spark.createDataFrame([(1, "u", "<article><p>a b</p></article>")], "page_id bigint, url string, html string"))
    assert html_text.main_text(pages).first()["text"] == "a b"
    turns = with_clashes(spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn int, role string, text string"))
    assert chat.format_conversations(turns).count() == 1
    vectors = with_clashes(spark.createDataFrame([(i, [1.0 + i, 2.0]) for i in range(3)], "vec_id bigint, embedding array<double>"))
    assert ann.search(vectors).count() == 2


def test_spread_join(spark):
    many = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(400)] + [(None, 5)], "k bigint, v bigint")
    one = spark.createDataFrame([(i, -i) for i in range(0, 300)], "k bigint, w bigint")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, many.join(one, "k", how).collect()))
        assert sorted(map(str, spread_join(many, one, "k", how, least=10).collect())) == want
        assert sorted(map(str, narrow_join(many, one, "k", how).collect())) == want
    assert unused(["A", "a_"], "a", "b") == ["a__", "b"]


# Operator 1


def test_bpe_long_and_null(spark):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(byte_bpe())
    draw = random.Random(2)
    texts = [None, "", "a" * 20_000, "".join(draw.choices("abcdefghij", k=5000)), " ".join(prose(1, 30_000)), "x", "x"]
    rows = bpe.round_trip(docs(spark, list(enumerate(texts))), byte_bpe()).collect()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == theirs.encode(text, add_special_tokens=False).ids and r["decoded"] == text
    v = bpe.Vocabulary(open(byte_bpe(), encoding="utf-8").read())
    before = bpe.MEMO
    bpe.MEMO = 2000  # tables are emptied again and again
    try:
        for k in range(20):
            some = [" ".join(prose(k, 40))]
            assert v.encode_all(some)[0] == theirs.encode(some[0]).ids
    finally:
        bpe.MEMO = before


# Operator 2


def exact_neighbours(x, ids, q, k):
    s = x @ x[q]
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))
    return [ids[i] for i in order[:k]]


@pytest.mark.parametrize("n", [1, 15, 25])
def test_small_tables_give_all(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 6))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: exact_neighbours(x, list(range(n)), q, 20) for q in range(0, n, 20) if n > 1}


def test_doubles_and_repeated_ids(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [0.17, 1.0]), (3, [-1e300, 1e300]), (0, [1.0, 1.0]), (5, None), (6, [float("inf"), 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0])]
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 1e300), (0, 2, 1.17), (0, 20, 1.0)] and [g[:2] for g in got[3:]] == [(20, 0), (20, 1), (20, 0)] or [g[1] for g in got[3:]] == [0, 1, 0]
    small = ann.search(spark.createDataFrame([(0, [1.0]), (1, [0.17])], "vec_id bigint, embedding array<double>")).first()
    assert small["score"] == 0.17


def test_recall_and_pruning(spark):
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((80, 24)) * 3
    clustered = centres[draw.integers(0, 80, 4000)] + 0.2 * draw.standard_normal((4000, 24))
    random_ = draw.standard_normal((1500, 24))
    for x, most in ((clustered, 0.1), (random_, 1.0)):
        df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id bigint, embedding array<double>")
        centres_ = [ann.kmeans(x[:, :12], 16), ann.kmeans(x[:, 12:], 16)]
        assert ann.share_needed(x, centres_, 12, 12, 20, 0.96, 128) <= most
        got = {}
        for r in ann.search(df).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert set(got) == set(range(0, len(x), 20)) and all(len(v) == 20 for v in got.values())
        recall = [len(got[q] & set(exact_neighbours(x, list(range(len(x))), q, 20))) / 20 for q in list(got)[:60]]
        assert np.mean(recall) >= 0.9


# Operator 3


def brute_matches(texts, items, full=0.8, part=0.6, answer=8, short=8):
    out = set()
    for d, t in texts:
        words = decontamination.words_of(t or "")
        for i, q in items:
            target = decontamination.words_of(q or "")
            if not target:
                continue
            width = 3 * max(16, len(target))
            for s in range(0, max(1, len(words)), 8):
                region = words[s : s + width]
                share = decontamination.common_subsequence(target, region) / len(target)
                if share >= part and (len(target) >= short or decontamination._runs(target, region)):
                    last = target[-answer:]
                    if share >= full or decontamination.common_subsequence(last, region) == len(last):
                        out.add((d, i))
    return out


def test_decontamination_against_full_comparison(spark):
    draw = random.Random(8)
    common = prose(1, 40)  # a few words that most texts use, as stop words are
    mixed = lambda seed, n: [draw.choice(common) if draw.random() < 0.5 else w for w in prose(seed, n)]
    items = [(i, " ".join(mixed(500 + i, n))) for i, n in enumerate((3, 9, 15, 20, 30, 45, 64, 90, 150))] + [(90, None), (91, "?!"), (92, " ".join(mixed(503, 20)))]
    texts = [(i, " ".join(mixed(1000 + i, 150))) for i in range(60)] + [(600, None), (601, ""), (602, " ".join(mixed(77, 6000)))]
    for k, (i, q) in enumerate(items[:9] * 4):
        words = q.split()
        places = draw.sample(range(max(0, len(words) - 8)), int(0.19 * len(words)) if len(words) > 10 else 0)
        for p in places:
            words[p] = f"changed{draw.randrange(99)}"
        texts.append((100 + k, " ".join(mixed(2000 + k, draw.randrange(0, 90)) + words + mixed(3000 + k, draw.randrange(0, 90)))))
    texts.append((100, texts[-1][1]))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs(spark, texts + [(None, items[4][1])]), bench).collect()}
    want = brute_matches(texts, items)
    planted = {(100 + k, i) for k, (i, _) in enumerate(items[:9] * 4)}
    assert planted <= got and (None, 4) in got
    assert len(want & got) >= 0.98 * len(want) and all(w in want or w[0] in (None, 100) or w in planted for w in got)


# Operator 4


def test_published_licences(spark):
    title = "The MIT License (MIT)\n\nCopyright (c) 2021 Some Body\n\n"
    bsd = next(t for i, t in known() if i == "BSD-3-Clause")
    rows = [(1, title + MIT), (2, (FILES / "Apache-2.0.txt").read_text()), (3, (FILES / "GPL-3.0.txt").read_text().replace("\n", "\r\n")), (4, (FILES / "GPL-2.0.txt").read_text().split("END OF TERMS")[0])]
    rows += [(5, "BSD 3-Clause License\n\nCopyright (c) 2019, Example Project\nAll rights reserved.\n\n" + bsd.replace("the copyright holder nor", "the Example Project nor").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))]
    rows += [(6, "Some words. " + MIT), (7, "ISC License\n\n" + next(t for i, t in known() if i == "ISC")), (8, (FILES / "MPL-2.0.txt").read_text()), (9, "x " * 50_000), (10, None)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "GPL-3.0", 4: "GPL-2.0", 5: "BSD-3-Clause", 6: None, 7: "ISC", 8: "MPL-2.0", 9: None, 10: None}


# Operator 5


def test_passages_behind_quotes(spark):
    shared = prose(1, 120)
    rows = [(i, " ".join(prose(100 + i, 80) + shared[(s := random.Random(i).randrange(75)) : s + 45] + prose(300 + i, 60))) for i in range(76)]
    fuzzy = [w if i % 7 else "zz" for i, w in enumerate(shared)]
    rows += [(500, " ".join(prose(900, 50) + shared + prose(901, 60))), (600, " ".join(prose(902, 90) + shared)), (700, " ".join(prose(904, 90) + fuzzy + prose(905, 10)))]
    out = passages.repeated_passages(docs(spark, rows)).collect()
    spans = {(r["doc_id"], r["start_word"], r["end_word"]) for r in out}
    assert {r["doc_id"] for r in out} == {500, 600, 700} and {(500, 50, 170), (600, 90, 210)} <= spans


@pytest.mark.parametrize("identity", [0.8, 0.85, 0.9, 0.95, 1.0])
def test_passage_recall_by_identity(spark, identity):
    draw = random.Random(int(identity * 100))
    rows, planted = [(i, prose(i, 150)) for i in range(260)], []
    for k in range(120):
        n = draw.choice((50, 60, 80, 120, 200))
        a = prose(5000 + k, n)
        b = list(a)
        for i in draw.sample(range(n), int(n * (1 - identity) + 1e-9)):
            b[i] = f"changed{draw.randrange(5000)}"
        planted.append((1000 + 2 * k, 1001 + 2 * k))
        rows += [(1000 + 2 * k, prose(7000 + k, draw.randrange(5, 60)) + a + prose(8000 + k, 40)), (1001 + 2 * k, prose(9000 + k, 30) + b + prose(9500 + k, draw.randrange(5, 60)))]
    out = passages.repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    found = {(r["doc_id"], r["partner_id"]) for r in out}
    assert sum(p in found for p in planted) >= 0.9 * len(planted)
    assert all(r["identity"] >= 0.8 for r in out) and not {r["doc_id"] for r in out} & set(range(260))


def test_passage_edge_cases(spark):
    text = " ".join(prose(5, 90))
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, text + " one more"), (5, "short"), (6, " ".join(["the"] * 300)), (7, " ".join(["the"] * 200)), (8, " ".join(prose(6, 60_000))), (None, text)]
    got = {r["doc_id"] for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == {1, 2, 5, 6, 7}
    assert passages.repeated_passages(docs(spark, [])).count() == 0


def test_alignment_against_dynamic_programme():
    draw = random.Random(3)
    for _ in range(300):
        a, b = (np.array([draw.randrange(5) for _ in range(draw.randint(0, 40))]) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (a[i] == b[j]))
        assert passages.common_words(a, b) == table[-1, -1]
        if len(a) and len(b):
            s, t, n = passages._reach(a, b)
            assert n == table[s, t]
    h = np.array([draw.randrange(1000) for _ in range(200)], np.uint64)
    for width in (1, 2, 5, 47, 300):
        assert passages.least_ahead(h, width).tolist() == [min(h[i : i + width].tolist()) for i in range(200)]


# Operator 6


def test_chat_query_against_brute_force(spark):
    draw = random.Random(9)
    parts = ["\\", "###", "</turn>", "\n", "word", ":", "### user:\n", "é", "\U0001f600", ""]
    said = "\\### Assistant: </turn> ok"
    turns = {-7: [("user", said), ("assistant", said)], 1: [("user", None), ("assistant", "")], 2: [("assistant", "same"), ("assistant", "same")]}
    for c in range(3, 40):
        turns[c] = [(draw.choice(["user", "assistant", "system"]), "".join(draw.choices(parts, k=draw.randint(0, 7)))) for _ in range(draw.randint(1, 60))]
    rows = [(c, i, r, t) for c, ts in turns.items() for i, (r, t) in enumerate(ts)]
    draw.shuffle(rows)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    for c, ts in turns.items():
        whole = "".join(f"{r}\n{t or ''}\n" for r, t in ts)
        loss = "".join(t or "" for r, t in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_long_conversations():
    draw = random.Random(2)
    turns = [(draw.choice(["user", "assistant"]), " ".join(prose(i, 8))) for i in range(10_000)]
    text, spans, rewrites = chat.render(turns)
    assert text == chat.marked_turns(turns) and not rewrites and len(spans) == 10_000
    assert all(chat.unescape(text[s[3] : s[4]]) == t for s, (_, t) in zip(spans, turns, strict=True))
    for n in (1, 31, 32, 33, 65, 130):
        assert chat.render(turns[:n]) == chat.by_prefixes(turns[:n], chat.marked_turns)


def test_templates_that_depend_on_history():
    turns = [("user", f"t{i}") for i in range(100)]
    head = lambda ts: "".join(f"{'first' if i == 0 else 'next'} {t}\n" for i, (_, t) in enumerate(ts))
    late = lambda ts: "".join(f"{t}\n" for _, t in (ts if len(ts) < 70 else ts[1:]))
    counted = lambda ts: "".join(f"{i} {t}\n" for i, (_, t) in enumerate(ts))
    for template in (head, late, counted):
        assert chat.render(turns, template) == chat.by_prefixes(turns, template)
    assert chat.render(turns, late)[2] == [69]


# Operator 7


def test_boilerplate_only_documents(spark):
    one = [(i, f"Page {i} of the archive printed on demand") for i in range(40)]
    two = [(100 + i, f"Page {i} of the archive printed on demand\nCopy number {i} for the reading room only") for i in range(40)]
    same = [(200 + i, "A single text that many rows repeat word for word") for i in range(40)]
    out = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(docs(spark, one + two + same)).collect()}
    assert all(out[i] == "" for i, _ in one + two) and all(out[i] == t for i, t in same)


def brute_templates(rows, min_docs=10, constant=0.6, depth=3):
    """Drop recurring lines of texts that are no copies of each other, with plain dictionaries."""
    mask = lambda line: [("<*>" if re.search("[0-9]", w) else w) for w in line.split()]
    lines = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if m := tuple(mask(line)):
                lines.setdefault((len(m), m[:depth]), {}).setdefault(m, set()).add(i)
    gone = set()
    for members in lines.values():
        held = {}
        for m, ds in members.items():
            for p, w in enumerate(m):
                if w != "<*>":
                    held[p, w] = held.get((p, w), 0) + len(ds)
        groups = {}
        for m, ds in members.items():
            level, most = min_docs, max([held[p, w] for p, w in enumerate(m) if w != "<*>"], default=0)
            while level <= max(most, min_docs):
                t = tuple(w if w != "<*>" and held[p, w] >= level else "<*>" for p, w in enumerate(m))
                if sum(w != "<*>" for w in t) >= constant * len(t):
                    groups.setdefault((level, t), []).append((m, ds))
                level *= line_templates.LADDER
        for found in groups.values():
            if len(set().union(*(ds for _, ds in found))) >= min_docs:
                gone.update(m for m, _ in found)
    return {i: t if t is None else "\n".join(x for x in t.split("\n") if tuple(mask(x)) not in gone) for i, t in rows}


def test_line_templates_against_brute_force(spark):
    draw = random.Random(6)
    stock = [" ".join(prose(70 + k, draw.randint(2, 9))) for k in range(30)]
    rows = []
    for i in range(150):
        lines = [" ".join(prose(i, 25)), " ".join(prose(4000 + i, 12))]
        for _ in range(draw.randint(0, 4)):
            w = draw.choice(stock).split()
            if draw.random() < 0.5:
                w[draw.randrange(len(w))] = draw.choice([str(draw.randrange(999)), draw.choice(VOCABULARY)])
            lines.append(draw.choice(["", "  ", "\t"]) + "  ".join(w))
        draw.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n \n")]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(docs(spark, rows)).collect()}
    assert got == brute_templates(rows)


# Operator 8

STORY = '<div class="nav-bar"><a href="/x">Home page</a></div><div class="zq-teaser">Buy one now and get another one for free today only</div>{}<div class="zq-teaser">More offers from partners that you may like to see</div>'


def test_weights_decide_without_semantic_tags(spark):
    body = lambda i, tag: f'<{tag} class="story-body"><h1>{" ".join(prose(i, 5))}</h1><p>{" ".join(prose(50 + i, 40))}</p><div class="zq-teaser">Inner offer for readers</div><p>{" ".join(prose(90 + i, 30))}</p></{tag}>'
    train = [(i, "u", "<body>" + STORY.format(body(i, "article"))) for i in range(30)]
    test = [(100 + i, "u", "<body>" + STORY.format(body(100 + i, "div"))) for i in range(10)]
    table = spark.createDataFrame(train + test, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(table).collect()}
    for i in range(100, 110):
        assert got[i] == "\n".join([" ".join(prose(i, 5)), " ".join(prose(50 + i, 40)), " ".join(prose(90 + i, 30))])
    assert any(html_text.extract(h, {}) != got[i] for i, _, h in test)  # without weights they cannot be told


def test_article_parts_are_kept():
    page = "<article><header><h1>Title here</h1></header><p>one two three</p><h2 class='entry-header'>Sub</h2><div class='market-share'>x y</div><div class='side-note'>note</div><ul><li class='ad'>spam<li>real one<li>real two</ul><dl><dt>term<dd>meaning</dl><table><tr><td>c1<td>c2<tr><td>c3</table><footer>by me</footer><p>last</p></article><footer>f</footer>"
    assert html_text.extract(page, {}) == "Title here\none two three\nSub\nx y\nnote\nreal one\nreal two\nterm\nmeaning\nc1\nc2\nc3\nlast"
    assert html_text.extract("<article>" + "<p>word</p>" * 20_000 + "</article>", {}).count("\n") == 19_999
    for broken in ("<p", "<article><p>a<", "</p></div>", "<!-- x", "<a href='", "&#0;&bogus;"):
        html_text.extract(broken, {})


def test_repeated_pages(spark):
    rows = [(1, None, "<main>a <b>b</b></main>"), (1, None, "<main>a <b>b</b></main>"), (None, "u", None)]
    got = sorted((str(r["page_id"]), r["text"]) for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert got == [("1", "a b"), ("1", "a b"), ("None", "")]


# Operator 9


def test_simhash_null_ids_and_hot_prints(spark):
    rows = [(i, "same words in all of these") for i in range(50)] + [(None, "same words in all of these"), (99, None), (98, "")]
    got = [(r["id"], r["component"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()]
    assert len(got) == 53 and {c for i, c in got if i in (98, 99)} == {98} and {c for i, c in got if i not in (98, 99)} == {0}


# Operator 10


def test_toxicity_edges(spark):
    table, labels = labelled(spark)
    extra = docs(spark, [(900, None), (901, ""), (902, "!!"), (903, "slur " * 30_000), (0, "clean words"), (None, "slur vile rotten")])
    scored = toxicity.toxic(table.union(extra), labels, rounds=12)
    got = {r["doc_id"]: r["toxic"] for r in scored.where("doc_id >= 900").collect()}
    assert got == {900: False, 901: False, 902: False, 903: True} and scored.count() == 166
    held = {r["doc_id"]: r["toxic"] for r in scored.where("doc_id BETWEEN 120 AND 159").collect()}
    assert sum(held[i] == (i % 4 == 0) for i in held) >= 38
    assert toxicity.non_toxic(table.limit(0), labels).count() == 0
