"""The pipeline on a small planted corpus: every stage takes effect and keeps clean documents."""

import random

import corpus_pipeline


def prose(seed, n, base="ka lo mi ne pu ra se ti vo zu".split()):
    draw = random.Random(seed)
    return " ".join(draw.choice(base) + draw.choice(base) + draw.choice(base) + draw.choice(base) for _ in range(n))


def test_stages_in_turn(spark, tmp_path):
    item, footer = prose(900, 30), "Copied from page {} of the archive by hand"
    clean = [(i, prose(i, 60) + "\n" + footer.format(i) + "\n" + prose(2000 + i, 40)) for i in range(200)]
    toxic = [(1000 + i, prose(3000 + i, 60) + " slur rotten vile slur") for i in range(60)]
    copies = [(2000 + i, clean[i][1]) for i in range(5)]
    leaks = [(3000 + i, prose(4000 + i, 50) + " " + item + " " + prose(5000 + i, 50)) for i in range(3)]
    rows = [(i, t, "en", "s", len(t)) for i, t in clean + toxic + copies + leaks] + [(9000, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000 + i, 1, 1) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe_encode"]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(200), 9000}
    assert all(r["round_trip"] for r in out.values()) and out[9000]["n_tokens"] == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cleaned = corpus_pipeline.drop_lines(spark, docs, str(tmp_path))
    assert cleaned.columns == docs.columns and cleaned.where("text LIKE '%archive%'").count() == 0


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").limit(0).write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").limit(0).write.parquet(str(folder / "benchmark.parquet"))


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[0] == "doc_id"


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    mine = "toxic string, p_toxic string, _hit string, _gone string, _ID string, ids string, component string"
    rows = [(i, t, None, None, None, *("mine",) * 7) for i, t in [(1, None), (2, ""), (3, prose(1, 50)), (3, prose(1, 50)), (None, prose(2, 50)), (4, prose(3, 9000))]]
    tables(spark, tmp_path, rows, f"{DOCS}, {mine}")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*(c.split()[0] for c in DOCS.split(", ")), *(c.split()[0] for c in mine.split(", "))]
    got = docs.collect()
    assert all(r["toxic"] == r["_ID"] == r["_hit"] == "mine" for r in got)
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "3", "4", "None"]  # 2 is empty as 1 is
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
