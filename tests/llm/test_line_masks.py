"""Operator 7: masks, leaves and pieces of lines against plain Python."""

import random
import re

from pyspark.sql import functions as F

from flowlens.llm import line_templates as lt


def test_masks_and_pieces_against_python(spark):
    draw = random.Random(3)
    parts = ["a", "be", "7", "x9", "é", "я1", "мода", " ", " ", "  ", "\t", "\n", "\n", "\r", "the ", "one m", "<*>", "0"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = rows.select("id", lt.masks(F.col("text")).alias("masks"), F.split("text", lt.PIECES).alias("pieces")).collect()
    for r in got:
        lines = [" ".join("<*>" if re.search("[0-9]", w) else w for w in re.split(r"[ \t\x0b\f\r]+", line)).strip(" ") for line in texts[r["id"]].split("\n")]
        assert r["masks"] == lines
        assert r["pieces"] == re.split(r"\n|(?<=[eyaoдия]) (?=[a-mA-Mа-мА-М])", texts[r["id"]])
