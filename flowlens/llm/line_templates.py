"""Operator 7: line dedup with a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where a
token that holds a digit counts as a variable field. Lines of one leaf are generalised at rising levels of
support: at a level a token stays that so many documents have at its place, any other becomes a wildcard. The
levels go by factors of LADDER from ``min_docs`` to the most frequent token of the line, so that one of them
lies between the values of a variable field and the words around it at any size of the corpus. A line
is boilerplate if at some level its template has enough constant places and recurs across ``min_docs``
documents; it is dropped everywhere.

Documents are counted by content: equal texts count once, and near copies count as one document with the texts
that they are linked to. For that a text is cut into pieces where a letter of SPLIT_AFTER ends a word and at
line ends, and the four least hashes of its pieces are its sketch. Texts whose sketches share three hashes are
linked (texts of fewer than four pieces: only with the same pieces), and the components of these links count
as one, except for texts with lines of their own. A line is common to a component if half its texts, or ``min_docs``
of them, hold it; another line is a text's own if most of its pairs of successive words occur in no common line. Texts
with at least OWN new pairs in such lines count by their own line, all others of the component as one. So a group of
near copies does not lose its text, as an edited line keeps most pairs of the line that it was, while documents that are
boilerplate but for a line or two count each. So do unrelated documents, which share a few lines only, even if templates
are all that they hold. A document counts once for a template, however many of its lines have it.

Each text is masked once. Hashes are counted and shuffled, with partial aggregation before each shuffle; masks
are read again for the lines of frequent leaves, texts are shuffled once, when lines are dropped. Leaves and lines to look
for are counted and, up to a million, broadcast; other joins deal crowded keys to several tasks.

Defined results: null text stays null, an empty text stays empty; blank lines are kept. Rows that repeat an id
keep their own lines. A document may lose all its lines and stays as an empty text. All columns and
their order are kept, whatever their names; n_chars too, as it tells of the input. An empty table gives an
empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import materialise, narrow_join, spread_join, unused
from flowlens.llm.graph import connected_components

WILD = "<*>"
#: Factor between the levels of support at which lines are generalised.
LADDER = 4
#: A token that holds a digit, without a second look at tokens that hold none.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"
#: Last letters of words after which a text is cut for its sketch, where a letter of A-M follows.
SPLIT_AFTER = "eyaoдия"
PIECES = rf"[ \n](?:(?<=[{SPLIT_AFTER}] )(?=[a-mA-Mа-мА-М])|(?<=\n))"
#: White space that is not a single blank between words: what must occur for ``masks`` to rewrite spaces.
ODD_SPACE = ("  ", "\t", "\x0b", "\f", "\r")
SKETCH = 4
#: New word pairs, with those at the ends of a line, that make a text differ from its near copies.
OWN = 4


def masks(text: Column) -> Column:
    """Each line of the text with single spaces and each token that holds a digit as a wildcard."""
    odd = reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in ODD_SPACE))
    spaced = F.when(odd, F.regexp_replace(text, r"[^\S\n]{2,}|[^\S\n ]", " ")).otherwise(text)
    # few lines of a text hold a digit; tokens do not reach over line ends
    whole = lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, VARIABLE, WILD)).otherwise(x)
    return F.transform(F.split(spaced, "\n"), lambda x: F.trim(whole(x)))


def leaf(mask: Column, depth: int) -> Column:
    """Hash of the path in the tree: the token count and the first ``depth`` tokens."""
    count = F.octet_length(mask) - F.octet_length(F.replace(mask, F.lit(" ")))
    return F.xxhash64(count, F.substring_index(mask, " ", depth))


def sketch(text: Column) -> Column:
    """Keys of a text that near copies share: hashes of all but one of its SKETCH least pieces."""
    pieces = F.transform(F.filter(F.split(text, PIECES), lambda p: p != ""), lambda p: F.xxhash64(p))
    least = F.slice(F.sort_array(F.array_distinct(pieces)), 1, SKETCH)
    but = lambda xs: F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda i: F.xxhash64(F.filter(xs, lambda _, j: j != i)))
    return F.element_at(F.transform(F.array(least), lambda xs: F.when(F.size(xs) < SKETCH, F.array(F.xxhash64(xs))).otherwise(but(xs))), 1)


def prepared(df: DataFrame, id_col: str, text: str, depth: int) -> DataFrame:
    """(id, digest, keys, lines): of each text its hash, the keys of its sketch, and its lines as (leaf, h, mask)."""
    said = F.col(f"`{text}`")
    lines = F.transform(masks(said), lambda m: F.when(m != "", F.struct(leaf(m, depth).alias("leaf"), F.xxhash64(m).alias("h"), m.alias("mask"))))
    rows = df.where(said.isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(said).alias("digest"), sketch(said).alias("keys"), lines.alias("lines"))
    return materialise(rows, "lines")


def contents(rows: DataFrame) -> DataFrame:
    """(digest, content): the texts that are linked to others, with one of the texts for all."""
    keys = materialise(rows.select("digest", F.explode("keys").alias("key")).distinct(), "keys")
    shared = keys.groupBy("key").agg(F.min("digest").alias("u"), F.count("*").alias("n")).where("n > 1").select("key", "u")
    links = spread_join(keys, materialise(shared, "shared"), "key").select("u", F.col("digest").alias("v"))
    return connected_components(links, "links").select(F.col("node").alias("digest"), F.col("component").alias("content"))


def word_pairs(mask: Column) -> Column:
    """Hashes of the pairs of successive words of a line, its two ends included, once each."""
    words = F.split(F.concat(F.lit(" "), mask, F.lit(" ")), " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b)))


def masks_of(rows: DataFrame, often: DataFrame, parts: DataFrame) -> DataFrame:
    """(h, mask) of the lines of frequent leaves and of linked texts, in one pass over the lines."""
    lines = rows.select("digest", F.explode("lines").alias("x")).where("x IS NOT NULL").select("digest", "x.leaf", "x.h", "x.mask")
    lines = narrow_join(lines, often.withColumn("often", F.lit(True)), "leaf", "left")
    lines = narrow_join(lines, parts.select("digest", F.lit(True).alias("linked")), "digest", "left")
    return materialise(lines.where("often OR linked").groupBy("h").agg(F.min("mask").alias("mask")), "masks")


def own_contents(words: DataFrame, spots: DataFrame, parts: DataFrame, min_docs: int) -> DataFrame:
    """``parts`` with another content for texts that hold lines of their own: the component and the least such line.

    ``spots``: (digest, h) of every line, once for each text; ``words``: (h, mask) of linked texts at least.
    """
    held = materialise(narrow_join(spots.select("digest", "h"), parts, "digest"), "held")
    sizes = materialise(parts.groupBy("content").agg(F.count("*").alias("texts")), "sizes")
    lines = materialise(held.groupBy("content", "h").agg(F.count("*").alias("n")), "lines")
    common = (F.col("n") > 1) & (F.col("n") >= F.least(F.lit(min_docs), F.ceil(F.col("texts") / 2)))
    lines = narrow_join(lines, sizes, "content").select("content", "h", common.alias("common"))
    said = materialise(spread_join(materialise(lines, "lines"), words, "h").select("content", "h", "common", word_pairs(F.col("mask")).alias("pairs")), "pairs")
    known = materialise(said.where("common").select("content", F.explode("pairs").alias("pair")).distinct().withColumn("seen", F.lit(1)), "known")
    rest = materialise(said.where("NOT common").select("content", "h", F.explode("pairs").alias("pair")), "rest")
    new = spread_join(rest, known, ["content", "pair"], "left").groupBy("content", "h").agg(F.sum(F.when(F.col("seen").isNull(), 1).otherwise(0)).alias("new"), F.count("*").alias("all"))
    new = materialise(new.where("2 * new > all").select("content", "h", "new"), "new")
    own = spread_join(held, new, ["content", "h"]).groupBy("digest").agg(F.sum("new").alias("new"), F.min("h").alias("least")).where(F.col("new") >= OWN)
    return parts.join(own, "digest", "left").select("digest", F.when(F.col("least").isNull(), F.col("content")).otherwise(F.xxhash64("content", "least")).alias("content"))


def templates(rows: DataFrame, min_docs: int = 10, constant: float = 0.6) -> DataFrame:
    """(h, leaf, template, docs): masks, by hash, of lines with a template that is boilerplate, once for each.

    ``rows`` are those of ``prepared``.
    """
    spots = rows.select("digest", F.explode("lines").alias("x")).where("x IS NOT NULL").select("digest", "x.leaf", "x.h").distinct()
    spots = materialise(spots, "spots")
    often = materialise(spots.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    parts = materialise(contents(rows), "contents")
    words = masks_of(rows, often, parts)
    parts = materialise(own_contents(words, spots, parts, min_docs), "contents", done=(parts,))
    named = materialise(narrow_join(spots, often, "leaf", "left_semi"), "frequent", done=(spots,))
    named = named.join(parts, "digest", "left").select(F.coalesce("content", "digest").alias("content"), "leaf", "h").distinct()
    spots = materialise(named, "spots")
    counted = materialise(spots.groupBy("leaf", "h").agg(F.count("*").alias("docs")), "counted")
    held = counted.groupBy("leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    counted = materialise(spread_join(counted, held, "leaf", "left_semi"), "counted", done=(counted,))
    wanted = materialise(counted.select("h").distinct(), "wanted")
    words = materialise(narrow_join(words, wanted, "h", "left_semi"), "words", done=(words,))
    tokens = spread_join(counted, words, "h").select("leaf", "h", "docs", F.posexplode(F.split("mask", " ")).alias("place", "token"))
    tokens = materialise(tokens, "tokens")
    place = ["leaf", "place", "token"]
    support = materialise(tokens.groupBy(*place).agg(F.sum("docs").alias("held")), "support")
    joined = spread_join(tokens.where(F.col("token") != WILD), support, place)
    joined = joined.unionByName(tokens.where(F.col("token") == WILD).withColumn("held", F.lit(0).cast("bigint")))
    lines = joined.groupBy("leaf", "h").agg(F.max("held").alias("most"), F.array_sort(F.collect_list(F.struct("place", "token", "held"))).alias("tokens"))
    steps = F.floor(F.log(F.greatest(F.col("most"), F.lit(min_docs)) / min_docs) / F.log(F.lit(LADDER)) + 1e-9).cast("int")
    lines = lines.select("leaf", "h", "tokens", F.explode(F.sequence(F.lit(0), steps)).alias("step"))
    needed = lines.select("*", (min_docs * F.pow(F.lit(LADDER), "step")).alias("needed"))
    stays = F.transform("tokens", lambda t: F.when((t["held"] >= F.col("needed")), t["token"]).otherwise(WILD))
    general = needed.select("leaf", "h", "step", stays.alias("kept"))
    fixed = F.size(F.filter("kept", lambda t: t != WILD))
    general = general.where(fixed >= constant * F.size("kept")).select("leaf", "h", F.xxhash64("leaf", "step", "kept").alias("template"))
    general = materialise(general, "general", done=(tokens, support))
    holders = spread_join(spots, general.groupBy("leaf", "h").agg(F.collect_list("template").alias("ts")), ["leaf", "h"])  # one for each level
    holders = holders.select("content", F.explode("ts").alias("template")).distinct()
    recurring = materialise(holders.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "recurring")
    return spread_join(general, recurring, "template").select("h", "leaf", "template", F.col("n").alias("docs"))


def drop_recurring(df: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = 3, min_docs: int = 10, constant: float = 0.6) -> DataFrame:
    """``df`` with the lines of recurring templates taken out of ``text``."""
    rows = prepared(df, id_col, text, depth)
    boilerplate = materialise(templates(rows, min_docs, constant).select("h").distinct(), "boilerplate")
    key, digest, gone = unused(df.columns, "key", "digest", "gone")
    spots = rows.select("id", "digest", F.posexplode("lines").alias("place", "x")).select("id", "digest", "place", "x.h")
    spots = spots.where("h IS NOT NULL")
    dropped = narrow_join(spots, boilerplate, "h", "left_semi").groupBy(F.col("id").alias(key), F.col("digest").alias(digest)).agg(F.collect_set("place").alias(gone))  # at most a text's lines
    said = F.col(f"`{text}`")
    joined = df.join(dropped, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(said) == F.col(digest)), "left")
    kept = F.filter(F.split(said, "\n"), lambda _, i: ~F.array_contains(gone, i))
    changed = F.when(F.col(gone).isNull(), said).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(changed.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))


def line_counts(after: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lines_kept, text_sha256) of the cleaned texts."""
    lines = F.size(F.split(F.col(text), "\n"))
    return after.select(F.col(id_col).alias("doc_id"), F.when(F.col(text).isNull() | (F.col(text) == ""), 0).otherwise(lines).cast("bigint").alias("lines_kept"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"))
