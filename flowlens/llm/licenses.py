"""Operator 4: licence scan by canonical digest lookup.

A text is brought to a canonical form: copyright lines and the marks of lists go, case and punctuation are
levelled, equivalent spellings become one, white space collapses, a title before the terms goes, and the names that
some licences leave room for become those of the published text. The SHA-256 of the whole form is joined to
the digests of known licences, brought to the same form. Everything is built-in functions; the only
shuffle-free join is against the catalogue, broadcast after a check of its row count (above
``BROADCAST_ROWS`` Catalyst chooses the join).

Defined results: null text counts as empty and, like a text of punctuation only, has the empty form
and no licence. Of known texts with one digest the smallest name counts. Repeated rows give repeated
rows. Columns of ``df`` pass through; those named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import unused
from flowlens.llm.license_texts import known as known_texts

BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that state a copyright, or that all rights are reserved; a sentence on copyright notices stays.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;%-]*((copyright[ \t:]*)?(\(c\)|©|&copy;)|copyright[ \t:]*[0-9<\[{]|all rights reserved\.?[ \t]*$)[^\n]*$"
#: What is no letter or digit: ASCII by code, and the quotes, dashes and spaces of typesetting.
MARKS = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f ©«»‐-‧　]+"
LIST_MARK = r"(?m)^[ \t]*([0-9]{1,2}[.)]|[(]?[a-z][)]|[*•-])[ \t]+"
#: Spellings that count as equal: pattern, replacement.
SPELLINGS = (
    (r"\blicenc(e|es|ed|ing|ee|ees|or|ors)\b", "licens{1}"),
    (r"\b(organ|author|real|recogn|util|maxim|minim|optim|initial|categor|capital|emphas|custom)is(e|ed|es|er|ing|ation|ations)\b", "{1}iz{2}"),
    (r"\b(fav|lab|behavi|col|hon)our", "{1}or"),
    (r"\b(acknowledg|judg)ement", "{1}ment"),
    (r"\bwhilst\b", "while"),
    (r"\b(non|sub) (commercial|infringement|licens)", "{1}{2}"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bhttps\b", "http"),
)
#: Titles and named slots of the canonical form: pattern, replacement.
SLOTS = (
    (r"^(the )?(mit|expat|isc|zlib|x11|unlicense|bsd|new bsd|modified bsd|simplified bsd|revised bsd|zero clause bsd|bsd zero clause|bsd [0-4] clause|[0-4] clause bsd) license( mit| isc| zlib| bsd| [0-4] clause)? ", ""),
    (r"neither the name of .{1,200}? nor the names of (its|the|their) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"is provided by .{1,120}? as is and any express", "is provided by the copyright holders and contributors as is and any express"),
    (r"in no event shall .{1,120}? be liable for any direct indirect", "in no event shall the copyright holder or contributors be liable for any direct indirect"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text column."""
    c = F.translate(F.coalesce(text, F.lit("")), UPPER + "\r", LOWER + "\n")
    c = F.regexp_replace(F.regexp_replace(c, COPYRIGHT_LINE, " "), LIST_MARK, " ")
    c = F.trim(F.regexp_replace(c, MARKS, " "))
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    for pattern, to in SLOTS:
        c = F.regexp_replace(c, pattern, to)
    return c


def canonical_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sql = f"translate(coalesce({text}, ''), '{UPPER}' || chr(13), '{LOWER}' || chr(10))"
    sql = f"regexp_replace(regexp_replace({sql}, {quoted(COPYRIGHT_LINE)}, ' ', 'g'), {quoted(LIST_MARK)}, ' ', 'g')"
    sql = f"trim(regexp_replace({sql}, {quoted(MARKS)}, ' ', 'g'))"
    for pattern, to in SPELLINGS:
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
    for pattern, to in SLOTS:
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return sql


def catalogue(spark) -> DataFrame:
    """(license_id, text) of the bundled licences."""
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def scan(df: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Add canonical_chars, canonical_sha256 and license_id (null: none known) to each row."""
    known = catalogue(df.sparkSession) if known is None else known
    digests = known.select("license_id", canonical(F.col("text")).alias("form")).where("form <> '' AND license_id IS NOT NULL")
    digests = digests.groupBy(F.sha2("form", 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    kept = [c for c in df.columns if c.lower() not in ("canonical_chars", "canonical_sha256", "license_id")]
    (form,) = unused(kept, "form")
    rows = df.select(*(F.col(f"`{c}`") for c in kept), canonical(F.col(f"`{text}`")).alias(form))
    rows = rows.select(*(F.col(f"`{c}`") for c in kept), F.length(form).cast("bigint").alias("canonical_chars"), F.sha2(form, 256).alias("canonical_sha256"))
    return rows.join(digests, "canonical_sha256", "left")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for (doc_id, canonical_chars, canonical_sha256, license_id) of a table."""
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known_texts())
    return (
        f"WITH known(license_id, text) AS (VALUES {values}), "
        f"forms AS (SELECT license_id, {canonical_sql('text')} AS form FROM known), "
        "digests AS (SELECT sha256(form) AS canonical_sha256, min(license_id) AS license_id FROM forms WHERE form <> '' GROUP BY 1), "
        f"rows AS (SELECT doc_id, {canonical_sql('text')} AS form FROM {table}) "
        "SELECT doc_id, CAST(length(form) AS BIGINT) AS canonical_chars, sha256(form) AS canonical_sha256, license_id "
        "FROM rows LEFT JOIN digests ON digests.canonical_sha256 = sha256(form)"
    )
