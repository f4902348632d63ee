"""Scalar text and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ellipsis(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three of a longer text being dots."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def tokens(c: Column) -> Column:
    """Words and the white space between them, in order."""
    return F.regexp_extract_all(c, F.lit("(\\S+|\\s+)"), F.lit(1))


def chunk_count(length: Column, size: int = 6000, overlap: int = 800) -> Column:
    step = size - overlap
    return F.when(length == 0, 0).otherwise(F.greatest(F.ceil((length - size) / float(step)), F.lit(0)).cast("int") + 1)


def chunks(text: Column, size: int = 6000, overlap: int = 800) -> Column:
    """Overlapping slices as ``array<struct<chunk_no, chunk>>``; an empty text has none."""
    n = chunk_count(F.length(text), size, overlap)
    step = size - overlap
    one = lambda i: F.struct(i.alias("chunk_no"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<chunk_no:int,chunk:string>>"))


def sentences(text: Column) -> Column:
    """Split after ``. ! ?`` and at line breaks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+|\\n+"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r"))), lambda s: s != "")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def priority_bonus(name: Column) -> Column:
    """1.5 for phrases and for acronyms of two to six capitals."""
    return F.when((F.size(F.split(F.trim(name), "\\s+")) > 1) | name.rlike("^[A-Z]{2,6}$"), 1.5).otherwise(1.0)


def citation(style: Column, authors: Column, year: Column, title: Column, doi: Column) -> Column:
    """A formatted reference in APA, MLA, IEEE or a plain style."""
    n = F.size(authors)
    who = (
        F.when(F.coalesce(n, F.lit(0)) < 1, "Unknown Author")
        .when(n == 1, F.get(authors, F.lit(0)))
        .when(n == 2, F.concat(F.get(authors, F.lit(0)), F.lit(" & "), F.get(authors, F.lit(1))))
        .otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(", et al.")))
    )
    when = F.coalesce(year.cast("string"), F.lit("n.d."))
    link = F.concat(F.lit("https://doi.org/"), F.coalesce(F.trim(doi), F.lit("")))
    name = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "Untitled Paper").otherwise(F.trim(title))
    s = F.upper(style)
    return (
        F.when(s == "APA", F.concat(who, F.lit(". ("), when, F.lit("). "), name, F.lit(". "), link))
        .when(s == "MLA", F.concat(who, F.lit('. "'), name, F.lit('." '), link, F.lit(", "), when, F.lit(".")))
        .when(s == "IEEE", F.concat(who, F.lit(', "'), name, F.lit('," '), when, F.lit(". Available: "), link))
        .otherwise(F.concat(who, F.lit(". "), name, F.lit(" ("), when, F.lit(").")))
    )


def file_stem_title(filename: Column) -> Column:
    """A title from a file name: last extension dropped, ``_`` and ``-`` as spaces, words capitalised."""
    from .names import title_case

    stem = F.trim(F.translate(F.regexp_replace(filename, "\\.[^.]*$", ""), "_-", "  "))
    return F.when(stem == "", "Document Analysis").otherwise(title_case(stem))


def url_name(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1)


def progress(i: Column, n: Column) -> Column:
    """Percent done after chunk ``i`` (from 0) of ``n``."""
    return F.least(F.lit(90), (40 + (i + 1) * 50.0 / n).cast("int"))


def upload_state(status: Column, pct: Column) -> Column:
    return F.when(status.isin("done", "error"), status).when(pct < 40, "uploading").when(pct < 80, "extracting").when(pct < 100, "building").otherwise("done")


def node_radius(degree: Column) -> Column:
    return 3 + F.sqrt(degree) * 1.5


def iso(at: Column) -> Column:
    """A time as text, to the microsecond."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_now() -> Column:
    return iso(F.current_timestamp())


# Fixed values: (pattern in the text, pattern in the file name, topic, what it is), tried in order. Pass a longer table where one is at hand.
TOPICS = (
    (
        "attention|transformer", "attention is all you need", "Transformer Architecture",
        "A novel neural network architecture based solely on self-attention mechanisms, dispensing with recurrence and convolutions entirely.",
    ),
    (
        "voting|blockchain|zkp", "voting", "Secure Online Voting System",
        "A secure, transparent, and tamper-proof online voting system using Blockchain that eliminates central administrator trust.",
    ),
)


def main_topic(sample: Column, filename: Column, topics: tuple[tuple[str, str, str, str], ...] = TOPICS) -> Column:
    """Topic of a document by keywords of its first 15,000 characters and its file name; else a title from the file name."""
    text, name = F.lower(F.substring(sample, 1, 15000)), F.lower(filename)
    return F.coalesce(*[F.when(text.rlike(t) | name.rlike(n), topic) for t, n, topic, _ in topics], file_stem_title(filename))


def topic_description(sample: Column, filename: Column, topics: tuple[tuple[str, str, str, str], ...] = TOPICS) -> Column:
    """What ``main_topic`` is."""
    text, name = F.lower(F.substring(sample, 1, 15000)), F.lower(filename)
    other = F.concat(F.lit("Unified knowledge map and conceptual analysis of the document "), filename, F.lit("."))
    return F.coalesce(*[F.when(text.rlike(t) | name.rlike(n), about) for t, n, _, about in topics], other)


def repair_json(raw: Column, schema: str = "nodes array<struct<label:string,name:string,description:string>>, relationships array<struct<from:string,to:string,type:string>>") -> Column:
    """Model output with code fences around it, parsed; null where it is no JSON or lacks a part."""
    got = F.from_json(F.regexp_replace(F.trim(raw), "^```(?:json)?\\s*|\\s*```$", ""), schema)
    return F.when(got["nodes"].isNotNull() & got["relationships"].isNotNull(), got)
