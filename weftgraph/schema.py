"""Labels, relationship types and table schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and relationship types of the data model.
EXTRACTION_LABELS = ("Topic", "Subtopic", "Concept", "Technology", "Framework", "Application", "Paper", "Author", "Keyword", "Method", "Dataset")
UTILITY_LABELS = ("Document", "Note", "Highlight", "Citation")
UNIQUE_ID_LABELS = ("Concept", "Topic", "Keyword", "Paper", "Author", "Institution", "Note", "Highlight", "Citation", "User", "Document")
PRIMARY_LABEL_ORDER = ("Topic", "Subtopic", "Technology", "Framework", "Application", "Concept", "Paper", "Author", "Institution", "Keyword", "Method", "Dataset")
WRITABLE_EDGE_TYPES = (
    "PREREQUISITE_OF", "RELATED_TO", "EXTENDS", "CONTRADICTS", "USES", "USES_METHOD", "DEPENDS_ON",
    "CITES", "AUTHORED_BY", "AFFILIATED_WITH", "MENTIONS", "HAS_KEYWORD", "USED_FOR", "EVALUATED_ON",
)
EXPAND_TYPES = (
    "EXTENDS", "RELATED_TO", "USES", "CITES", "CONTAINS", "PREREQUISITE_OF",
    "USES_METHOD", "DEPENDS_ON", "AUTHORED_BY", "MENTIONS", "HAS_KEYWORD",
)
DIFFICULTIES = ("Beginner", "Intermediate", "Advanced")

NODES = (
    "id string, label string, labels array<string>, name string, title string, description string, difficulty_level string, "
    "doc_id string, session_id string, year int, doi string"
)
EDGES = "src string, dst string, type string, doc_id string, session_id string"


def primary_label(labels: Column, default: str = "Concept") -> Column:
    """The first of the ordered labels that a node has."""
    return F.coalesce(*[F.when(F.array_contains(labels, x), F.lit(x)) for x in PRIMARY_LABEL_ORDER], F.lit(default))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def display_name(name: Column, title: Column, default: str = "Unknown") -> Column:
    return F.coalesce(blank_to_null(name), blank_to_null(title), F.lit(default))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Violations of the uniqueness of ``id`` within a label; must be empty."""
    return nodes.where(F.col("label").isin(*UNIQUE_ID_LABELS)).groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")
