"""Shapes of physical plans: pruned and filtered scans, no Python where built-ins do, bounded joins."""

import re

import pytest

from weftgraph import catalog
from weftgraph.plans import ingest
from weftgraph.sources.derived import derived_graph
from weftgraph.storage import table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark, sf):
    text = plan(derived_graph(spark, sf).edges.groupBy("type").count())
    line = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_orderkey" in s]
    assert line and all("l_shipdate" not in s and "l_tax" not in s for s in line)
    assert "CartesianProduct" not in text


def test_filters_reach_the_scan(spark, sf):
    text = plan(table(spark, sf, "conversations").where("conv_id = 3").select("text"))
    assert "PushedFilters: [IsNotNull(conv_id), EqualTo(conv_id,3)]" in text


PYTHON_FREE = [
    "kg_edges_by_type", "document_subgraph", "session_subgraph", "context_buckets", "degree", "chunks", "capitalized_phrases", "tfidf", "rank_top80", "entity_quality",
    "header_footer_templates", "unique_word_ratio", "citation_format", "note_concept_links", "numbered_runs", "upsert_nodes", "delete_document_cascade", "chunk_concepts",
]


@pytest.mark.parametrize("name", PYTHON_FREE)
def test_no_python_and_no_cross_joins(spark, sf, name):
    text = plan(catalog.queries()[name](spark, sf))
    assert not re.search(r"Python|Pandas|Arrow", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_chunking_is_one_pass(spark, sf):
    assert "Exchange" not in plan(ingest.chunk_rows(table(spark, sf, "documents")))
