"""The native operator runs no Python on the executors."""

import re

from weftgraph.llm import quality
from weftgraph.llm.runtime import table


def test_quality_is_native(spark, sf):
    docs = table(spark, sf, "documents")
    for df in (quality.text_stats(docs), quality.quality_rules(docs), quality.keep_good(docs)):
        assert not re.search(r"Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
