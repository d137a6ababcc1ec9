"""Insert-only maintenance of a saturation from a stream of facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.fixpoint import Saturation, saturate, saturate_more
from ..plans.terms import Rule


class Maintained:
    """The latest saturation; each micro-batch of (subject, predicate, object) adds to it. A batch that is run again adds nothing."""

    def __init__(self, rules: Sequence[Rule], seed: DataFrame):
        self.rules, self.now = list(rules), saturate(rules, seed)

    def add(self, facts: DataFrame, batch_id: int = 0) -> Saturation:
        self.now = saturate_more(self.now, self.rules, facts)
        return self.now

    def follow(self, facts: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start maintaining from a streaming DataFrame of facts."""
        return facts.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()
