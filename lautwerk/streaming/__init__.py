"""Decisions over a stream of heard names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.decide import hydrate
from ..operators.lexicon import Lexicon


def hydrate_stream(heard: DataFrame, lexicon: Lexicon, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs ``hydrate`` on each micro-batch of a stream; every row stands alone, so no state is kept."""

    def decide(batch: DataFrame, number: int) -> None:
        sink(hydrate(batch, lexicon), number)

    return heard.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(**trigger).start()
