"""Progress: stages of an analysis in bands of one scale, and what jobs report of themselves.

``Bands`` maps each stage's own progress to the whole's. ``watched`` counts the rows of a step as they are made, by
``observe``, and tells a listener when its action is done; ``StreamProgress`` tells one after each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Listener = Callable[[str, float], None]

# Where stages begin and end on the whole's scale, with words to transcribe and without.
WITH_WORDS = {"analysis": (0.0, 0.5), "transcription": (0.5, 0.95), "title": (0.95, 1.0)}
WITHOUT_WORDS = {"analysis": (0.0, 1.0)}


class Bands:
    """Progress of the whole from a stage's own, which never goes back."""

    def __init__(self, listener: Listener, with_words: bool = True):
        self.listener, self.bands, self.at = listener, WITH_WORDS if with_words else WITHOUT_WORDS, 0.0

    def tell(self, stage: str, part: float) -> float:
        low, high = self.bands[stage]
        self.at = max(self.at, low + (high - low) * min(max(part, 0.0), 1.0))
        self.listener(stage, self.at)
        return self.at


def watched(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows`` with their number observed as ``n_rows``, at no pass of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


def tell_when_done(seen: Observation, expected: int, bands: Bands, stage: str) -> float:
    """After an action on watched rows: the stage's share of the rows expected."""
    return bands.tell(stage, seen.get["n_rows"] / max(expected, 1))


class StreamProgress(StreamingQueryListener):
    """Tells the rows of every micro-batch and that a query has ended."""

    def __init__(self, tell: Callable[[str, int], None]):
        self.tell, self.rows = tell, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.tell("batch", self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell("end", self.rows)
