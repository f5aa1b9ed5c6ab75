"""What an answer says about itself: its coverage, and apart from that whether it was cut or ran out of time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Reasons for gaps, in the order in which answers list them.
REASONS = (
    "missing_dependency", "cfg_unknown", "macro_unavailable", "indirect_target_unknown", "external_boundary",
    "unsupported_construct", "budget_exhausted", "analysis_failed", "artifact_mismatch", "syntax_only",
)


@dataclass
class Envelope:
    """coverage: complete, partial, failed or unavailable. An empty complete answer says that there is nothing."""

    coverage: str = "complete"
    reasons: list[tuple[str, int]] = field(default_factory=list)
    truncated: bool = False
    deadline: bool = False


def bounded(df: DataFrame, limit: int) -> tuple[DataFrame, Envelope]:
    """At most ``limit`` rows of an ordered result, and whether more were there."""
    more = df.limit(limit + 1).count() > limit
    return df.limit(limit), Envelope(truncated=more)


def of_unknowns(counts: DataFrame) -> Envelope:
    """The envelope of (reason, n) rows; there are as many as reasons at most."""
    rank = {r: i for i, r in enumerate(REASONS)}
    found = sorted(((r.reason, r.n) for r in counts.collect()), key=lambda x: (rank.get(x[0], len(rank)), x[0]))
    return Envelope("partial" if found else "complete", found)
