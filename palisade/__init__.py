"""palisade: security-log analytics as Spark DataFrame jobs."""

from palisade.options import Options, Scores, SourceOptions

__all__ = ["Options", "Scores", "SourceOptions"]
