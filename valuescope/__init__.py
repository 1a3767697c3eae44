"""valuescope — player-value (LTV) analytics as Spark jobs.

Every public job is ``(spark, sf_dir, **params) -> DataFrame``; nothing is
collected except bounded helper values (quantile edges, one-row cutoffs).
"""

__all__ = ["session", "catalog"]
