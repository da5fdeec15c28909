"""linepulse: production-line downtime analytics as Spark DataFrame operators.

Layout
------
- ``sources``   readers of the line tables (CSV layout of a line system, the
                canonical tables derived from the shared test tables, dirty
                variants, wide downtime matrices) and sinks.
- ``functions`` column expressions (shift rule, percentages, wrap-aware
                durations) and scale helpers (distributed dense index,
                split sequence windows, totals).
- ``operators`` DataFrame-in / DataFrame-out building blocks: profiling,
                cleaning, features, marts, metric families, ML, recommendations.
- ``plans``     the registered report queries (one key each) with their
                independent SQL formulation used as an oracle.
- ``streaming`` incremental (Structured Streaming) form of the downtime KPIs.
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
