"""larder: franchise and supply-chain analytics on Spark DataFrames.

Layout
------
``sources``    typed scans, fixture tables derived from the driver parquet, sinks
``functions``  shared column expressions (exact decimal ratios, bands, month arithmetic)
``operators``  distributed building blocks, the ten reports, the stock jobs, the data rules
``streaming``  Structured Streaming forms of the row-event jobs
``plans``      the registry of named jobs and their SQL oracle
"""

from larder.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
