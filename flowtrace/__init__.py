"""flowtrace: fund-flow forensics on Spark DataFrames.

Layers:

* :mod:`flowtrace.functions` – column expressions (unit scaling, hex
  display, payload decoding, time windows, patterns);
* :mod:`flowtrace.operators` – ``DataFrame -> DataFrame`` operators
  (transfers, watchlists, ordered measures, bucket series, channels, flow
  graph, findings);
* :mod:`flowtrace.plans` – the incident dashboards as recipes, the
  registered queries over the test data, and their DuckDB oracles;
* :mod:`flowtrace.sources` – chain-table schemas, readers, writers and the
  driver-table bindings;
* :mod:`flowtrace.streaming` – the bucket series on an append-only stream.
"""

from .session import ensure_checkpoint_dir, get_session

__all__ = ["ensure_checkpoint_dir", "get_session"]
__version__ = "0.1.0"
