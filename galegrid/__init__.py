"""Gridded storm analytics on Spark DataFrames.

Sub-packages:

* ``sources``    relations read from parquet (image grids, tracks, masks) and layer sinks
* ``functions``  scalar column functions (angles, axes, geometry, masks of offsets)
* ``operators``  DataFrame -> DataFrame operators (stencils, joins, aggregates, clusters)
* ``plans``      named queries built from the operators, with their SQL equivalents
* ``streaming``  the stateful tracker, as a batch fold and as a streaming query
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
