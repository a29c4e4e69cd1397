"""weftgraph: property-graph analytics as Spark DataFrame operators."""

from weftgraph.operators.graph import PropertyGraph

__all__ = ["PropertyGraph"]
