"""fathomgraph: co-occurrence graphs, impact labels and text annotation tables on Spark."""

__version__ = "0.1.0"
