"""quillgraph: a knowledge-graph analytics engine written in PySpark DataFrame algebra."""

__version__ = "0.1.0"
