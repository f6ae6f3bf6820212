"""quotemill: evaluation of retrieval-augmented question answering, and training-data preparation, as Spark plans."""

__version__ = "0.1.0"
