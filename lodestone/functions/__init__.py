"""Part of the retrieval analytics engine."""
