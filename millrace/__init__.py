"""millrace: corpus diagnostics, retrieval analytics and data-quality operators as Spark plans."""
