"""Training-data operators: one module per operator, queries in :mod:`riskloom.llm.catalog`."""
