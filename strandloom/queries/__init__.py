"""The queries of the catalog, by family of operators."""
