"""Part of the search engine; see the package docstring."""
