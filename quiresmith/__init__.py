"""quiresmith: a PySpark engine for analysing large collections of paginated documents."""
