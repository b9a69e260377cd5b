"""Regular-expression search and analysis over text corpora, on PySpark."""
