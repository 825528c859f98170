"""pageflow: bilingual web-text processing on PySpark."""
