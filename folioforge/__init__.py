"""Document-record analytics on PySpark: sources, text functions, relational
operators, retrieval and streaming, all as DataFrame -> DataFrame functions."""
