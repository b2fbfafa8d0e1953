"""Scalar functions as Spark expressions: text with other languages' rules, lenient JSON, score bands, USFM."""
