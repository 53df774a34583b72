"""Tests of millrace.llm; a package, so that files may be named as those beside it."""
