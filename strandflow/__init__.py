"""Distributed sequence dispatch, alignment and record merging on PySpark."""
