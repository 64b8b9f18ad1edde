"""Readers of workbooks, layouts of delimited files, and JSON shapes."""
