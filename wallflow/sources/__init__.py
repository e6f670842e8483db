"""Readers: log CSVs, rule CSVs, name lists, and folder listings."""
