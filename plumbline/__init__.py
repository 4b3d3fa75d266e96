"""Curation of labelled text corpora and evaluation of linear probes, on Spark DataFrames."""
