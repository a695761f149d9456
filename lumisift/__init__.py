"""Curation of large image-and-tag datasets as Spark DataFrame plans."""
