"""lexmill: byte-level BPE vocabularies over DataFrames, built and applied with Spark."""
