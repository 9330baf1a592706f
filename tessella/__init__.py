"""Schema-aware text processing for Spark: render, extract, repair, validate, measure."""
