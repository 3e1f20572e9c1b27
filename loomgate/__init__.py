"""loomgate: file formats in, ordered rows, file formats out, on Apache Spark."""
