"""Column expressions: tokenising, postings codecs, co-occurrence, geometry."""
