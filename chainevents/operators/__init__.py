"""DataFrame operators: matching, decoding, coverage, projection, queries."""
