"""Points, queries, ground truth and results, from tables and from text; and the sinks that write them."""
