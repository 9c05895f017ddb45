"""Entity co-occurrence networks on Spark: mentions, pair statistics, graphs, reports and their text front ends."""
