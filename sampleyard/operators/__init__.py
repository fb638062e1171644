"""DataFrame operators: catalog reads and writes, collections, freshness, scans, recognisers."""
