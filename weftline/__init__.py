"""weftline: typed dependency-graph analytics expressed as Spark plans."""
