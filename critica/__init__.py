"""Review mining on Spark: DataFrame operators for routing, clustering, summarising and ranking app reviews."""
