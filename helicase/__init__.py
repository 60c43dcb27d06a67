"""Analytics over data held as base strands, written as Spark DataFrame plans."""
