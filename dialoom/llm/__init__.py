"""Training-data operators: corpus cleaning, mixing, tokenising and packing on Spark."""
