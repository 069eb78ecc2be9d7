"""Operators: DataFrame in, DataFrame out. Every window has a total order; nothing is collected."""
