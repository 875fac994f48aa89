"""Operators over artifact relations: DataFrame in, DataFrame out."""
