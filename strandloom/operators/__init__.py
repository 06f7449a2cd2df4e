"""Operators: DataFrame to DataFrame, without collecting rows."""
