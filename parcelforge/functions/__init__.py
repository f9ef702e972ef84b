"""Scalar functions on Columns; Arrow UDFs only where no built-in exists."""
