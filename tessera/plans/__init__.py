"""Graphs as DataFrames, how they are built, and the loop that iterative kernels run in."""
