"""rentgrid.functions."""
