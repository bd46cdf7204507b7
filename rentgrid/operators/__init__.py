"""rentgrid.operators."""
