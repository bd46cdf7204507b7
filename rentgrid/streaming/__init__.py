"""rentgrid.streaming."""
