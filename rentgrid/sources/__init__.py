"""rentgrid.sources."""
