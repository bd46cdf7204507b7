"""rentgrid.plans."""
