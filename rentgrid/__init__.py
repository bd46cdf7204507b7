"""rentgrid: rental-listing analytics as Spark jobs.

Captured listing records -> one listing schema -> 37 derived columns from
text -> keyed state (upsert, price log, run log) -> filter, top-k, snapshot
merge and price statistics.  Everything runs as DataFrame plans.
"""

__version__ = "0.1.0"
