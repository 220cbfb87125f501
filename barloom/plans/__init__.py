"""Named queries over the tables of a folder, and SQL with the same results where SQL can express them."""

from barloom.plans import bars, features, models, scoring, trading

QUERIES: dict = {}
ORACLES: dict = {}
for part in (bars, features, scoring, trading, models):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
