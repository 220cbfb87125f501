"""Reading, building, caching and checking bars."""
