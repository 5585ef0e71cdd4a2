"""Registered queries: carriers wired to operators."""

from touchline.plans import markets, modeling, people, point_in_time, sources

ALL_QUERIES = {**point_in_time.QUERIES, **sources.QUERIES, **markets.QUERIES, **people.QUERIES, **modeling.QUERIES}
flagship = point_in_time.minimum_slice
