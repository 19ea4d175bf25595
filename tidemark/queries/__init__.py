"""Registered queries: name -> (Spark query, oracle SQL or None)."""

from tidemark.queries import evaluation, pipelines, squads, temporal

REGISTRY = {**temporal.QUERIES, **evaluation.QUERIES, **squads.QUERIES, **pipelines.QUERIES}
