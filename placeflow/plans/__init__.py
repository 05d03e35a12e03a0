"""The library's queries, with an independent DuckDB query for each that SQL can express."""

from . import answers, extracting, flow, jobs, links, lists, near, payloads, places, stored
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "answers", "extracting", "flow", "jobs", "links", "lists", "near", "payloads", "places", "stored"]
