"""Queries over the library's operators, with SQL to hold them against; importing this registers all of them."""

from . import detection, events, features, legacy, pages, roundtrips, texts, walks
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "detection", "events", "features", "legacy", "pages", "roundtrips", "texts", "walks"]
