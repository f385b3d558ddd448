"""Registered queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from telarium.plans import decoding, detection, fleet, numeric

QUERIES = {**detection.QUERIES, **fleet.QUERIES, **numeric.QUERIES, **decoding.QUERIES}
ORACLE = {**detection.ORACLE, **fleet.ORACLE, **numeric.ORACLE, **decoding.ORACLE}
