"""The registered queries on the reference's operators, with their SQL."""

from __future__ import annotations

from plumage.plans import box_queries, detector_queries, log_queries, misc_queries, node_queries, region_queries, rule_queries, scene_queries, text_queries

PARTS = [box_queries, text_queries, log_queries, misc_queries, node_queries, rule_queries, region_queries, scene_queries, detector_queries]
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in PARTS for k, v in part.ORACLES.items()}
