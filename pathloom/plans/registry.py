"""Named queries over the driver's tables and their SQL."""

from __future__ import annotations

from pathloom.plans import paths_and_shapes, reviews, schemas, uploads_over_time, vocabularies, workflows

QUERIES = {**paths_and_shapes.QUERIES, **schemas.QUERIES, **uploads_over_time.QUERIES, **vocabularies.QUERIES, **reviews.QUERIES, **workflows.QUERIES}
ORACLES = {**paths_and_shapes.ORACLES, **schemas.ORACLES, **uploads_over_time.ORACLES, **vocabularies.ORACLES, **reviews.ORACLES, **workflows.ORACLES}
