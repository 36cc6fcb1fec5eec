"""All queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import admin, curation, durable, index, listing, streams

QUERIES = {**listing.QUERIES, **curation.QUERIES, **streams.QUERIES, **admin.QUERIES, **durable.QUERIES, **index.QUERIES}
ORACLES = {**listing.ORACLES, **curation.ORACLES, **streams.ORACLES, **admin.ORACLES, **durable.ORACLES, **index.ORACLES}
