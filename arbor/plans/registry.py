"""All registered queries and their oracle texts."""

from __future__ import annotations

from arbor.plans import crawl, groups, hr, listings, oracle_crawl, oracle_hr, oracle_listings, quality, relations

QUERIES = {}
ORACLE = {}

QUERIES.update(hr.QUERIES)
ORACLE.update(oracle_hr.ORACLE)
QUERIES.update(listings.QUERIES)
ORACLE.update(oracle_listings.ORACLE)
QUERIES.update(crawl.QUERIES)
QUERIES.update(quality.QUERIES)
ORACLE.update(oracle_crawl.ORACLE)
QUERIES.update(relations.QUERIES)
ORACLE.update(relations.ORACLE)
QUERIES.update(groups.QUERIES)
ORACLE.update(groups.ORACLE)
