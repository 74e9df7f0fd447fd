"""Every operator as a query over the driver tables, most of them with reference SQL."""

from importlib import import_module

MODULES = ["text", "urls", "radar", "changes", "listings", "dedupe", "health", "triage", "enrichment", "pages"]


def _load():
    for module in MODULES:
        import_module(f"listing_radar.queries.{module}_queries")
    from listing_radar.queries.registry import ORACLE, QUERIES

    return QUERIES, ORACLE


def queries():
    return dict(_load()[0])


def oracle_sql():
    return dict(_load()[1])
