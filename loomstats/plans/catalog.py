"""All catalog queries with their checking SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "events_catalog", "sessions_catalog", "logs_catalog", "usage_catalog", "chats_catalog", "streams_catalog",
    "readers_catalog", "reports_catalog",
]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"{__package__}.{name}"), attribute))
    return merged


def _in_utc(query):
    """The same query with the session time zone the operators expect."""

    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _in_utc(query) for name, query in _merged("QUERIES").items()}


def oracles() -> dict:
    return _merged("ORACLES")
