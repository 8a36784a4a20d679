"""Importing the package registers every query."""

from tallymark.plans.queries import extras, ingest, lifecycle, matching, reports, streams  # noqa: F401
