"""The registered queries, by theme."""

from . import aggregates, files, postcall, relational, requirements, segments, stores, streams, texts  # noqa: F401
