"""All registered queries of the engine's own operators."""

from gapline.plans import ingest, reports, rules, streaming, text, upsert, vectors  # noqa: F401
