"""Streaming: continuous ingest of exports arriving in a landing folder."""
