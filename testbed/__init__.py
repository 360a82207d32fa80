"""Test bed: document corpora and landing drops rendered from the driver tables.

Not part of the engine: only the query catalog (``tidewater.plans``) and the tests use it.
"""
