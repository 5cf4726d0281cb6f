"""Readers, writers and the fixture views derived from the driver tables."""

from .io import (  # noqa: F401
    Dataset, load_features, load_table, read_table, save_features, save_metrics_table,
)
