"""Operators of a training-data pipeline for text. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = ("conversations", "budget", "scans", "splitting", "encoding", "sentences", "packing", "leaks", "quality")


def query_modules() -> list:
    """Modules with QUERIES and SQL, for the entry point."""
    return [importlib.import_module(f"heddle.llm.{m}") for m in MODULES if importlib.util.find_spec(f"heddle.llm.{m}")]
