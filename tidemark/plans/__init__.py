"""Registered queries, grouped by subject."""

import importlib
import os

_MODULES = ("research", "daily", "risk", "intraday", "patterns", "defined", "matching", "holdings", "reported", "corpus", "newsroom", "streams")


def load():
    here = os.path.dirname(__file__)
    for m in _MODULES:
        if os.path.exists(os.path.join(here, f"{m}.py")):
            importlib.import_module(f"tidemark.plans.{m}")
    return importlib.import_module("tidemark.plans.registry")
