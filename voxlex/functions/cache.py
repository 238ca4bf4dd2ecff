"""State that lives as long as a Python worker process.

Spark reuses Python workers across tasks, so per-worker caches (model
factorisations, token vectors) are built once per executor process instead
of once per task.  Entries are never shared across processes.
"""

from __future__ import annotations


def worker_cache(name: str) -> dict:
    import sys
    import types
    mod = "_voxlex_worker_cache"
    m = sys.modules.get(mod)
    if m is None:
        m = types.ModuleType(mod)
        m.stores = {}
        sys.modules[mod] = m
    return m.stores.setdefault(name, {})
