"""Parts that are chosen by name: tests of independence, models."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module


def named(name: str, known: dict[str, Callable]) -> Callable:
    """One of the known by its name, or ``module:attribute`` of any module that the executors have; a class is made into an object, which must
    be callable."""
    if name in known:
        return known[name]
    module, _, attribute = name.partition(":")
    if not attribute:
        raise KeyError(f"'{name}' is none of {', '.join(sorted(known))}, nor module:attribute")
    found = getattr(import_module(module), attribute)
    return found() if isinstance(found, type) else found
