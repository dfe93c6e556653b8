"""Project functions, callable from expressions as ``tp:name(...)``.

Two kinds: functions of Columns (or vectorised UDFs) serve expressions compiled to Columns; plain functions of items and
nodes serve documents evaluated as trees. A later registration of a name replaces an earlier one.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import lru_cache

_FUNCTIONS: dict[str, Callable] = {}
_PLAIN: dict[str, Callable] = {}


def register(name: str | None = None):
    """Register a function of Columns."""

    def add(f: Callable) -> Callable:
        _FUNCTIONS[name or f.__name__.replace("_", "-")] = f
        return f

    return add


def sequence_types(*types: type):
    """Declare the types of a plain function's arguments and, last, of its result; arguments are converted to them."""

    def mark(f: Callable) -> Callable:
        f.types = types
        return f

    return mark


def register_plain(name: str | None = None):
    """Register a function of items: nodes, strings, numbers, truth values, or lists of them."""

    def add(f: Callable) -> Callable:
        types = getattr(f, "types", ())
        run = (lambda *args: f(*[convert(a, t) for a, t in zip(args, types, strict=False)])) if types else f
        for key in {name or f.__name__, (name or f.__name__).replace("_", "-")}:
            _PLAIN[key] = run
        return f

    return add


def convert(value: object, kind: type) -> object:
    """An argument as text, number or truth value; nodes pass where nodes are wanted."""
    from quillspark.tree.xpath import effective, number, text_of

    first = value[0] if isinstance(value, list) and value else value
    if kind is str:
        return "" if first is None else text_of(first)
    if kind in (int, float):
        return kind(number(first)) if first is not None else kind(0)
    return effective(value if isinstance(value, list) else [] if value is None else [value]) if kind is bool else value


def register_module(path: str, plain: bool = False) -> None:
    """Register every public callable of a module named by its dotted path."""
    module = importlib.import_module(path)
    for name in getattr(module, "__all__", [n for n in vars(module) if not n.startswith("_")]):
        if callable(f := getattr(module, name)):
            (register_plain(name) if plain else register(name.replace("_", "-")))(f)


@lru_cache(maxsize=256)
def resolve(path: str) -> Callable:
    """The callable at a dotted path, e.g. a chunk selector or a footnote order."""
    module, _, name = path.rpartition(".")
    found = getattr(importlib.import_module(module), name)
    if not callable(found):
        raise TypeError(f"{path} is not callable")
    return found


def lookup(name: str) -> Callable | None:
    return _FUNCTIONS.get(name)


def names() -> set[str]:
    return {*_FUNCTIONS, *_PLAIN}


def plain() -> dict[str, Callable]:
    """Functions for trees: those that come with the engine, and registered ones over them."""
    from quillspark.tree import library

    return library.FUNCTIONS | _PLAIN
