"""Signature text -> parameter list (plain Python, no Spark).

Runs on executors inside ``mapInArrow``; kept free of Spark so it can be
unit-tested directly.
"""

from __future__ import annotations

import ast
import re
import warnings

# Parameter kind names, in declaration order.
POSITIONAL_ONLY = "POSITIONAL_ONLY"
POSITIONAL_OR_KEYWORD = "POSITIONAL_OR_KEYWORD"
VAR_POSITIONAL = "VAR_POSITIONAL"
KEYWORD_ONLY = "KEYWORD_ONLY"
VAR_KEYWORD = "VAR_KEYWORD"

_DEFINE = "def {}({}:\n    pass"


def _without_reprs(text: str) -> str:
    """Object reprs like ``<object at 0x..>``, nested ones included, become None."""
    out, opened = [], []
    for part in re.split("([<>])", text):
        if part == ">" and opened:
            del out[opened.pop():]
            part = "None"
        elif part == "<":
            opened.append(len(out))
        out.append(part)
    return "".join(out)


def normalise(signature: str) -> str | None:
    """Turn ``mod.f(a, b=1) -> int`` into ``def mod_f(a, b=1):\\n    pass``.

    What follows the last arrow is dropped. Returns None when there is no
    ``(`` at all.
    """
    shown = signature[:signature.rfind("->")] if "->" in signature else signature
    name, bracket, params = shown.strip().partition("(")
    if not bracket:
        return None
    name = name.strip().replace(".", "_").removeprefix("def ")
    return _without_reprs(_DEFINE.format(name, params.removesuffix(":")))


def parse_signature(signature: str | None, compat: bool = False):
    """Parameters of a signature as a list of dicts, or None if unparsable.

    Each dict: name, kind, pos (0-based), has_default, default_src.
    ``compat=True`` aligns defaults to positional-only and ordinary
    parameters separately (the historic form, which gives ``a`` in
    ``f(a, /, b=2)`` a default); the default aligns them jointly, as
    Python does.
    """
    if signature is None:
        return None
    text = normalise(signature)
    if text is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if not module.body or not isinstance(module.body[0], ast.FunctionDef):
        return None
    a = module.body[0].args
    if compat:
        given = [a.defaults, a.defaults]
    else:
        cut = max(len(a.defaults) - len(a.args), 0)
        given = [a.defaults[:cut], a.defaults[cut:]]
    # kind, its parameters, and defaults of its last ones
    table = [(POSITIONAL_ONLY, a.posonlyargs, given[0]),
             (POSITIONAL_OR_KEYWORD, a.args, given[1]),
             (VAR_POSITIONAL, [a.vararg] if a.vararg else [], []),
             (KEYWORD_ONLY, a.kwonlyargs, a.kw_defaults),
             (VAR_KEYWORD, [a.kwarg] if a.kwarg else [], [])]
    out = []
    for kind, args, defaults in table:
        padded = [None] * (len(args) - len(defaults)) + defaults
        for arg, default in zip(args, padded):
            out.append({"name": arg.arg, "kind": kind, "pos": len(out), "has_default": default is not None,
                        "default_src": None if default is None else ast.unparse(default)})
    return out
