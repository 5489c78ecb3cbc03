"""Public API catalog of one library source file (plain Python, no Spark).

Source text stands in for live reflection: a module's public functions
and its classes' public methods (plus ``__init__`` and ``__call__``),
each with an inspect-style signature text and a cleaned docstring.
"""

from __future__ import annotations

import ast
import re
import warnings

KEEP_DUNDER = ("__init__", "__call__")
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def module_of(path: str) -> str:
    """'pkg/sub/mod.py' -> 'pkg.sub.mod'; 'pkg/__init__.py' -> 'pkg'."""
    p = path[:-4] if path.endswith(".pyi") else path[:-3] if path.endswith(".py") else path
    parts = [x for x in p.replace("\\", "/").split("/") if x]
    if parts and parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts)


def _param(arg, default):
    text = arg.arg
    if arg.annotation is not None:
        text += ": " + ast.unparse(arg.annotation)
    if default is not None:
        text += (" = " if arg.annotation is not None else "=") + ast.unparse(default)
    return text


def signature_text(fn) -> str:
    """``(a, b=1, *, k=2) -> int`` in the layout ``inspect.signature`` prints."""
    a = fn.args
    positional = a.posonlyargs + a.args
    defaults = [None] * (len(positional) - len(a.defaults)) + list(a.defaults)
    out = []
    for i, arg in enumerate(positional):
        out.append(_param(arg, defaults[i]))
        if a.posonlyargs and i == len(a.posonlyargs) - 1:
            out.append("/")
    if a.vararg is not None:
        out.append("*" + _param(a.vararg, None))
    elif a.kwonlyargs:
        out.append("*")
    for arg, d in zip(a.kwonlyargs, a.kw_defaults):
        out.append(_param(arg, d))
    if a.kwarg is not None:
        out.append("**" + _param(a.kwarg, None))
    text = "(" + ", ".join(out) + ")"
    if fn.returns is not None:
        text += " -> " + ast.unparse(fn.returns)
    return text


# Longer texts are parsed piece by piece: a tree takes many times its text's size.
PIECE_CHARS = 1 << 20
# A line that can only begin a statement of the module, if no bracket or string is open.
_BEGINS = re.compile(r"\n(?=(?:def|class|async def) |@)")


def _parse(text: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def _pieces(text: str):
    """(begin, end, tree) of pieces of a module, which are the statements of the whole.

    A piece ends before a def, a class or a decorator at the line's start. Where one
    that begins a statement parses by itself, no bracket, string or continued line
    is open at its end, so the next one begins a statement too. One that
    doesn't parse is taken twice as long, at last with all that is left.
    """
    begin = 0
    # this name of the future changes how what follows is read
    whole = "barry_as_FLUFL" in text
    while begin < len(text):
        want = PIECE_CHARS
        while True:
            cut = None if whole else _BEGINS.search(text, begin + want)
            end = len(text) if cut is None else cut.start() + 1
            try:
                tree = _parse(text[begin:end])
                break
            except (SyntaxError, MemoryError):
                if end == len(text):
                    raise
                want *= 2
        yield begin, end, tree
        begin = end


def _bases(node, mod: str, local_classes: set, names: dict) -> str:
    """Comma-joined full names of a class's bases (best effort from source)."""
    out = []
    for b in node.bases:
        chain = []
        while isinstance(b, ast.Attribute):
            chain.insert(0, b.attr)
            b = b.value
        if not isinstance(b, ast.Name):
            continue
        if not chain and b.id in local_classes:
            out.append(f"{mod}.{b.id}")
        else:
            out.append(".".join([names.get(b.id, b.id)] + chain))
    return ",".join(out)


def _import_names(tree, mod: str, is_pkg: bool, names: dict) -> None:
    """Adds module-level name -> full dotted name, from import statements."""
    pkg = mod.split(".") if is_pkg else mod.split(".")[:-1]
    for node in _reachable(tree.body):
        if isinstance(node, ast.Import):
            for a in node.names:
                if a.asname:
                    names[a.asname] = a.name
                else:
                    names[a.name.split(".")[0]] = a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                head = pkg[:len(pkg) - node.level + 1]
                base = ".".join(head + ([base] if base else []))
            for a in node.names:
                # a star binds no name of its own; each keeps its module
                own = f"*{base}" if a.name == "*" else a.asname or a.name
                names[own] = f"{base}.{a.name}" if base else a.name


def _reachable(body):
    """Statements that may run at this level: those under if, try and with as well.

    Alternatives (else, except) come first, so that of two definitions of a
    name the main branch's counts.
    """
    todo = list(reversed(body))
    while todo:
        node = todo.pop()
        if isinstance(node, ast.If):
            todo += reversed([*node.orelse, *node.body])
        elif isinstance(node, (ast.Try, ast.TryStar)):
            other = [x for h in node.handlers for x in h.body]
            todo += reversed([*other, *node.body, *node.orelse, *node.finalbody])
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            todo += reversed(node.body)
        else:
            yield node


def catalog_records(path: str, content: str | None):
    """(kind, api_path, signature, doc, bases) for the public API of one file.

    kind is 'function', 'method', 'class', 'reexport' or 'star' (api_path: the
    module that imports, bases: the module whose names it takes); class rows carry
    the full names of their bases (comma-joined) and reexport rows the full
    name an imported public name stands for, so that inherited members and
    re-exported classes can be derived by joins.
    """
    if content is None:
        return
    mod = module_of(path)
    is_pkg = path.endswith("__init__.py") or path.endswith("__init__.pyi")
    names, local_classes, seen, again, bounds = {}, set(), set(), set(), []
    try:
        for begin, end, tree in _pieces(content):
            _import_names(tree, mod, is_pkg, names)
            for node in _reachable(tree.body):
                if isinstance(node, (*DEFS, ast.ClassDef)):
                    (again if node.name in seen else seen).add(node.name)
                if isinstance(node, ast.ClassDef):
                    local_classes.add(node.name)
            bounds.append((begin, end))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lib = mod.split(".")[0]
    for name, full in _exports(names, lib).items():
        # a public name this module imports from its own library: reflection
        # lists a class under this path too (functions keep their home key)
        if name.startswith("*"):
            yield ("star", mod, None, None, full.removesuffix(".*"))
        else:
            yield ("reexport", f"{mod}.{name}", None, None, full)
    # of definitions of a name the last one counts; what a file defines once needn't wait
    late = {}
    for begin, end in bounds:
        if len(bounds) > 1:
            tree = _parse(content[begin:end])
        for node in _reachable(tree.body):
            if isinstance(node, (*DEFS, ast.ClassDef)) and not node.name.startswith("_"):
                own = {}
                for r in _definition(node, mod, local_classes, names):
                    own[r[0], r[1]] = r
                if node.name in again:
                    late.update(own)
                else:
                    yield from own.values()
    yield from late.values()


def _exports(names: dict, lib: str) -> dict:
    """Imported names of the library itself, but private ones; each starred module once."""
    out = {}
    for name, full in names.items():
        if full.split(".")[0] == lib and "." in full and (name.startswith("*") or not name.startswith("_")):
            out["*" + full if name.startswith("*") else name] = full
    return out


def _definition(node, mod: str, local_classes: set, names: dict):
    """Records of one public function or class."""
    key = f"{mod}.{node.name}"
    if isinstance(node, DEFS):
        yield ("function", key, key + signature_text(node), ast.get_docstring(node), None)
        return
    yield ("class", key, None, ast.get_docstring(node), _bases(node, mod, local_classes, names))
    for item in _reachable(node.body):
        if isinstance(item, DEFS) and (item.name in KEEP_DUNDER or not item.name.startswith("_")):
            path = f"{key}.{item.name}"
            yield ("method", path, path + signature_text(item), ast.get_docstring(item), None)
