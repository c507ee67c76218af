"""Small helpers on single JSON documents for shapes SQL expressions cannot reach."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa

KINDS = {str: "string", bool: "bool", int: "int", float: "float", list: "list", dict: "dict", type(None): "null"}


_WRITE = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode
# plain text of a leaf: strings as they are, the rest as JSON, null as null
_TEXT = {str: str, bool: ("false", "true").__getitem__, int: str, float: _WRITE, list: _WRITE, dict: _WRITE, type(None): lambda _: None}


def leaves_of(node, path: str = "", keep_empty: bool = False) -> list[tuple[str, str | None, str]]:
    """Paths, texts and kinds of all leaves of a parsed document; lists stay whole."""
    out, stack = [], [(path, node)]
    while stack:
        here, value = stack.pop()
        kind = type(value)
        if kind is dict and (value or not here):
            stack.extend((f"{here}.{k}" if here else k, v) for k, v in value.items())
        elif kind is not dict or keep_empty:
            out.append((here, _TEXT[kind](value), KINDS[kind]))
    return out


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON number")


_READ = json.JSONDecoder(parse_constant=_no_number).decode


def document_leaves(text: str | None, keep_empty: bool) -> list[tuple[str, str | None, str]]:
    """Leaves of a text that is exactly one JSON object, nested at most as deep as the parser goes; others have none.

    Halves of character pairs become question marks: no column of text can hold them.
    """
    try:
        node = _READ(text)
    except (TypeError, ValueError, RecursionError):
        return []
    if not isinstance(node, dict):
        return []
    leaves = [leaf for leaf in leaves_of(node, keep_empty=keep_empty) if leaf[0]]
    if "\\ud" in text or "\\uD" in text:
        leaves = [tuple(x if x is None else x.encode("utf-8", "replace").decode() for x in leaf) for leaf in leaves]
    return leaves


def leaf_arrays(leaves: list[tuple[str, str | None, str]]) -> list[pa.Array]:
    """Paths, texts and kinds as Arrow columns."""
    return [pa.array(list(c), pa.string()) for c in (zip(*leaves) if leaves else ([], [], []))]


def nest(leaves: list[tuple[str, str]]) -> str:
    """JSON document from paths and the JSON text of their values."""
    root: dict = {}
    for path, text in leaves:
        *parents, last = path.split(".")
        here = root
        for part in parents:
            child = here.get(part)
            if not isinstance(child, dict):
                child = here[part] = {}
            here = child
        here[last] = json.loads(text)
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)


def mask_tree(value, pattern: re.Pattern, mask: str):
    """Mask scalars under sensitive keys of dicts, also of dicts inside lists."""
    if isinstance(value, list):
        return [mask_tree(v, pattern, mask) if isinstance(v, dict) else v for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, item in value.items():
        if isinstance(item, (str, int, float)) and pattern.search(key):
            out[key] = mask
        else:
            out[key] = mask_tree(item, pattern, mask)
    return out
