"""Python sources to entities and features, by the standard library's parser."""

from __future__ import annotations

import ast
import re

LANGUAGE, EXTENSIONS = "python", (".py", ".pyw")
Row = tuple[str, str, int, dict[str, list[str]]]


def clean_call_name(text: str) -> str:
    """Show the first balanced run of parentheses as ``(...)``."""
    begin = text.find("(")
    depth = 0
    for i in range(begin, len(text)) if begin >= 0 else ():
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return f"{text[:begin]}(...){text[i + 1 :]}"
    return text


def _flag(name: str, present: bool) -> list[str]:
    return [name] if present else []


class _Source:
    def __init__(self, text: str):
        self.lines = [line.encode() for line in text.splitlines(keepends=True)]

    def segment(self, node: ast.expr) -> str:
        """The node's text; columns count bytes."""
        a, z = node.lineno - 1, node.end_lineno - 1
        if a == z:
            return self.lines[a][node.col_offset : node.end_col_offset].decode()
        parts = [self.lines[a][node.col_offset :], *self.lines[a + 1 : z], self.lines[z][: node.end_col_offset]]
        return b"".join(parts).decode()


def _docstring(node: ast.AST) -> list[str]:
    first = node.body[0] if node.body else None
    value = first.value if isinstance(first, ast.Expr) else None
    text = value.value if isinstance(value, ast.Constant) and isinstance(value.value, str) else ""
    return _flag("docstring", bool(text.strip().strip("\"'").strip()))


def _typed(args: ast.arguments) -> list[str]:
    plain = [*args.posonlyargs, *args.args, *args.kwonlyargs]
    return _flag("param types", all(a.annotation is not None or a.arg in ("self", "cls") for a in plain))


def _callable(node: ast.FunctionDef | ast.AsyncFunctionDef, src: _Source) -> dict[str, list[str]]:
    calls, keywords = set(), set()
    # a decorator belongs to the definition, not to what it does
    inner = [node.args, *node.body, *([node.returns] if node.returns else [])]
    for x in (x for part in inner for x in ast.walk(part)):
        if isinstance(x, ast.Call):
            calls.add(clean_call_name(src.segment(x.func).strip()))
            keywords.update(f"{k.arg}=" for k in x.keywords if k.arg)
    return {
        "decorator": _decorators(node, src),
        "calls": sorted(calls),
        "call_kwargs": sorted(keywords),
        "has_docstring": _docstring(node),
        "has_return_type": _flag("return type", node.returns is not None),
        "has_param_types": _typed(node.args),
    }


def _decorators(node, src: _Source) -> list[str]:
    found = {src.segment(d).split("(")[0].strip() for d in node.decorator_list}
    return sorted("@" + d for d in found if d)


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def extract(content: bytes, path: str) -> list[Row]:
    """``kind, name, line, features`` of the module, its functions, classes and their methods."""
    text = content.decode("utf-8", "replace").removeprefix("\ufeff")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _unparsed(text)
    src = _Source(text)
    exported = any(
        isinstance(t, ast.Name) and t.id == "__all__"
        for n in tree.body
        if isinstance(n, (ast.Assign, ast.AnnAssign))
        for t in (n.targets if isinstance(n, ast.Assign) else [n.target])
    )
    rows: list[Row] = [("module", "__module__", 1, {"has_all_export": _flag("__all__", exported)})]
    for node in tree.body:
        if isinstance(node, _FUNCTIONS):
            rows.append(("function", node.name, node.lineno, _callable(node, src)))
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, _FUNCTIONS)]
            parents = {src.segment(b).strip() for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))}
            features = {
                "decorator": _decorators(node, src),
                "parent_class": sorted(parents),
                "has_docstring": _docstring(node),
                "has_post_init": _flag("__post_init__", any(m.name == "__post_init__" for m in methods)),
            }
            rows.append(("class", node.name, node.lineno, features))
            rows += [("method", f"{node.name}.{m.name}", m.lineno, _callable(m, src)) for m in methods]
    return rows


_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)")


def _unparsed(text: str) -> list[Row]:
    """What names can be told in a file that does not parse; its features are unknown, so absent."""
    rows: list[Row] = [("module", "__module__", 1, {"has_all_export": _flag("__all__", "\n__all__" in f"\n{text}")})]
    owner = None
    for i, line in enumerate(text.splitlines(), 1):
        m = _DEF.match(line)
        if not m:
            continue
        top = not m[1]
        if top and m[2] == "class":
            owner = m[3]
            rows.append(("class", owner, i, {}))
        elif top:
            owner = None
            rows.append(("function", m[3], i, {}))
        elif m[2] == "def" and owner and len(m[1].expandtabs(4)) == 4:
            rows.append(("method", f"{owner}.{m[3]}", i, {}))
    return rows
