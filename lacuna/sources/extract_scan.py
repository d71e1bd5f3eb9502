"""Sixteen languages to entities and features by one declarative scanner.

No grammar library is assumed.  Comments and strings are blanked, brackets are
matched, and each language states how its declarations look, what its types
inherit from and how its annotations are written.  Names are those a parser would
give; constructs that need one (macros, computed names) are not followed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .extract_python import Row, clean_call_name

_C_COMMENT = r"//[^\n]*|/\*.*?\*/"
_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_MODS = r"(?:[a-z]+(?:\([^)]*\))?\s+)*"


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    #: kind -> pattern with a group ``name``; what a body follows.
    declares: dict[str, str]
    #: Kinds whose bodies hold methods.
    holds: tuple[str, ...] = ()
    #: A body that is looked through as if it weren't there.
    through: str = ""
    #: Within a holder, functions that need no keyword.
    method: str = ""
    skip: str = _C_COMMENT + "|" + _STRINGS
    annotation: str = ""
    shown: str = "@{}"
    #: Header pattern(s) whose group 1 lists supertypes.
    inherits: tuple[str, ...] = ()
    types_have: tuple[str, ...] = ("decorator", "parent_class")
    functions_have: tuple[str, ...] = ("decorator", "calls")
    call: str = r"([A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*)\s*(?:<[\w\s,.<>\[\]]*>)?\s*\("
    words: frozenset[str] = field(default_factory=frozenset)


_KEYWORDS = frozenset(
    "if for while switch return catch function fn def func fun new when match foreach elif else sizeof typeof await yield and or not in do try throw using lock synchronized super".split()
)
_ANNOT = r"@([A-Za-z_][\w.]*)"
_HASH = r"#!?\[\s*([A-Za-z_][\w:\\]*)"
_EXTENDS = (r"\bextends\s+([^{]*?)(?=\bimplements\b|\bpermits\b|$)", r"\bimplements\s+([^{]*?)(?=\bpermits\b|$)")
_COLON = (r"(?:^|[\w>)\s])(?<!:):(?!:)\s*([^{]*)$",)
_JS_FUNCTION = r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\("
_JS_ARROW = r"(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=\n{]+)?=>|[A-Za-z_$][\w$]*\s*=>)"
_JS_CLASS = r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*)"
_JS_METHOD = r"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*[*#]?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{;]+)?(?=\{)"
_JS_SKIP = _C_COMMENT + "|" + _STRINGS + r"|`(?:\\.|[^`\\])*`"
_TYPED_METHOD = r"(?:[\w<>\[\],.?&*\s:]+?[\s>\]*&?])?(?P<name>~?[A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const|noexcept|override|final|throws\s+[\w.,\s]+|where\s[^{]+|:\s*[^{;]+|->\s*[^{;]+)*\s*(?=[{;]|=>)"
_TS = {
    "function": _JS_FUNCTION,
    "function ": _JS_ARROW,
    "class": _JS_CLASS,
    "interface": r"(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>[A-Za-z_$][\w$]*)",
}

LANGUAGES = [
    Language(
        "javascript", (".js", ".jsx", ".mjs", ".cjs"), {"function": _JS_FUNCTION, "function ": _JS_ARROW, "class": _JS_CLASS}, ("class",),
        method=_JS_METHOD, skip=_JS_SKIP, inherits=(r"\bextends\s+([\w$.]+)",), types_have=("parent_class",), functions_have=("calls",),
    ),
    Language("typescript", (".ts", ".mts", ".cts"), _TS, ("class",), method=_JS_METHOD, skip=_JS_SKIP, annotation=_ANNOT, inherits=_EXTENDS),
    Language("tsx", (".tsx",), _TS, ("class",), method=_JS_METHOD, skip=_JS_SKIP, annotation=_ANNOT, inherits=_EXTENDS),
    Language(
        "rust", (".rs",),
        {
            "function": r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(?P<name>\w+)",
            "struct": r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)",
            "enum": r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)",
            "trait": r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)",
            "impl": r"(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:(?P<of>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?&?(?P<name>\w+)",
        },
        ("trait", "impl"), skip=r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", annotation=_HASH, shown="#[{}]",
        inherits=(r"\btrait\s+\w+(?:<[^{]*?>)?\s*:\s*([^{]*?)(?=\bwhere\b|$)",),
        call=r"([A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*)(?:::<[^()]*?>)?\s*\(|([A-Za-z_]\w*!)\s*[\(\[{]",
    ),
    Language(
        "go", (".go",),
        {
            "method": r"func\s*\(\s*(?:\w+\s+)?\*?(?P<of>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)",
            "function": r"func\s+(?P<name>\w+)",
            "struct": r"(?:type\s+)?(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b(?=\s*\{)",
            "interface": r"(?:type\s+)?(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b(?=\s*\{)",
        },
        skip=_C_COMMENT + "|" + _STRINGS + r"|`[^`]*`", types_have=(), functions_have=("calls",),
    ),
    Language(
        "java", (".java",),
        {k: rf"{_MODS}{w}\s+(?P<name>\w+)" for k, w in (("class", "class"), ("interface", "interface"), ("enum", "enum"))},
        ("class", "interface", "enum"), method=_TYPED_METHOD, annotation=_ANNOT, inherits=_EXTENDS,
        call=r"(new\s+[A-Za-z_][\w.]*|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*(?:<[\w\s,.?<>]*>)?\s*\(",
    ),
    Language(
        "csharp", (".cs",),
        {k: rf"{_MODS}{k}\s+(?:struct\s+|class\s+)?(?P<name>\w+)" for k in ("class", "interface", "struct", "record", "enum")},
        ("class", "interface", "struct", "record"), through=r"namespace\s+[\w.]+", method=_TYPED_METHOD,
        annotation=r"(?:^|[\[\]\s])\[\s*(?:\w+\s*:\s*)?([A-Za-z_][\w.]*)", shown="[{}]", inherits=(r"(?<!:):(?!:)\s*([^{]*?)(?=\bwhere\b|$)",),
        call=r"(new\s+[A-Za-z_][\w.]*|[A-Za-z_]\w*(?:\??\.[A-Za-z_]\w*)*)\s*(?:<[\w\s,.?<>]*>)?\s*\(",
    ),
    Language(
        "swift", (".swift",),
        {
            "function": rf"{_MODS}func\s+(?P<name>[\w`]+)",
            "function ": rf"{_MODS}(?P<name>init)\s*[?!]?(?=\s*[(<])",
            **{k: rf"{_MODS}{k}\s+(?P<name>[\w.]+)" for k in ("class", "struct", "extension", "enum", "protocol")},
        },
        ("class", "struct", "extension", "enum", "protocol"), annotation=_ANNOT, inherits=(r"(?<!:):\s*([^{]*?)(?=\bwhere\b|$)",),
    ),
    Language(
        "c", (".c", ".h"),
        {"struct": r"(?:typedef\s+)?struct\s+(?P<name>\w+)(?=\s*\{)", "function": r"[A-Za-z_][\w\s*]*?[\s*](?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?=\{)"},
        skip=_C_COMMENT + "|" + _STRINGS + r"|^[ \t]*#[^\n]*", types_have=(), functions_have=("calls",),
    ),
    Language(
        "cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".c++"),
        {
            "class": r"(?:template\s*<[^{;]*?>\s*)?class\s+(?:\w+\s+)?(?P<name>\w+)(?=[^;{(]*\{)",
            "struct": r"(?:template\s*<[^{;]*?>\s*)?struct\s+(?P<name>\w+)(?=[^;{(]*\{)",
            "function": r"[A-Za-z_][\w\s*&:<>,]*?[\s*&](?P<name>(?:\w+::)*~?\w+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|->\s*[\w:<>]+|:\s*[^{;]+)*\s*(?=\{)",
        },
        ("class", "struct"), through=r"(?:inline\s+)?namespace\b[\w:\s]*|extern\s*", method=_TYPED_METHOD,
        skip=_C_COMMENT + "|" + _STRINGS + r"|^[ \t]*#[^\n]*", inherits=_COLON, types_have=("parent_class",), functions_have=("calls",),
    ),
    Language(
        "php", (".php",),
        {
            "function": r"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<name>\w+)",
            **{k: rf"(?:(?:final|abstract|readonly)\s+)*{k}\s+(?P<name>\w+)" for k in ("class", "interface", "trait")},
        },
        ("class", "interface", "trait"), through=r"namespace\s+[\w\\]+", skip=_C_COMMENT + "|" + _STRINGS + r"|#(?!\[)[^\n]*",
        annotation=_HASH, shown="#[{}]", inherits=_EXTENDS,
        call=r"(new\s+[A-Za-z_\\][\w\\]*|[A-Za-z_\\][\w\\]*(?:::\w+)?)\s*\(",
    ),
    Language(
        "kotlin", (".kt", ".kts"),
        {
            "function": rf"{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?,\s]+\.)?(?P<name>\w+)",
            "data_class": rf"{_MODS}data\s+class\s+(?P<name>\w+)",
            **{k: rf"{_MODS}{k}\s+(?P<name>\w+)" for k in ("class", "interface", "object")},
        },
        ("class", "data_class", "interface", "object"), skip=r"\"\"\".*?\"\"\"|" + _C_COMMENT + "|" + _STRINGS, annotation=_ANNOT,
        inherits=(r"(?:\)|\b\w+|>)\s*:\s*([^{]*)$",),
    ),
    Language(
        "scala", (".scala", ".sc"),
        {
            "function": rf"{_MODS}def\s+(?P<name>[\w`]+)",
            "class": rf"{_MODS}(?:case\s+)?class\s+(?P<name>\w+)",
            "trait": rf"{_MODS}trait\s+(?P<name>\w+)",
            "object": rf"{_MODS}(?:case\s+)?object\s+(?P<name>\w+)",
        },
        ("class", "trait", "object"), through=r"package\s+[\w.]+", skip=r"\"\"\".*?\"\"\"|" + _C_COMMENT + "|" + _STRINGS, annotation=_ANNOT,
        inherits=(r"\bextends\s+([^{]*)$",),
    ),
]


def _blank(text: str, skip: str) -> str:
    return re.sub(skip, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S | re.M)


def _pairs(text: str) -> dict[int, int]:
    """Where each opening bracket closes and each closing one opens; unmatched ones run to the end."""
    stack: list[int] = []
    out: dict[int, int] = {}
    for m in re.finditer(r"[(){}\[\]]", text):
        if m[0] in "({[":
            stack.append(m.start())
        else:
            for k in range(len(stack) - 1, -1, -1):
                if text[stack[k]] + m[0] in ("()", "{}", "[]"):
                    out[stack[k]], out[m.start()] = m.start(), stack[k]
                    del stack[k:]
                    break
    for at in stack:
        out[at] = len(text)
    return out


def _split_types(listed: str) -> list[str]:
    """Names in a list of supertypes, without arguments and access words."""
    flat, depth = [], 0
    for ch in listed:
        depth += (ch in "<([") - (ch in ">)]")
        flat.append(ch if depth == 0 and ch not in ">)]" else " ")
    parts = re.split(r",|\+|&|\bwith\b|\bby\b.*", "".join(flat))
    found = [re.sub(r"^(?:(?:public|private|protected|virtual)\s+)+", "", p.strip()) for p in parts]
    return [m[0] for p in found if (m := re.match(r"[A-Za-z_$\\][\w$.:\\]*", p))]


class _Scanner:
    def __init__(self, text: str, lang: Language):
        self.raw, self.lang = text, lang
        self.text = _blank(text, lang.skip)
        self.pair = _pairs(self.text)
        kinds = "|".join(f"(?P<k{i}>{p.replace('?P<name>', f'?P<n{i}>').replace('?P<of>', f'?P<o{i}>')})" for i, p in enumerate(lang.declares.values()))
        self.kinds = [k.strip() for k in lang.declares]
        self.declared = re.compile(rf"(?<![\w$.])(?:{kinds})", re.M)
        self.method = re.compile(lang.method) if lang.method else None
        self.through = re.compile(rf"(?:{lang.through})\s*$") if lang.through else None
        self.call = re.compile(lang.call)
        self.rows: list[Row] = []

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def calls(self, a: int, z: int) -> list[str]:
        found = set()
        for m in self.call.finditer(self.text, a, z):
            g = next(i for i, x in enumerate(m.groups(), 1) if x)
            name, begin = m[g], m.start(g)
            if name in _KEYWORDS:
                continue
            while begin >= 2 and self.text[begin - 1] == "." and self.text[begin - 2] in ")]" and (begin - 2) in self.pair:
                begin = self.pair[begin - 2]
                while begin > a and re.match(r"[\w$.!?]", self.text[begin - 1]):
                    begin -= 1
            full = re.sub(r"\s+", " ", self.raw[begin : m.end(g)]).strip().replace("?.", ".")
            if self.lang.name == "php":
                full = full.replace("::", ".").rpartition("->")[2]
            found.add(clean_call_name(full))
        return sorted(x for x in found if x)

    def features(self, kind: str, head: str, body: tuple[int, int], parents: list[str]) -> dict[str, list[str]]:
        is_function = kind in ("function", "method")
        have = self.lang.functions_have if is_function else self.lang.types_have
        out: dict[str, list[str]] = {}
        for name in have:
            if name == "decorator":
                found = re.findall(self.lang.annotation, head) if self.lang.annotation else []
                out[name] = sorted({self.lang.shown.format(x) for x in found})
            elif name == "calls":
                out[name] = self.calls(*body)
            else:
                out[name] = sorted(set(parents))
        return out

    def scan(self, a: int, z: int, owner: str | None = None) -> None:
        at = before = a
        while at < z:
            m = self.declared.search(self.text, at, z)
            method = self.method.search(self.text, at, z) if owner and self.method else None
            brace = self.text.find("{", at, z)
            if method and method["name"] in _KEYWORDS:
                method = None
            first = min((x.start() for x in (m, method) if x), default=z)
            if 0 <= brace < first:  # a body of no declaration
                if self.through and self.through.search(self.text, before, brace):
                    self.scan(brace + 1, self.pair.get(brace, z), owner)
                at = before = self.pair.get(brace, z) + 1
                continue
            if first == z:
                return
            if m and (not method or m.start() <= method.start()):
                i = next(i for i in range(len(self.kinds)) if m.group(f"k{i}") is not None)
                kind, name = self.kinds[i], m.group(f"n{i}")
                of = m.groupdict().get(f"o{i}")
                begin, after = m.start(f"n{i}"), m.end()
            else:
                kind, name, of, begin, after = "method", method["name"], None, method.start("name"), method.end()
            end = self._end(after, z)
            body_at = self.text.find("{", begin, end)
            header = self.text[m.start() if m and first == m.start() else first : body_at if body_at >= 0 else end]
            close = self.pair.get(body_at, z) if body_at >= 0 else end
            close = min(close, z)
            since = max(self.text.rfind(c, before, first) for c in ";{}") + 1
            head = self._unannotated(max(since, before), first) + self.raw[first:begin]
            self.emit(kind, name, of, owner, begin, header, head, (after, close), body_at)
            at = before = max(close + (body_at >= 0), after)

    def _unannotated(self, a: int, z: int) -> str:
        return self.raw[a:z]

    def _end(self, at: int, z: int) -> int:
        """Where a declaration without a body ends, or its body begins."""
        while at < z:
            m = re.compile(r"[({;\[]|\n").search(self.text, at, z)
            if not m:
                return z
            if m[0] in "([":
                at = self.pair.get(m.start(), z) + 1
            elif m[0] == "\n":
                rest = self.text[m.end() : z].lstrip()
                if self.lang.name in ("kotlin", "scala", "swift", "javascript", "typescript", "tsx", "go") and not re.match(r"[{:.,=)]|extends\b|with\b|where\b|implements\b", rest):
                    return m.start()
                at = m.end()
            else:
                return m.start() + (m[0] == "{")
        return z

    def emit(self, kind, name, of, owner, begin, header, head, body, body_at) -> None:
        full, parents = name, []
        if self.lang.name == "rust" and kind == "impl":
            full = f"{name} (impl {of})" if of else f"{name} (impl)"
            parents = [of.split("::")[-1]] if of else []
        elif self.lang.name == "go" and kind == "method":
            full = f"{of}.{name}"
        elif kind == "function" and owner:
            kind, full = "method", f"{owner}.{name}"
        elif kind == "method":
            full = f"{owner}.{name}"
        elif kind == "function" and "::" in name:
            kind, full = "method", name.replace("::", ".")
        if kind not in ("function", "method", "impl"):
            header = re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "()", header)  # no types of parameters
            parents = [p for r in self.lang.inherits if (m := re.search(r, header, re.S)) for p in _split_types(m[1])]
        self.rows.append((kind, full, self.line(begin), self.features(kind, head, body, parents)))
        if kind in self.lang.holds and body_at >= 0:
            self.scan(body_at + 1, body[1], name)


def scan_braces(content: bytes, lang: Language) -> list[Row]:
    s = _Scanner(content.decode("utf-8", "replace"), lang)
    s.scan(0, len(s.text))
    return s.rows


_RUBY_SKIP = r"^=begin.*?^=end|#[^\n]*|" + _STRINGS
_RUBY_OPEN = re.compile(r"^[ \t]*(?:[\w@.]+\s*=\s*)?(class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?[ \t]*$", re.M)


def scan_ruby(content: bytes) -> list[Row]:
    """Nested classes and modules, methods and singleton methods, by matching ``end``."""
    text = _blank(content.decode("utf-8", "replace"), _RUBY_SKIP)
    rows: list[Row] = []
    stack: list[tuple[str, str, int]] = []  # what is open: keyword, name, row
    for number, line in enumerate(text.split("\n"), 1):
        code = line.strip()
        owner = next((n for k, n, _ in reversed(stack) if k in ("class", "module")), None)
        method = next((r for k, _, r in reversed(stack) if k == "def"), None)
        m = re.match(r"(class|module)\s+([\w:]+)(?:\s*<\s*([\w:.]+))?", code)
        d = re.match(r"def\s+(?:self\.)?([\w?!=\[\]<>+\-*/]+)", code)
        if m:
            rows.append((m[1], m[2], number, {"parent_class": [m[3]] if m[3] else []}))
            stack.append((m[1], m[2], len(rows) - 1))
        elif d:
            name = f"{owner}.{d[1]}" if owner else d[1]
            rows.append(("method" if owner else "function", name, number, {"calls": []}))
            if not re.search(r"\bend\s*$", code) and not re.match(r"def\s+\S+(?:\([^)]*\))?\s*=\s", code):
                stack.append(("def", d[1], len(rows) - 1))
        else:
            mixin = re.match(r"(?:include|extend|prepend)\s+([\w:]+)", code)
            top = next((r for k, _, r in reversed(stack) if k in ("class", "module")), None)
            if mixin and top is not None and method is None:
                rows[top][3]["parent_class"].append(mixin[1])
            if _RUBY_OPEN.search(code) and not re.search(r"\bend\s*$", code):
                stack.append(("block", "", -1))
        if method is not None and not m and not d:
            found = re.findall(r"(?<![\w.@:$])((?:@{0,2}[A-Za-z_]\w*(?:&?\.))+[A-Za-z_]\w*[?!]?|[A-Za-z_]\w*[?!]?(?=\())", code)
            rows[method][3]["calls"] += [c.replace("&.", ".") for c in found if c not in _KEYWORDS]
            bare = re.match(r"([a-z_]\w*[?!]?)(?:\s+[^=\s.(&|+\-*/<>]|$)", code)
            if bare and bare[1] not in _KEYWORDS | {"end", "else", "elsif", "rescue", "ensure", "begin", "unless", "until", "case", "nil", "true", "false", "self", "yield"}:
                rows[method][3]["calls"].append(bare[1])
        if re.match(r"end\b", code) and stack:
            stack.pop()
    return [(k, n, at, {f: sorted(set(v)) for f, v in features.items()}) for k, n, at, features in rows]


def scan_lua(content: bytes) -> list[Row]:
    text = _blank(content.decode("utf-8", "replace"), r"--\[\[.*?\]\]|--[^\n]*|\[\[.*?\]\]|" + _STRINGS)
    heads = re.compile(r"^(?:local\s+)?(?:function\s+([\w.:]+)\s*\(|([\w.]+)\s*=\s*function\s*\()", re.M)
    rows: list[Row] = []
    for m in heads.finditer(text):
        name = m[1] or m[2]
        depth, end = 0, len(text)
        for w in re.finditer(r"\b(function|do|then|repeat|end|until|elseif)\b", text[m.start() :]):
            depth += {"function": 1, "do": 1, "then": 1, "repeat": 1, "end": -1, "until": -1, "elseif": -1}[w[1]]
            if depth == 0:
                end = m.start() + w.end()
                break
        calls = {c for c in re.findall(r"([A-Za-z_]\w*(?:[.:]\w+)*)\s*[({\"']", text[m.end() : end]) if c not in _KEYWORDS}
        kind = "method" if ":" in name or (m[2] and "." in name) else "function"
        rows.append((kind, name.replace(":", "."), text.count("\n", 0, m.start()) + 1, {"calls": sorted(calls)}))
    return rows


_SHELL_WORDS = _KEYWORDS | {"then", "fi", "done", "esac", "case", "local", "{", "}", "[[", "[", "!", "until", "select", "export"}


def scan_bash(content: bytes) -> list[Row]:
    text = _blank(content.decode("utf-8", "replace"), r"(?<![\w$\{])#[^\n]*|" + _STRINGS)
    pair = _pairs(text)
    rows: list[Row] = []
    for m in re.finditer(r"^[ \t]*(?:function\s+([\w:.\-]+)\s*(?:\(\s*\))?|([\w:.\-]+)\s*\(\s*\))\s*\{", text, re.M):
        body = text[m.end() : pair.get(m.end() - 1, len(text))]
        body = re.sub(r"(?<![\w$./-])(?:if|then|elif|else|do|while|until|!)(?![\w./-])", ";", body)
        commands = re.findall(r"(?:^|[;&|(`\n])[ \t]*(?:\w+=\S*[ \t]+)*([A-Za-z_./][\w./\-]*)(?!\s*=|\w*=|[\w./\-]*\()", body)
        calls = {c for c in commands if c not in _SHELL_WORDS}
        rows.append(("function", m[1] or m[2], text.count("\n", 0, m.start(1) if m[1] else m.start(2)) + 1, {"calls": sorted(calls)}))
    return rows
