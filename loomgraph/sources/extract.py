"""Symbols and call sites of source texts.

Python is parsed with the standard library. Other languages are read by a table of
patterns over their code (``lexing``): strings and comments are none, and a definition
reaches to the bracket or word that closes its block.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.lexing import ALIKE, Code, code_of

SYMBOL = "path string, name string, kind string, start_line long, end_line long, signature string, doc string, qualified_name string"

_WORD = r"(?P<name>[A-Za-z_$][\w$]*)"
_TYPE = r"(?P<name>[A-Za-z_]\w*)"
#: For each language the patterns of definitions over code without strings and comments, and the kind each defines.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [(rf"\bfn\s+{_WORD}", "function"), (rf"\bstruct\s+{_WORD}", "struct"), (rf"\benum\s+{_WORD}", "enum"), (rf"\btrait\s+{_WORD}", "trait"), (rf"^[ \t]*(?:unsafe\s+|default\s+)?impl\b(?:\s*<(?:[^<>{{}}]|<[^<>]*>)*>)?\s+(?:[\w:<>,&' ]+?\s+for\s+)?(?:\w+::)*{_WORD}", "impl"),
        (rf"\bmod\s+{_WORD}", "module"), (rf"\btype\s+{_WORD}", "type_alias"), (rf"\bconst\s+(?!fn\b){_WORD}\s*:", "const")],
    "typescript": [(rf"(?<![\w$.])function\b\s*\*?\s*{_WORD}", "function"), (rf"(?<![\w$.])class\s+(?!extends\b){_WORD}", "class"), (rf"(?<![\w$.])interface\s+{_WORD}", "interface"), (rf"(?<![\w$.])type\s+{_WORD}\s*(?:<[^=;]*>)?\s*=", "type_alias"),
        (rf"(?<![\w$.])enum\s+{_WORD}", "enum"), (rf"(?<![\w$.])(?:const|let)\s+{_WORD}\s*(?::[^=;]*)?=\s*(?:async\b\s*)?(?:<[^>()]*>\s*)?(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::[^=;{{}}]*)?|[\w$]+\s*)=>", "const")],
    "go": [(rf"^func\s+{_WORD}", "function"), (rf"^func\s*\([^)]*\)\s*{_WORD}", "method"), (rf"\btype\s+{_WORD}", "type"), (rf"\bconst\s+{_WORD}", "const")],
    "c": [(rf"\bstruct\s+{_TYPE}\s*{{", "struct"), (rf"\benum\s+{_TYPE}\s*{{", "enum"), (rf"\btypedef\b[^;{{}}()]*?(?:{{(?:[^{{}}]|{{[^{{}}]*}})*}})?[^;{{}}()]*?\b{_TYPE}\s*(?:\[[^\]]*\]\s*)?;", "type_alias")],
    "cpp": [(rf"(?<!enum )\bclass\s+{_TYPE}\s*(?:final\s*)?(?::[^:;{{][^;{{]*)?{{", "class"), (rf"(?<!enum )\bstruct\s+{_TYPE}\s*(?:final\s*)?(?::[^:;{{][^;{{]*)?{{", "struct"), (rf"\benum\s+(?:class\s+|struct\s+)?{_TYPE}\s*(?::[^;{{]*)?{{", "enum"), (rf"\bnamespace\s+(?:\w+::)*{_TYPE}\s*{{", "namespace")],
    "java": [(rf"(?<![\w.])class\s+{_WORD}", "class"), (rf"(?<![\w.@])@?interface\s+{_WORD}", "interface"), (rf"(?<![\w.])enum\s+{_WORD}", "enum"), (rf"(?<![\w.])record\s+{_WORD}\s*[(<]", "class")],
    "csharp": [(rf"(?<![\w.])class\s+{_TYPE}", "class"), (rf"(?<![\w.])interface\s+{_TYPE}", "interface"), (rf"(?<![\w.])enum\s+{_TYPE}", "enum"), (rf"(?<=[\w>\]?])\s+{_TYPE}\s*(?:{{\s*(?:(?:private|protected|internal)\s+)*(?:get|set|init)\b|=>)", "property")],
    "ruby": [(r"\bdef\s+(?:(?:self|\w+)\s*\.\s*)?(?P<name>[A-Za-z_]\w*[?!]?)(?![\w=?!])", "method"), (r"(?<![.\w:])class\s+(?:[A-Z]\w*::)*(?P<name>[A-Z]\w*)", "class"), (r"(?<![.\w:])module\s+(?:[A-Z]\w*::)*(?P<name>[A-Z]\w*)", "module")],
    "php": [(rf"(?<![\w$>:])function\s*&?\s*{_WORD}", "function"), (rf"(?<![\w$>:])class\s+{_WORD}", "class"), (rf"(?<![\w$>:])interface\s+{_WORD}", "interface"), (rf"(?<![\w$>:])trait\s+{_WORD}", "trait")],
    "kotlin": [(rf"(?<![\w.])fun\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?{_WORD}\s*\(", "function"), (rf"(?<![\w.:])(?:class|interface)\s+{_WORD}", "class"), (rf"(?<![\w.])companion\s+object\s+{_WORD}", "companion"), (rf"(?<![\w.])(?<!companion )object\s+{_WORD}", "object")],
    "swift": [(rf"(?<![\w.])class\s+(?!func\b|var\b|let\b|subscript\b){_TYPE}", "class"), (rf"(?<![\w.])struct\s+{_TYPE}", "struct"), (rf"(?<![\w.])enum\s+{_TYPE}", "enum"), (rf"(?<![\w.])actor\s+{_TYPE}", "actor"), (rf"(?<![\w.])protocol\s+{_TYPE}", "protocol"), (rf"(?<![\w.])func\s+{_TYPE}", "function")],
    "lua": [(rf"\bfunction\s+(?:[\w.]+[.:])?{_TYPE}", "function"), (rf"\b[\w.]+\.{_TYPE}\s*=\s*function\b", "method")],
    "dart": [(rf"(?<![\w.])class\s+{_WORD}", "class"), (rf"(?<![\w.])mixin\s+(?!class\b){_WORD}", "mixin"), (rf"(?<![\w.])extension\s+(?:type\s+)?(?!on\b){_WORD}", "extension"), (rf"(?<![\w.])enum\s+{_WORD}", "enum")],
}
#: Kinds whose blocks hold members, by language.
_HOLDERS: dict[str, frozenset[str]] = {k: frozenset("class interface enum struct trait".split()) for k in ("typescript", "java", "csharp", "php", "cpp")} | {"dart": frozenset("class mixin extension enum".split())}
#: What follows the parameters where a name before them is defined; languages whose definitions have no word of their own.
_AFTER: dict[str, str] = {
    "typescript": r"\s*(?::[^;={}]*(?:\{[^{}]*\}[^;={}]*)?)?\{", "c": r"\s*(?:__\w+(?:\([^()]*\))?\s*)*\{", "cpp": r"\s*(?:const\b|noexcept\b(?:\([^()]*\))?|override\b|final\b|&&?|->\s*[\w:<>*& ]+?|\s)*(?::(?!:)(?:[^;{}]|\{[^{}]*\}(?=\s*[,{]))*)?\{",
    "java": r"\s*(?:\[\]\s*)*(?:throws\s+[\w.,\s]+?)?\s*(?:\{|;|default\b)", "csharp": r"\s*(?:where\s+[^{;]*)?(?::\s*(?:this|base)\s*\((?:[^()]|\([^()]*\))*\)\s*)?(?:\{|;|=>)", "dart": r"\s*(?:async\*?|sync\*)?\s*(?:\{|=>|;)",
}
_NAMED = re.compile(r"(?P<tilde>~\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*(?P<generic><[^()<>;{}]*(?:<[^<>]*>[^()<>;{}]*)*>\s*)?\(")
_BEFORE = re.compile(r"(?:([\w$]+)|(\S))\s*$")
_NOT_A_TYPE = frozenset("new return throw else case in is as await yield do goto typeof delete instanceof assert using not and or when if while for switch catch extends implements super this".split())
#: Languages without semicolons, where the end of a line may end a definition without a block.
_BY_LINE = frozenset("typescript tsx go kotlin swift".split())
_KEYWORDS = frozenset("if for while switch return catch function fn def func fun class sizeof and or not in elseif foreach else super this typeof await".split())
_OWN_KEYWORDS: dict[str, frozenset[str]] = {
    k: frozenset(v.split()) for k, v in {"rust": "match", "php": "match until", "csharp": "lock fixed using when", "ruby": "unless until when then do end defined", "kotlin": "when", "lua": "until then do end", "swift": "guard", "c": "alignof", "cpp": "alignof decltype static_assert"}.items()
}
_RUBY_WORDS = frozenset("module class def begin rescue ensure elsif yield alias undef nil true false next break redo retry".split())
_CALL = re.compile(rf"(?P<dot>(?:\.|->|::|:)\s*)?{_WORD}\s*(?:::\s*<(?:[^<>;{{}}]|<[^<>;{{}}]*>)*>\s*)?\(")
_CALL_ALSO: dict[str, re.Pattern] = {
    "rust": re.compile(rf"{_WORD}!\s*[\(\[{{]"), "kotlin": re.compile(rf"(?<![\w.]){_WORD}[ \t]*\{{"), "ruby": re.compile(r"\.\s*(?P<name>[a-z_]\w*[?!]?)(?![\w(?!])|^[ \t]*(?P<bare>[a-z_]\w*[?!]?)[ \t]+(?=[\w:@\[\"'%])(?!(?:if|unless|while|until|do|and|or|in|then)\b)", re.M),
    "lua": re.compile(rf"(?<![\w.:]){_TYPE}[ \t]*(?=[\"'{{])"),
}

#: Annotations that inject what they stand at.
DI_ANNOTATIONS = frozenset("Autowired Inject Resource Provides Bean".split())
_ARGS = r"(?:\s*\((?:[^()]|\([^()]*\))*\))?"
_MARKS = rf"(?P<marks>(?:(?:@(?!interface\b)[\w.:]+{_ARGS}|\b(?:public|protected|private|internal|static|final|transient|volatile|lateinit|late|override|open|weak|lazy|const|var(?=\s+\w+\s+\w))\b)\s+)+)"
#: For each language the pattern of what its framework links (marks: annotations, name: what the edge goes to), the annotations it needs, and the kind of edge.
BRIDGES: dict[str, tuple[str, frozenset[str], str]] = {
    "java": (rf"{_MARKS}(?P<name>[A-Za-z_$][\w$]*)\s+[\w$]+\s*[;=,]", DI_ANNOTATIONS, "DI_INJECT"),
    "csharp": (r"(?P<marks>(?:\[[^\[\]]*\]\s*)+)(?:(?:public|protected|private|internal|static|readonly|virtual|override|required|sealed|new)\s+)*(?P<name>[A-Za-z_]\w*)\s+\w+\s*[{;=,]", DI_ANNOTATIONS, "DI_INJECT"),
    "php": (r"(?P<marks>(?:#\[[^\]]*\]\s*)+)(?:(?:public|protected|private|static|readonly|var)\s+)+(?:[?\w\\|&]+\s+)?\$(?P<name>\w+)\s*[;=]", DI_ANNOTATIONS, "DI_INJECT"),
    "kotlin": (rf"{_MARKS}(?:val|var)\s+(?P<name>\w+)", DI_ANNOTATIONS, "DI_INJECT"),
    "dart": (rf"{_MARKS}(?:[\w<>?,.]+\s+)?(?P<name>[A-Za-z_]\w*)\s*[;=,]", DI_ANNOTATIONS, "DI_INJECT"),
    "swift": (rf"{_MARKS}(?:var|let)\s+(?P<name>\w+)", DI_ANNOTATIONS | {"Environment", "EnvironmentObject"}, "FRAMEWORK_LINK"),
    "ruby": (r"^[ \t]*(?P<marks>has_many|has_one|belongs_to|has_and_belongs_to_many|inject)\b[ \t(]+:(?P<name>\w+)", frozenset("has_many has_one belongs_to has_and_belongs_to_many inject".split()), "FRAMEWORK_LINK"),
    "typescript": (r"(?<![\w$.])(?P<marks>require|import)\s*\(\s*([\"'])(?P<name>[^\"'\n]+)\2", frozenset(("require", "import")), "DYNAMIC_IMPORT"),
}
_NO_TYPES = frozenset("int long short byte char boolean float double bool string object decimal void class struct interface enum record return namespace var event delegate".split())
_GO_STRUCT = re.compile(r"\bstruct\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
_GO_FIELD = re.compile(r"^\s*(?:\w+(?:\s*,\s*\w+)*[ \t]+|\*)?([A-Za-z_]\w*)\s*(?:`[^`]*`|\"[^\"]*\")?\s*(?://.*)?$")
_COMMENT = re.compile(r"^\s*(?:///?|//!|/\*\*|\*/|\* |# )\s?(.*?)\s*(?:\*/)?$")


def doc_above(lines: list[str], at: int) -> str | None:
    """Comment lines right above line ``at`` (from 0), joined by spaces; none if there are none."""
    found = []
    while at > 0 and (m := _COMMENT.match(lines[at - 1])):
        found.append(m[1].strip())
        at -= 1
    return " ".join(x for x in reversed(found) if x) or None


def python_symbols(text: str) -> tuple[list[tuple], list[tuple]]:
    """((name, kind, start, end, signature, doc, qualified name), ...) and ((line, callee, edge kind), ...); raises what the parser does."""
    tree = ast.parse(text)
    lines, symbols, calls, within = text.split("\n"), [], [], {}
    for node in ast.walk(tree):  # parents come before what they hold
        own = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)
        name = f"{within.get(node, '')}.{node.name}".lstrip(".") if own else within.get(node, "")
        within.update((child, name) for child in ast.iter_child_nodes(node))
        if own:
            doc = ast.get_docstring(node) or doc_above(lines, node.lineno - 1)
            symbols.append((node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno, lines[node.lineno - 1].strip()[:120], doc, name))
            for mark in node.decorator_list:
                name = mark.func if isinstance(mark, ast.Call) else mark
                calls.append((node.lineno, name.attr if isinstance(name, ast.Attribute) else getattr(name, "id", ""), "DECORATES"))
        elif isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            kind = "DYNAMIC_IMPORT" if name in ("import_module", "__import__") else "CALLS"
            calls.append((node.lineno, name, kind))
    return symbols, [c for c in calls if c[1]]


def pattern_bridges(text: str, language: str, annotations: frozenset[str] = frozenset()) -> list[tuple]:
    """((line, name, edge kind), ...) of annotations, imports, embedded fields and DSL calls, which no call site shows."""
    language = "typescript" if language == "tsx" else language
    text = re.sub(r"(?m)^[ \t]*(?://|\*(?=[\s/])|/\*|#(?!\[)).*$", "", text)  # lines of comment; the others keep their numbers
    found = []
    if language == "go":
        plain = re.sub(r"\b(?:interface|struct)\{\}", lambda m: "[]" + " " * (len(m[0]) - 2), text)
        for struct in _GO_STRUCT.finditer(plain):
            at = plain.count("\n", 0, struct.start(1)) + 1
            for i, line in enumerate(struct[1].split("\n")):
                found += [(at + i, m[1], "DI_INJECT") for part in line.split(";") if (m := _GO_FIELD.match(part))]
    elif language in BRIDGES:
        pattern, wanted, kind = BRIDGES[language]
        wanted = wanted | annotations
        for m in re.finditer(pattern, text, re.M):
            marks = re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", m["marks"])
            if not wanted.isdisjoint(re.findall(r"\w+", marks)) and not (language in ("java", "csharp") and m["name"] in _NO_TYPES):
                found.append((text.count("\n", 0, m.start("name")) + 1, m["name"], kind))
    return found


def _end(code: Code, at: int, language: str) -> tuple[int, int]:
    """(opener of the block or -1, last place) of a definition whose name ends at ``at``."""
    text = code.text
    for m in _STOPS[language in _BY_LINE].finditer(text, at):
        place, token = m.start(), m[0]
        if place < at:
            continue
        if token in "([":
            at = code.ends.get(place, place) + 1
        elif token == "{":
            if language == "go" and re.search(r"\b(?:interface|struct)\s*$", text[max(0, place - 20) : place]) and re.match(r"\s*[{,)]", text[code.ends[place] + 1 :][:40]):
                at = code.ends[place] + 1  # a type of the signature, not the body
                continue
            return place, code.ends.get(place, len(text) - 1)
        elif token == "\n":
            if not (re.search(r"(?:[=(,:|&<+.]|\bwhere)\s*$", text[max(0, place - 20) : place]) or re.match(r"\s*(?:[{=?:|&]|where\b|throws\b)", text[place : place + 200])):
                return -1, place - 1
        else:
            return -1, place if token == ";" else place - 1
    return -1, max(0, len(text.rstrip()) - 1)


_STOPS = (re.compile(r"[(\[{};]"), re.compile(r"[(\[{};\n]"))


def _word_block(code: Code, at: int, language: str) -> tuple[int, int]:
    """As ``_end``, of a definition that a word opens at ``at`` and another closes."""
    if at in code.ends:
        return at, code.ends[at] + (3 if code.text.startswith("end", code.ends[at]) else 0) - 1
    end = code.text.find("\n", at)
    return -1, (end if end >= 0 else len(code.text)) - 1


def _definitions(code: Code, language: str) -> list[tuple[int, int, int, str, str]]:
    """(first place, last place, place of the name, name, kind), those that hold others first."""
    found: dict[int, tuple[int, int, str, str]] = {}  # by the name's place
    blocks: dict[int, tuple[str, str]] = {}  # opener: kind and name of its definition
    text, words = code.text, _KEYWORDS | _OWN_KEYWORDS.get(language, frozenset())
    family = language if language in PATTERNS else ALIKE.get(language, language)
    for pattern, kind in [(re.compile(p, re.M), kind) for p, kind in PATTERNS[family]]:
        for m in pattern.finditer(text):
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            if m.start("name") in found or m["name"] in words:
                continue
            if language in ("ruby", "lua"):
                opener = m.end() - len("function") if m[0].endswith("function") else first
                block, last = _word_block(code, opener, language)
            elif kind == "type_alias" and family == "c" or kind == "const" and family == "rust":
                block, last = -1, _end(code, m.end() - 1 if family == "c" else m.end("name"), language)[1]
            elif kind == "const" and family == "typescript":
                block, last = _end(code, m.end(), language)
            else:
                block, last = _end(code, m.end("name"), language)
            if kind == "function" and language == "swift" and block < 0:
                continue  # a requirement of a protocol
            found[m.start("name")] = (first, last, m["name"], kind)
            if block >= 0:
                blocks[block] = (kind, m["name"])
    if language == "go":
        for m in re.finditer(r"\b(type|const)\s*\(", text):
            for line in re.finditer(r"^[ \t]*(?P<name>[A-Za-z_]\w*)", text[m.end() : code.ends.get(m.end() - 1, m.end())], re.M):
                at = m.end() + line.start("name")
                if at not in found and code.block_at(at) == code.block_at(m.start()) and not _within(code, at, m.end() - 1):
                    found[at] = (at, _end(code, at + len(line["name"]), language)[1], line["name"], m[1])
    holders = _HOLDERS.get(family if family != "c" else language, frozenset())
    if language in ("php", "dart", "kotlin"):
        for at, (first, last, name, kind) in found.items():
            if language == "php" and kind == "function" and blocks.get(code.block_at(first), ("", ""))[0] in holders:
                found[at] = (first, last, name, "method")
    if after := _AFTER.get(language if language in _AFTER else family):
        after = re.compile(after)
        for m in _NAMED.finditer(text):
            close = code.ends.get(m.end() - 1)
            if close is None or m.start("name") in found or m["name"] in words or not (tail := after.match(text, close + 1)):
                continue
            if kind := _member(code, language, m, tail[0], blocks.get(block := code.block_at(m.start())), block, holders):
                opener, last = _end(code, close + 1, language)
                if tail[0].endswith("{"):
                    opener = tail.end() - 1
                    last = code.ends.get(opener, len(text) - 1)
                elif tail[0].endswith("=>"):
                    last = text.find(";", tail.end()) if ";" in text[tail.end() :] else len(text) - 1
                found[m.start("name")] = (_statement(text, m.start()), last, m["name"], kind)
    return sorted(((first, last, at, name, kind) for at, (first, last, name, kind) in found.items()), key=lambda d: (d[0], -d[1]))


def _within(code: Code, place: int, opener: int) -> bool:
    """Whether a bracket other than ``opener`` lies between it and ``place`` unclosed."""
    return any(opener < o < place <= c for o, c in code.ends.items())


def _statement(text: str, at: int) -> int:
    """Where the statement begins that a definition's name stands in."""
    first = max(text.rfind(c, 0, at) for c in ";{}") + 1
    return first + re.match(r"\s*(?:(?:public|private|protected)\s*:(?!:)\s*)*", text[first:at]).end()


def _member(code: Code, language: str, m: re.Match, tail: str, holder: tuple[str, str] | None, block: int, holders: frozenset[str]) -> str | None:
    """The kind of what a name with parameters defines here, None if nothing."""
    before = _BEFORE.search(code.text[max(0, m.start() - 200) : m.start()])
    word, sign = (before[1], before[2]) if before else (None, None)
    if word and language in ("java", "dart") and re.search(r"@(?:\w+\.)*\w+\s*$", code.text[max(0, m.start() - 200) : m.start()]):
        word, sign = None, "@"  # an annotation is no type
    typed = (word and word not in _NOT_A_TYPE) or (sign and sign in ">]?*&" and not re.search(r"[=-]>\s*$", code.text[max(0, m.start() - 20) : m.start()]))
    held = holder is not None and holder[0] in holders
    name = m["name"]
    if language in ("typescript", "tsx"):
        return "method" if not (word in ("function", "new") or sign in (".", ")", "=", "?", ">")) and (held or sign in (None, ",", "{", "}", ";", "*") or word in ("get", "set", "async", "static")) else None
    if language == "c":
        return "function" if typed and block < 0 and word not in ("else", "do") else None
    if language == "cpp":
        if not tail.endswith("{") or not (block < 0 or held or holder and holder[0] == "namespace" or re.search(r"\bextern\s+$", code.text[max(0, block - 20) : block])):
            return None
        if m["tilde"]:
            return "destructor"
        if re.search(r"::\s*$", code.text[max(0, m.start() - 20) : m.start()]):
            return "method"
        return ("method" if held else "function") if typed or held and name == holder[1] else None
    if language == "dart":
        if held and name == holder[1] or word == "new" or not (held or block < 0 and (typed or sign in (None, ";", "}"))) or tail.endswith(";") and not (held and typed):
            return None
        return ("method" if held else "function") if typed or sign in (None, ";", "{", "}") else None
    if not held:
        return None
    if name == holder[1] and not (typed and word not in _MODIFIERS):
        return "constructor" if tail.endswith("{") or tail.endswith("=>") else None
    return "method" if typed and word not in _MODIFIERS else None


_MODIFIERS = frozenset("public private protected internal static final abstract async".split())


def source_symbols(text: str, language: str, annotations: frozenset[str] = frozenset()) -> tuple[list[tuple], list[tuple], list[tuple[int, str]]]:
    """Definitions (name, kind, start, end, signature, doc, qualified name), calls (line, callee, edge kind), and what doesn't fit (line, message)."""
    if ALIKE.get(language, language) not in PATTERNS:
        return [], [], []
    code = code_of(text, language)
    lines, symbols, calls, open_ = text.split("\n"), [], [], []
    defined, words = set(), _KEYWORDS | _OWN_KEYWORDS.get(language, frozenset())
    for first, last, at, name, kind in _definitions(code, language):
        while open_ and open_[-1][0] < first:
            open_.pop()
        open_.append((last, name))
        row = code.line(first)
        defined.add(at)
        symbols.append((name, kind, row, max(row, code.line(last)), lines[row - 1].strip()[:120], doc_above(lines, row - 1), ".".join(n for _, n in open_)))
    for m in _CALL.finditer(code.text):
        dot = (m["dot"] or "").strip()
        if m.start("name") in defined or m["name"] in words or (language in ("java", "csharp", "php", "typescript", "tsx") and re.search(r"\bnew\s+(?:[\w.\\]*[.\\])?$", code.text[max(0, m.start("name") - 60) : m.start("name")])):
            continue
        if dot and (language == "kotlin" and dot == "." or language == "php" and dot == "::") or language == "java" and re.search(r"@\s*(?:\w+\.)*$", code.text[max(0, m.start("name") - 40) : m.start("name")]):
            continue
        calls.append((code.line(m.start("name")), m["name"], "DYNAMIC_IMPORT" if m["name"] == "require" and language != "ruby" else "CALLS"))
    if also := _CALL_ALSO.get(language):
        for m in also.finditer(text if language in ("lua", "ruby") else code.text):  # what follows the name may be a string
            place = m.start("name") if m["name"] else m.start("bare")
            name = m["name"] or m["bare"]
            if language == "kotlin" and re.search(r"\b(?:class|interface|object|fun)\b[^={]*$", code.text[code.text.rfind("\n", 0, place) + 1 : place]):
                continue  # a type before a block
            if place not in defined and name not in words and code.text[place] != " " and not (language == "ruby" and name in _RUBY_WORDS):
                calls.append((code.line(place), name, "CALLS"))
    return symbols, calls + pattern_bridges(text, language, annotations), code.errors


def pattern_symbols(text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    symbols, calls, _ = source_symbols(text, language)
    return symbols, calls


_PARSED = f"what string, {SYMBOL}"


def parsed(files: DataFrame, annotations: Mapping[str, frozenset[str]] | None = None) -> DataFrame:
    """Of ``files`` (path, lang, text) all that one reading gives: ``symbol`` and ``call`` rows, and ``error`` rows. What the Python parser rejects gives nothing else; in other languages an error row tells of what is not closed, or closes nothing.

    ``annotations`` are those that inject besides the usual ones, by language. Each file on its own, nothing is shuffled. Null texts are empty, languages without patterns give nothing.
    """

    more = dict(annotations or {})

    def rows_of(path: str, lang: str | None, text: str | None) -> list[tuple]:
        errors: list[tuple] = []
        try:
            if lang == "python":
                symbols, calls = python_symbols(text or "")
            else:
                symbols, calls, errors = source_symbols(text or "", lang or "", more.get(lang or "", frozenset()))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:  # deep nesting ends in one of the last two
            line = getattr(e, "lineno", None)
            return [("error", path, type(e).__name__, lang, line, line, str(e)[:200], None, None)]
        found = [("symbol", path, *s) for s in symbols] + [("call", path, callee, kind, line, line, None, None, None) for line, callee, kind in calls]
        return found + [("error", path, "SyntaxError", lang, line, line, message, None, None) for line, message in errors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _PARSED.split(", ")]
        kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in _PARSED.split(", ")]
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                rows = [r for x in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True) for r in rows_of(*x)]
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return files.select("path", "lang", "text").mapInArrow(run, _PARSED)


def symbols_in(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'symbol'").select(*[c.split(" ")[0] for c in SYMBOL.split(", ")])


def calls_in(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'call'").select("path", F.col("start_line").alias("line"), F.col("name").alias("callee"), F.col("kind").alias("edge_kind"))


def errors_in(rows: DataFrame) -> DataFrame:
    """(path, lang, error, line, message) of the texts that could not be parsed."""
    return rows.where("what = 'error'").select("path", F.col("kind").alias("lang"), F.col("name").alias("error"), F.col("start_line").alias("line"), F.col("signature").alias("message"))


def symbols_of(files: DataFrame) -> DataFrame:
    """Symbols of ``files`` (path, lang, text)."""
    return symbols_in(parsed(files))


def calls_of(files: DataFrame) -> DataFrame:
    """Call sites of ``files``: (path, line, callee, edge_kind), before names are resolved."""
    return calls_in(parsed(files))
