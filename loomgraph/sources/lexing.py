"""What of a source text is code, and which brackets and blocks belong together.

One expression for each language finds comments, strings and the like; they are
overwritten with spaces, so that every place keeps its line and column.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_LINE, _HASH, _BLOCK = r"//[^\n]*", r"#[^\n]*", r"/\*(?s:.*?)\*/"
_DOUBLE, _SINGLE = r'"(?:\\(?s:.)|[^"\\\n])*"', r"'(?:\\(?s:.)|[^'\\\n])*'"
_LONG_DOUBLE, _LONG_SINGLE = r'"(?:\\(?s:.)|[^"\\])*"', r"'(?:\\(?s:.)|[^'\\])*'"
_TRIPLE = r'"""(?s:.*?)"""'
_DIRECTIVE = r"^[ \t]*\#(?:\\\n|[^\n])*"
_TEMPLATE = r"`(?:\\(?s:.)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`"
#: A slash begins an expression where no value ends before it.
_REGEX = r"(?P<before>(?:^|[=(,:;!&|?{}\[+\n]|\b(?:return|typeof|case))[ \t]*)(?P<regex>/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)"
#: Literals between brackets, which may hold a pair of the same kind.
_PERCENT = "%[wWiIqQrsx]?(?:" + "|".join(rf"\{a}(?:\\(?s:.)|[^\{a}\{b}\\]|\{a}[^\{a}\{b}]*\{b})*\{b}" for a, b in ("()", "[]", "{}", "<>")) + r"|\|[^|\n]*\|)"
#: An opener that nothing closes, tried last; what follows is no code.
_OPEN = r"(?P<open>{})(?s:.*)"

#: What is no code, in the order it is tried.
_NO_CODE: dict[str, list[str]] = {
    "rust": [_LINE, _BLOCK, r'\bb?r(?P<hashes>\#*)"(?s:.*?)"(?P=hashes)', r"\bb?" + _LONG_DOUBLE, _LONG_DOUBLE, r"b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^'\\\n])'", _OPEN.format(r'/\*|"')],
    "typescript": [_LINE, _BLOCK, _TEMPLATE, _DOUBLE, _SINGLE, _REGEX, _OPEN.format(r"/\*|`")],
    "go": [_LINE, _BLOCK, r"`[^`]*`", _DOUBLE, _SINGLE, _OPEN.format(r'/\*|`|"')],
    "c": [_LINE, _BLOCK, _DIRECTIVE, r'\bR"(?P<mark>[^(\s]*)\((?s:.*?)\)(?P=mark)"', _DOUBLE, r"(?<![0-9a-fA-F])" + _SINGLE, _OPEN.format(r'/\*|"')],
    "java": [_LINE, _BLOCK, _TRIPLE, _DOUBLE, _SINGLE, _OPEN.format(r'/\*|"')],
    "csharp": [_LINE, _BLOCK, _DIRECTIVE, r'\$*"""(?s:.*?)"""', r'(?:\$@|@\$?)"(?:""|[^"])*"', _DOUBLE, _SINGLE, _OPEN.format(r'/\*|"')],
    "ruby": [r"^=begin\b(?s:.*?)^=end\b[^\n]*", r"^__END__$(?s:.*)", r"<<[~-]?(?P<quote>['\"]?)(?P<word>[A-Za-z_]\w*)(?P=quote)[^\n]*\n(?s:.*?)^[ \t]*(?P=word)$", r"(?<![\w$])\#[^\n]*", _LONG_DOUBLE, _LONG_SINGLE, r"`[^`]*`",
        _PERCENT, r"(?<=[=(,~\s])/(?![\s=])(?:\\.|[^/\\\n])+/[a-z]*", _OPEN.format(r"^=begin\b|[\"']")],
    "php": [r"\?>(?s:.*?)(?:<\?(?:php\b|=)|\Z)", _LINE, r"\#(?!\[)[^\n]*", _BLOCK, r"<<<[ \t]*(?P<quote>['\"]?)(?P<word>[A-Za-z_]\w*)(?P=quote)\n(?s:.*?)^[ \t]*(?P=word)\b", _LONG_DOUBLE, _LONG_SINGLE, _OPEN.format(r"/\*|[\"']")],
    "kotlin": [_LINE, _BLOCK, _TRIPLE, _DOUBLE, r"'(?:\\(?:u....|.)|[^'\\\n])'", r"`[^`\n]*`", _OPEN.format(r'/\*|"')],
    "swift": [_LINE, _BLOCK, r'(?P<hashes>\#+)"(?s:.*?)"(?P=hashes)', _TRIPLE, _DOUBLE, _OPEN.format(r'/\*|"')],
    "dart": [_LINE, _BLOCK, r"r'[^'\n]*'", r'r"[^"\n]*"', _TRIPLE, r"'''(?s:.*?)'''", _DOUBLE, _SINGLE, _OPEN.format(r"/\*|[\"']")],
    "lua": [r"--\[(?P<level>=*)\[(?s:.*?)\](?P=level)\]", r"\[(?P<long>=*)\[(?s:.*?)\](?P=long)\]", r"--(?!\[=*\[)[^\n]*", _DOUBLE, _SINGLE, _OPEN.format(r"--\[=*\[|\[=*\[|[\"']")],
}
ALIKE = {"tsx": "typescript", "cpp": "c"}
_EXPRESSIONS = {k: re.compile("|".join(f"(?:{p})" for p in v), re.M) for k, v in _NO_CODE.items()}
_NESTING = frozenset(("rust", "kotlin", "swift", "dart"))  # comments within comments
_NESTED = re.compile(r"/\*|\*/")
_WORDS_OPEN = {
    "ruby": re.compile(r"\b(?P<begin>class|module|def|do|begin|case|if|unless|while|until|for)\b(?![?!:=])|(?<![.\w:])(?P<end>end)\b(?![?!:])"),
    "lua": re.compile(r"\b(?P<begin>function|do|then|repeat)\b|\b(?P<end>end|until|elseif)\b"),
}
_CLOSES = {")": "(", "]": "[", "}": "{"}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


@dataclass
class Code:
    """A text's code, with where its brackets and blocks end."""

    text: str
    errors: list[tuple[int, str]] = field(default_factory=list)  # line, what
    ends: dict[int, int] = field(default_factory=dict)  # place of an opener: place of what closes it
    around: list[tuple[int, int]] = field(default_factory=list)  # (from here on, opener of the innermost block or -1), in order

    def line(self, place: int) -> int:
        return bisect_right(self._lines, place)

    def __post_init__(self):
        self._lines = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def block_at(self, place: int) -> int:
        """The opener of the innermost block around a place, -1 outside of all."""
        at = bisect_right(self.around, (place, len(self.text))) - 1
        return self.around[at][1] if at >= 0 else -1


def code_of(text: str, language: str) -> Code:
    """A text without what is no code, its brackets matched; what doesn't close, or closes nothing, is an error."""
    family = ALIKE.get(language, language)
    if family == "php" and text:
        head = re.match(r"(?s).*?<\?(?:php\b|=)", text)
        text = _blank(head[0]) + text[head.end() :] if head else _blank(text)
    out, at, errors = [], 0, []
    expression, nesting = _EXPRESSIONS[family], family in _NESTING
    while m := expression.search(text, at):
        groups, first, last = m.groupdict(), m.start(), max(m.end(), m.start() + 1)
        if nesting and m[0].startswith("/*"):
            depth = 0
            for edge in _NESTED.finditer(text, first):
                depth += 1 if edge[0] == "/*" else -1
                if not depth:
                    last = edge.end()
                    break
            else:
                last, groups["open"] = len(text), "/*"
        if groups.get("open"):
            errors.append((text.count("\n", 0, first) + 1, f"{groups['open'].strip()} is not closed"))
        if groups.get("regex"):
            first = m.start("regex")
        out.append(text[at:first])
        if family == "ruby" and not m[0].startswith(("#", "=begin", "__END__")):  # that a value is here decides what an if after it is
            out.append("0")
            first += 1
        out.append(_template(m[0], language) if m[0][:1] == "`" and family == "typescript" else _blank(text[first:last]))
        at = last
    out.append(text[at:])
    code = Code("".join(out), errors)
    _match(code, family)
    return code


def _template(text: str, language: str) -> str:
    """A template string as blanks, but for the code within it."""
    return re.sub(r"\$\{((?:[^{}`]|\{[^{}]*\}|`[^`]*`)*)\}|[^\n]", lambda m: f"({code_of(m[1], language).text} )" if m[1] is not None else " ", text)


def _match(code: Code, family: str) -> None:
    words = _WORDS_OPEN.get(family)
    tokens = [(m.start(), m[0]) for m in re.finditer(r"[(){}\[\]]", code.text)]
    if words:
        tokens += [(m.start(), m[0]) for m in words.finditer(code.text) if _opens(code.text, m, family)]
        tokens.sort()
    stack: list[tuple[int, str]] = []

    def close(place: int) -> None:
        code.ends[stack.pop()[0]] = place

    def inner() -> int:
        return next((p for p, t in reversed(stack) if t not in "(["), -1)

    code.around.append((0, -1))
    for place, token in tokens:
        if token in _CLOSES:
            wanted = _CLOSES[token]
        elif token in ("end", "until"):
            wanted = "word"
        elif token == "elseif":
            if stack and stack[-1][1] == "word":
                close(place)
            continue
        else:
            stack.append((place, token if token in "([{" else "word"))
            if token not in "([":
                code.around.append((place + 1, place))
            continue
        if stack and stack[-1][1] == wanted:
            close(place)
        elif any(t == wanted for _, t in stack):
            while stack[-1][1] != wanted:
                code.errors.append((code.line(stack[-1][0]), f"{code.text[stack[-1][0]]} is not closed"))
                close(place)
            close(place)
        else:
            code.errors.append((code.line(place), f"{token} closes nothing"))
            continue
        code.around.append((place + 1, inner()))
    while stack:
        code.errors.append((code.line(stack[-1][0]), f"{code.text[stack[-1][0] :].split(None, 1)[0][:20]} is not closed"))
        close(len(code.text.rstrip()) - 1)


def _opens(text: str, m: re.Match, family: str) -> bool:
    """Whether a word begins or ends a block here: modifiers after a statement, names after a dot and symbols don't."""
    word, before = m[0], text[: m.start()][-80:].rpartition("\n")[2]
    if family == "lua" or word == "end":
        return True
    if before.rstrip(" \t").endswith((".", ":")) and not before.endswith("::"):
        return False
    if word in ("if", "unless", "while", "until"):  # a modifier has a statement before it
        return re.search(r"(?:^|[=({\[,;|&!]|\b(?:then|do|else|and|or|not|return))\s*$", before) is not None
    if word == "do":  # the one of a loop belongs to the loop's own word
        return re.match(r"\s*(?:while|until|for)\b", text[text.rfind("\n", 0, m.start()) + 1 : m.start()]) is None
    if word == "def":  # without an end: def name(...) = value
        return re.match(r"def\s+[\w.]+[?!]?(?:\([^()\n]*\)\s*|\s+)=(?![=~>])", text[m.start() : m.start() + 300]) is None
    if word == "class":
        return not before.rstrip().endswith(".")
    return True
