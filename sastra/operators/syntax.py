"""Calls and the statements around them in ten languages, by a scanner that knows strings, comments, brackets and statement ends.

Grammars aren't part of a standard install, so there is no full tree. What the call rules ask of one is here: each call's callee, its own text, and the text of the
node above it, which is the bracket that the call stands in, or else its statement, over as many lines as those take. Nothing in a comment or a string is a call.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

# Words before a bracket that call nothing, and words that begin a definition.
NOT_CALLS = frozenset("if for while switch catch return elif else and or not in is when match until unless foreach using lock fixed sizeof typeof await yield throw raise assert_ with del lambda except from import case".split())
DEFINES = frozenset("def func function fn fun class struct interface impl constructor".split())
_NAME = r"[A-Za-z_$][\w$]*"
_LINK = r"\s*(?:\?\.|\.|::|->)\s*"
#: Languages whose comments begin with '#', and whose statements end with the line.
HASH, BY_LINE = frozenset(("python", "ruby", "php")), frozenset(("python", "ruby", "go", "kotlin", "javascript", "typescript"))
#: A line that ends or a next line that begins like this goes on.
_GOES_ON = re.compile(r"(?:[-+*/%=&|<>,.?:\\]|\band|\bor|\bnot)\s*$")
_CONTINUES = re.compile(r"(?:\?\.|\.(?=[A-Za-z_])|::|->|&&|\|\||[)\]])")


def _tokens(language: str) -> re.Pattern:
    comment = r"#[^\n]*|" if language in HASH else ""
    comment += "" if language in ("python", "ruby") else r"//[^\n]*|/\*.*?(?:\*/|\Z)|"
    string = r'"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)|' if language in ("python", "kotlin") else ""
    string += r"`[^`]*`|" if language in ("go", "javascript", "typescript") else ""
    string += r"'(?:\\.[^'\n]*|[^'\\\n])'|" if language == "rust" else r"'(?:\\.|[^'\\\n])*'?|"
    string += r'"(?:\\.|[^"\\])*(?:"|\Z)' if language in ("php", "rust", "ruby") else r'"(?:\\.|[^"\\\n])*"?'
    bare = r"\b(?:include|require)(?:_once)?\b(?!\s*\()|" if language == "php" else r"\bunsafe\s*\{|" if language == "rust" else ""
    head = rf"(?>(?:(?:\?\.|\.|::|->)\s*)?@?{_NAME}(?:{_LINK}{_NAME})*)"
    return re.compile(rf"(?P<comment>{comment}(?!))|(?P<string>{string})|(?P<bare>{bare}(?!))|(?P<call>{head}(?:\s*\()?)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<semi>;)|(?P<line>\n\s*)", re.S)


@dataclass
class Span:
    start: int
    end: int = -1
    kind: str = ""
    #: Of a bracket: the statement it stands in and, if a call opened it, where the called expression begins.
    outer: Span | None = None
    begins: int = -1


@dataclass
class Call:
    start: int
    callee: str
    own: Span
    above: Span
    bare: bool = False


@dataclass
class Scan:
    code: str
    calls: list[Call] = field(default_factory=list)
    statements: list[Span] = field(default_factory=list)
    unsafe: list[int] = field(default_factory=list)

    def __post_init__(self):
        self._lines = [0, *(m.end() for m in re.finditer("\n", self.code))]

    def place(self, at: int) -> tuple[int, int]:
        """Line and column from 1."""
        line = bisect_right(self._lines, at)
        return line, at - self._lines[line - 1] + 1

    def text(self, span: Span, start: int | None = None) -> str:
        return self.code[span.start if start is None else start : span.end]


_made: dict[str, re.Pattern] = {}


def scan(code: str, language: str) -> Scan:
    """Every call of a text with its callee and the spans of itself and of the node above it. Broken code is taken as it comes: open brackets end with the text."""
    pattern = _made.setdefault(language, _tokens(language))
    out = Scan(code)
    statement = Span(0)
    out.statements.append(statement)
    stack: list[Span] = []
    depth = dict.fromkeys("([{", 0)
    word = ""
    closed: tuple[int, int] | None = None  # where the called expression began whose bracket closed last, and where it closed

    def new_statement(at: int) -> Span:
        statement.end = at
        out.statements.append(Span(at))
        return out.statements[-1]

    def open_bracket(mark: str, at: int, begins: int = -1) -> Span:
        depth[mark] += 1
        stack.append(Span(at, kind=mark, outer=statement, begins=begins))
        return stack[-1]

    def above() -> Span:
        return stack[-1] if stack and stack[-1].kind in "([" else statement

    for m in pattern.finditer(code):
        kind, at = m.lastgroup, m.start()
        if statement.kind == "" and kind not in ("comment", "line"):  # a statement begins with its first token
            statement.start, statement.kind = at, "statement"
        if kind == "call" and m[0][-1] != "(":
            word = re.split(_LINK, m[0])[-1]
        elif kind == "call":
            head = m[0][:-1].rstrip()
            linked = re.match(_LINK, head)
            begins = at
            if linked and closed and not code[closed[1] : at].strip():
                begins = closed[0]
            elif linked:
                begins = at + linked.end()
            name, previous = head[linked.end() :] if linked else head, word
            declared = previous in DEFINES or (not linked and language in ("java", "csharp") and previous not in NOT_CALLS | {"", "new", "do"} and code[at - 1 : at] in (" ", "\t"))
            is_call = not declared and re.split(_LINK, name)[-1].lstrip("@") not in NOT_CALLS | DEFINES
            outer = above()
            own = open_bracket("(", m.end() - 1, begins if is_call else -1)
            if is_call:
                out.calls.append(Call(begins, re.sub(r"\s+", "", code[begins:at] + head) if linked and begins != at + linked.end() else re.sub(r"\s+", "", name), own, outer))
            word = ""
        elif kind == "bare":
            if m[0][-1] == "{":
                out.unsafe.append(at)
                open_bracket("{", m.end() - 1)
                statement = new_statement(m.end())
            else:
                out.calls.append(Call(at, m[0], statement, statement, bare=True))
            word = ""
        elif kind == "open":
            open_bracket(m[0], at)
            if m[0] == "{":
                statement = new_statement(m.end())
            word = ""
        elif kind == "close":
            wanted = {")": "(", "]": "[", "}": "{"}[m[0]]
            if depth[wanted]:
                while True:
                    span = stack.pop()
                    depth[span.kind] -= 1
                    span.end = m.end()
                    if span.kind == wanted:
                        break
                if wanted == "{":
                    statement.end = at
                    statement = span.outer if stack and stack[-1].kind in "([" else new_statement(m.end())
                closed = (span.begins if span.begins >= 0 else span.start, m.end())
            word = ""
        elif kind == "semi":
            if not (stack and stack[-1].kind in "(["):
                statement = new_statement(m.end())
            word = ""
        elif kind == "line" and language in BY_LINE and not (stack and stack[-1].kind in "(["):
            if not _GOES_ON.search(code, max(statement.start, at - 20), at) and not _CONTINUES.match(code, m.end()):
                statement = new_statement(m.end())
            word = ""
    for span in (statement, *stack, *out.statements):
        if span.end < 0:
            span.end = len(code)
    if language == "ruby":
        _bare_ruby(out)
    return out


_COMMAND = re.compile(r"""\s*([A-Za-z_][\w.:]*[?!]?)[ \t]+(?=["'A-Za-z_@:\[])(?!=|(?:if|unless|do|and|or|in)\b)""")


def _bare_ruby(out: Scan) -> None:
    """Ruby calls without brackets: a statement that begins with a name and an argument."""
    for s in out.statements:
        m = _COMMAND.match(out.code, s.start, s.end)
        if m and m[1].split(".")[-1] not in NOT_CALLS | DEFINES | {"module", "end", "begin", "require", "attr_accessor", "then", "puts"}:
            out.calls.append(Call(m.start(1), m[1], s, s, bare=True))
