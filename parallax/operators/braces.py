"""Trees of source files in languages with braces, by islands: what opens a brace or ends a statement decides its node.

One pass of a lexer (comments, strings, templates, directives left whole) feeds a stack of open brackets. Statements become leaves
with their calls, names and literals below; heads before a brace become classes, functions, control nodes or blocks. What no rule
knows stays an expression, so that every text has a tree. Nodes are nested lists [type, kind, text, line, children, end line, attributes].
"""

from __future__ import annotations

import re
from collections.abc import Iterator

LANGUAGES = ("Java", "C", "Cpp", "Go", "JavaScript", "TypeScript", "PHP", "Swift")
#: Languages in which the end of a line may end a statement.
_LINES = frozenset(("Go", "JavaScript", "TypeScript", "Swift"))
_STRINGS = {"Go": r"`[^`]*`", "JavaScript": r"`(?:\\.|[^`\\])*`", "TypeScript": r"`(?:\\.|[^`\\])*`", "Cpp": r'R"(?P<mark>[^()\\ ]{0,16})\(.*?\)(?P=mark)"', "Swift": r'"""(?:\\.|[^\\])*?"""', "Java": r'"""(?:\\.|[^\\])*?"""'}
_COMMENTS = {"PHP": r"|\#(?!\[)[^\n]*|\A.*?<\?(?:php\b|=)?|\?>.*?(?:<\?(?:php\b|=)?|\Z)", "C": r"|^[ \t]*\#(?:\\\n|[^\n])*", "Cpp": r"|^[ \t]*\#(?:\\\n|[^\n])*"}
_PATTERN = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_TOKEN = r"""|(?P<name>[@$]?[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<text>STRINGS"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<line>\n)|(?P<sign>=>|->|::|:=|\+\+|--|&&|\|\||<<=|>>=|[=!<>+\-*/%&|^]=|==|\.\.\.|[^\s\w])"""
_PATTERN_SIGN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
CONTROL = {"if": "IfStatement", "guard": "IfStatement", "for": "ForLoop", "foreach": "ForLoop", "while": "WhileLoop", "do": "WhileLoop", "repeat": "WhileLoop", "switch": "SwitchStatement", "select": "SwitchStatement", "match": "SwitchStatement", "try": "TryStatement", "else": "Block", "catch": "Block", "finally": "Block", "defer": "Block", "synchronized": "Block", "namespace": "Module", "unsafe": "Block", "case": "CaseStatement", "default": "CaseStatement"}
TYPES = {"class": "Class", "struct": "Class", "enum": "Class", "union": "Class", "record": "Class", "trait": "Interface", "interface": "Interface", "protocol": "Interface", "extension": "Class"}
MODIFIERS = frozenset(("public", "private", "protected", "internal", "fileprivate", "open", "static", "final", "abstract", "virtual", "inline", "const", "override", "async", "export", "default", "synchronized", "native", "extern", "mutating", "readonly", "constexpr", "explicit", "friend", "let", "var"))
VISIBLE = ("public", "private", "protected", "internal", "fileprivate", "open")
_FUNCTION = frozenset(("func", "function", "fn", "init", "deinit"))
_NO_NAMES = frozenset(("async", "await", "export", "default", "static", "const", "let", "var", "throws"))
_AFTER = frozenset((",", ".", "=", "+", "-", "*", "&&", "||", "?", ":", "=>", "->", "::", ":=", "&", "|", "<", "==", "!=", "+=", "-="))
_BINARY = frozenset(("+", "-", "*", "/", "%", "==", "!=", "<=", ">=", "<", ">", "&&", "||", "&", "|", "^"))
_TEXT = 200
_lexers: dict[str, re.Pattern] = {}
Token = tuple[str, str, int]


def tokens(source: str, language: str) -> list[Token]:
    """(kind, text, line): name, number, text, sign, import (a directive that includes a file) and, where it may count, line."""
    if language not in _lexers:
        strings = _STRINGS.get(language, "")
        _lexers[language] = re.compile(_PATTERN + _COMMENTS.get(language, "") + _TOKEN.replace("STRINGS", strings + "|" if strings else ""), re.S | re.M)
    scan, out, at, line = _lexers[language], [], 0, 1
    regular = language in ("JavaScript", "TypeScript")
    while m := scan.search(source, at):
        line += source.count("\n", at, m.start())
        kind, text = m.lastgroup, m[0]
        if regular and text[0] == "/" and kind == "sign" and (not out or out[-1][0] in ("sign", "line") and out[-1][1] not in (")", "]", "}") or out[-1][1] == "return") and (r := _PATTERN_SIGN.match(source, m.start())):
            kind, text, at = "text", r[0], r.end()
        else:
            at = m.end()
        if kind == "mark":
            kind = "text"
        if kind == "line":
            if language in _LINES and out and out[-1][0] != "line":
                out.append(("line", "\n", line))
        elif kind:
            out.append((kind, text, line))
        elif text.lstrip().startswith("#") and "include" in text[:12] and language in ("C", "Cpp"):
            out.append(("import", text.split("include", 1)[1].strip().strip('<>"'), line))
        line += text.count("\n")
    return out


def _expression(head: list[Token]) -> list[list]:
    """Calls with their arguments, names, literals and binary signs of a run of tokens."""
    root: list[list] = []
    levels = [root]
    for k, (kind, text, line) in enumerate(head):
        if kind == "name" and not text.startswith("@"):
            if k + 1 < len(head) and head[k + 1][1] == "(" and text not in CONTROL and text not in _FUNCTION and text not in ("return", "new", "throw", "sizeof"):
                dotted, j = text, k
                while j >= 2 and head[j - 1][1] in (".", "::", "->") and head[j - 2][0] == "name":
                    dotted, j = head[j - 2][1] + head[j - 1][1] + dotted, j - 2
                levels[-1].append(["CallExpression", "call", dotted[:_TEXT], line, [], line, {"function_name": dotted[:_TEXT]}])
            elif text not in MODIFIERS and text not in CONTROL:
                levels[-1].append(["Identifier", "identifier", text[:_TEXT], line, [], line, {}])
        elif kind in ("number", "text"):
            levels[-1].append(["Literal", kind, text[:_TEXT], line, [], line, {}])
        elif text in "([":
            own = levels[-1]
            call = text == "(" and own and own[-1][0] == "CallExpression" and k and head[k - 1][1] == own[-1][2].rsplit(".", 1)[-1].rsplit(":", 1)[-1].rsplit(">", 1)[-1]
            levels.append(own[-1][4] if call else own)
        elif text in ")]":
            if len(levels) > 1:
                levels.pop()
        elif text in _BINARY:
            levels[-1].append(["BinaryExpression", text, text, line, [], line, {}])
    return root


def _plain(head: list[Token]) -> str:
    """Tokens as text, with blanks only between words."""
    out = ""
    for kind, text, _ in head:
        out += (" " if out and (out[-1].isalnum() or out[-1] in "_>*&]?") and (text[0].isalnum() or text[0] in "_$@") else "") + text
    return out


def _parts(head: list[Token], close: str = ")") -> tuple[list[str], int]:
    """Texts between commas from an opening bracket on, and the place of the closing one."""
    depth, angle, parts, now = 0, 0, [], []
    for k, t in enumerate(head):
        depth += (t[1] in "([{") - (t[1] in ")]}")
        angle = max(0, angle + (t[1] == "<") - (t[1] == ">"))
        if depth == 0:
            return [p for p in (*parts, _plain(now)) if p], k
        if t[1] == "," and depth == 1 and not angle:
            parts, now = [*parts, _plain(now)], []
        elif k:
            now.append(t)
    return [p for p in (*parts, _plain(now)) if p], len(head) - 1


def _class(head: list[Token], at: int, name: int) -> list:
    """A type by its word's place in the head and its name's."""
    words = [t[1] for t in head]
    rest, attrs = head[name + 1 :], {"modifiers": " ".join(w for w in words[:at] if w in MODIFIERS), "annotations": " ".join(w for w in words[:at] if w.startswith("@"))}
    if rest and rest[0][1] == "<":
        end = next((k for k, t in enumerate(rest) if t[1] == ">"), len(rest) - 1)
        attrs["generics"], rest = _plain(rest[: end + 1]), rest[end + 1 :]
    groups: dict[str, list[Token]] = {"": []}
    mode = ""
    for t in rest:
        if t[1] in ("extends", "implements", ":"):
            mode = t[1]
        else:
            groups.setdefault(mode, []).append(t)
    split = lambda m: _parts([("sign", "(", 0), *groups.get(m, []), ("sign", ")", 0)])[0]
    bases = [re.sub(r"^(?:public|private|protected|virtual) ", "", b) for b in split(":")] + split("extends")
    attrs |= {"superclass": bases[0] if bases and words[at] != "interface" else "", "interfaces": ",".join([*bases[words[at] != "interface" :], *split("implements")])}
    visible = [w for w in VISIBLE if w in words[:at]]
    return [TYPES[words[at]], words[at], head[name][1] if name < len(head) else "", head[0][2], [], head[0][2], {k: v for k, v in (attrs | {"visibility": visible[0] if visible else ""}).items() if v}]


def _function(head: list[Token], language: str, inside: str) -> list | None:
    """A function by its head, if it is one: a name with parameters, or an arrow or function word with neither."""
    words, depth, at = [t[1] for t in head], 0, None
    marked = next((k for k, w in enumerate(words) if w in _FUNCTION), None)
    first = 0 if marked is None else marked
    if language == "Go" and marked is not None and words[marked + 1 : marked + 2] == ["("]:
        first = marked + 2 + _parts(head[marked + 1 :])[1]  # past the receiver
    for k in range(first, len(head)):
        if words[k] == "(" and depth == 0 and at is None and (k and (head[k - 1][0] == "name" and words[k - 1] not in CONTROL or words[k - 1] == ">") or marked is not None or "=>" in words):
            at = k
        depth += (words[k] in "([") - (words[k] in ")]")
    arrow = "=>" in words
    if at is None and not (arrow or marked is not None):
        return None
    equals = next((k for k, w in enumerate(words) if w in ("=", ":", ":=") and (at is None or k < at)), None)
    if marked is None and not arrow and (equals is not None and words[equals] != ":" or "new" in words or "return" in words):
        return None
    name, generics, before = "", "", at if at is not None else len(head)
    if at is not None and words[at - 1] == ">":
        before = max((k for k in range(at) if words[k] == "<"), default=at)
        generics = _plain(head[before:at])
    if before > first and head[before - 1][0] == "name" and words[before - 1] not in _FUNCTION - {"init", "deinit"} and words[before - 1] not in _NO_NAMES:
        name = words[before - 1]
        if before > 1 and words[before - 2] == "~":
            name, before = "~" + name, before - 1
    elif equals is not None and equals and head[equals - 1][0] == "name":
        name = words[equals - 1]
    params, end = _parts(head[at:]) if at is not None else ([], -1)
    params = [p for p in params if p != "void"]
    after = head[at + end + 1 :] if at is not None else []
    tail = [t for t in after if t[1] not in ("->", ":", "=>")]
    stop = next((k for k, t in enumerate(tail) if t[1] in ("throws", "where", "const", "override", "noexcept", "async", "final")), len(tail))
    front = [t for t in head[: before - 1] if t[1] not in MODIFIERS and not t[1].startswith("@") and t[1] not in _FUNCTION] if marked is None and not arrow else []
    front = front[1:] if front and front[0][1] == "template" else front
    if front and front[0][1] == "<":
        close = next((k for k, t in enumerate(front) if t[1] == ">"), len(front) - 1)
        generics, front = _plain(front[: close + 1]), front[close + 1 :]
    while len(front) >= 2 and front[-1][1] == "::":  # the class of a member that is defined outside
        front = front[:-2]
    returns = _plain(front) if front else _plain(tail[:stop]) if after and after[0][1] not in ("=>",) and (language in ("Go",) or after[0][1] in ("->", ":")) and not (language == "Cpp" and after[0][1] == ":") else ""
    mods = [w for w in words[: before - (name != "")] if w in MODIFIERS - {"let", "var", "const"}]
    visible = [w for w in VISIBLE if w in mods]
    attrs = {"params": "\n".join(params), "param_count": str(len(params)), "return_type": returns, "modifiers": " ".join(mods), "generics": generics, "visibility": visible[0] if visible else "", "annotations": " ".join(w for w in words[:before] if w.startswith("@"))}
    return ["Method" if inside in ("Class", "Interface") else "Function", "function", name[:_TEXT], head[0][2], [], head[0][2], {k: v for k, v in attrs.items() if v}]


def _opened(head: list[Token], language: str, inside: str) -> tuple[list, bool]:
    """The node that a brace after a head opens, and whether the head belongs to it."""
    words = [t[1] for t in head]
    depth, flat = 0, []
    for k, w in enumerate(words):
        depth -= w in (")", "]")
        if depth == 0:
            flat.append(k)
        depth += w in ("(", "[")
    line = head[0][2] if head else 0
    if not head:
        return ["Block", "block", "", line, [], line, {}], True
    first = next((w for w in words if not w.startswith("@")), "")
    second = words[1] if len(words) > 1 else ""
    if first in CONTROL and not (first in ("default", "case") and any(w in TYPES for w in words)):
        kind = CONTROL["if"] if first == "else" and second == "if" else CONTROL[first]
        rest = head[2:] if first == "else" and second == "if" else head[1:]
        return [kind, first, second if kind == "Module" else "", line, _expression(head[1:]), line, {"condition": _plain(rest)[:_TEXT]} if kind == "IfStatement" and rest else {}], True
    types = [k for k in flat if words[k] in TYPES and head[k][0] == "name"]
    if types and "(" not in words[: types[0]] and "=" not in words[: types[0]]:
        at = types[0]
        at = types[1] if len(types) > 1 and types[1] == at + 1 else at  # enum class
        name = at - 1 if language == "Go" and at and words[0] == "type" else at + 1
        return _class(head, at, name), True
    if language == "Go" and words[0] == "type":
        return ["Class", "type", second, line, [], line, {}], True
    if depth == 0 and (found := _function(head, language, inside)):
        return found, True
    if depth > 0:  # within a call: a function without a name, or a value
        start = max(k for k, w in enumerate(words) if w in ("(", "[", ","))
        own = head[start + 1 :]
        for k in range(len(head)):
            if words[k] in _FUNCTION or words[k] == "=>":
                own = head[k:] if words[k] in _FUNCTION else own
        found = _function(own, language, "") if own and any(t[1] in _FUNCTION or t[1] == "=>" for t in own) else None
        return found or ["Block", "value", "", line, [], line, {}], False
    return ["Block", "value", "", line, [], line, {}], False


def _statement(head: list[Token], inside: str, language: str) -> list | None:
    """A leaf for a statement, with what it holds."""
    words = [t[1] for t in head]
    if not words:
        return None
    line, end, first = head[0][2], head[-1][2], words[0]
    if head[0][0] == "import" or first in ("import", "include", "require", "use", "using", "package"):
        return ["ImportDeclaration", first if head[0][0] != "import" else "include", (words[0] if head[0][0] == "import" else _plain(head[1:]))[:_TEXT], line, [], end, {}]
    inner = _expression(head[first in ("return", "throw", "case", "default") :])
    if inside in ("Class", "Interface") and "(" in words and "=" not in words and (found := _function(head, language, inside)) and found[2] and (found[6].get("return_type") or inside == "Interface"):
        return [*found[:5], end, found[6]]
    kind = {"return": "ReturnStatement", "throw": "ThrowStatement", "case": "CaseStatement", "default": "CaseStatement"}.get(first)
    if not kind and "=" not in words and ":=" not in words and inside in ("Class", "Interface") and "(" not in words:
        named = [t[1] for t in head if t[0] == "name" and t[1] not in MODIFIERS]
        return ["FieldDeclaration", "field", (named[0 if language in ("Go", "Swift", "TypeScript") else -1] if named else "")[:_TEXT], line, [], end, {"type": _plain(head)[:_TEXT]}]
    if not kind and any(w in ("=", ":=", "+=", "-=", "*=", "/=") for w in words):
        at = next(k for k, w in enumerate(words) if w in ("=", ":=", "+=", "-=", "*=", "/="))
        declares = first in ("let", "var", "const", "auto") or words[at] == ":=" or at >= 2 and head[at - 1][0] == head[at - 2][0] == "name"
        kind = "FieldDeclaration" if inside in ("Class", "Interface") else "VariableDeclaration" if declares else "AssignmentExpression"
        return [kind, words[at], next((t[1] for t in reversed(head[:at]) if t[0] == "name"), ""), line, inner, end, {"type": _plain(head[:at])[:_TEXT]}]
    return [kind or "ExpressionStatement", first if kind else "expression", "", line, inner, end, {}]


def tree(source: str, language: str) -> list:
    """The nested tree of a file."""
    own = tokens(source, language)
    root = ["Program", "program", "", 1, [], source.count("\n") + 1, {}]
    # Of each open brace: its node, the head that goes on after it, and how many other brackets were open.
    stack: list[tuple[list, list[Token], int]] = [(root, [], 0)]
    head: list[Token] = []
    depth = 0

    def end_statement() -> None:
        nonlocal head
        node = _statement(head, stack[-1][0][0], language)
        if node:
            stack[-1][0][4].append(node)
        head = []

    for k, token in enumerate(own):
        kind, text, line = token
        if text == "{" and kind == "sign":
            node, whole = _opened(head, language, stack[-1][0][0])
            node[3] = node[3] or line
            stack[-1][0][4].append(node)
            stack.append((node, [] if whole else head, 0 if whole else depth))
            head, depth = [], 0
        elif text == "}" and kind == "sign":
            end_statement()
            if len(stack) > 1:
                node, head, depth = stack.pop()
                node[5] = line
                if head:
                    head = [*head, ("text", "{}", line)]  # stands for what was in braces
            else:
                depth = 0
        elif kind == "line":
            follows = own[k + 1][1] if k + 1 < len(own) else ""
            if depth == 0 and head and head[-1][1] not in _AFTER and follows not in (".", "{", "?", ":", "&&", "||", "=>") and head[-1][1] not in ("else", "try", "do"):
                end_statement()
        elif kind == "import" or text == ";" and depth == 0 and not (language == "Go" and head and head[0][1] in CONTROL):
            head += [token] if kind == "import" else []
            end_statement()
        elif text == ":" and depth == 0 and head and head[0][1] in ("case", "default", *VISIBLE) and len(head) < 40 and (head[0][1] == "case" or len(head) == 1):
            if head[0][1] in VISIBLE:
                head = []
            else:
                end_statement()
        else:
            if kind == "sign":
                depth = max(0, depth + (text in "([") - (text in ")]"))
            head.append(token)
    end_statement()
    for node, _, _ in stack[1:]:
        node[5] = root[5]
    return root


def walk(root: list) -> Iterator[tuple[list, tuple[list, ...]]]:
    """Nodes in pre-order, each with those around it."""
    todo: list[tuple[list, tuple[list, ...]]] = [(root, ())]
    while todo:
        node, around = todo.pop()
        yield node, around
        todo += [(c, (*around, node)) for c in reversed(node[4])]
