"""Scripts as terminals of ``granary.scripts.grammar``.

What a mark means depends on what stands around it: a slash divides or begins a regular expression, a brace opens a
block, an object or a class, a parenthesis may turn out to be an arrow function's.  The lexer keeps a stack of open
brackets and decides from it and from the token before; what only a later token tells (``=>``) is put right when it comes.
"""

from __future__ import annotations

import re
from bisect import bisect_left

_SKIP = re.compile(r"(?:[ \t\v\f\r\n\u00a0\ufeff\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)+")
_WORD = re.compile(r"(?:[^\W\d]|[$\u200c\u200d]|\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\}))(?:\w|[$\u200c\u200d]|\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\}))*")
_NUMBER = re.compile(r"(?:0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$\\])")
_ESCAPE = r"\\(?:\r\n|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|u\{0*(?:10|[0-9A-Fa-f])?[0-9A-Fa-f]{1,4}\}|0(?!\d)|[^xu0-9])"
_STRING = re.compile(rf"\"(?:[^\"\\\r\n]++|{_ESCAPE})*+\"|'(?:[^'\\\r\n]++|{_ESCAPE})*+'", re.S)
_CHUNK = re.compile(rf"(?:[^`\\$]++|\$(?!\{{)|{_ESCAPE})*+", re.S)
_REGEX = re.compile(r"/(?![*/])((?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+)/([dgimsuvy]*)(?![\w$])")
_MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_JNAME = re.compile(r"[^\W\d][\w$-]*|\$[\w$-]*")
_JTEXT = re.compile(r"[^<{>}]+")
_JCLOSE = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>")
_JSTRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_TARGS = re.compile(r"&&|\|\||=>|==|\"[^\"\n]*\"|'[^'\n]*'|[\w$.,\s?:;\-]+|[|&]|[<>()\[\]{}=]|.", re.S)

_FIXED = {
    "var": "VAR", "let": "VAR", "const": "VAR", "function": "FUNCTION", "class": "CLASS", "extends": "EXTENDS", "new": "NEW", "return": "RETURN", "if": "IF", "else": "ELSE", "for": "FOR", "while": "WHILE",
    "do": "DO", "switch": "SWITCH", "case": "CASE", "default": "DEFAULT", "break": "BREAK", "continue": "CONTINUE", "try": "TRY", "catch": "CATCH", "finally": "FINALLY", "throw": "THROW", "import": "IMPORT",
    "export": "EXPORT", "yield": "YIELD", "debugger": "DEBUGGER", "typeof": "TYPEOF", "void": "VOID", "delete": "UN", "await": "AWAIT", "in": "IN", "instanceof": "REL", "true": "LIT", "false": "LIT",
    "null": "LIT", "with": "ERR", "enum": "ENUM", "implements": "ERR", "interface": "ERR", "package": "ERR", "private": "ERR", "protected": "ERR", "public": "ERR", "static": "ERR",
}
_MARKS = {
    "===": "EQ", "!==": "EQ", "==": "EQ", "!=": "EQ", "<=": "REL", ">=": "REL", "<<": "SHIFT", ">>": "SHIFT", ">>>": "SHIFT", "/": "MUL", "%": "MUL", "!": "UN", "~": "UN", "|": "BAR", "#": "ERR",
    **dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??="), "AOP"),
}
#: an expression may end with these
_ENDS = frozenset("IDENT KEY LIT STR TPL TPLT ) ] POST BANG TGT JEND AID".split())
#: behind these a brace opens an object
_BEFORE_OBJECT = frozenset("( [ , = AOP : ? && || ?? BAR ^ & EQ < > REL IN SHIFT + - * MUL ** UN TYPEOF VOID ... RETURN THROW VAR IMPORT EXPORT DEFAULT OF CASE YIELD AWAIT NEW TPLH TPLM JB KEQ TLT AS TYPE KEYOF IS TAS EXTENDS".split())
_MODS = frozenset("static async get set readonly public private protected abstract override declare accessor".split())
_PARAM_MODS = frozenset("private public protected readonly override".split())
_RESTRICTED = frozenset("RETURN BREAK CONTINUE YIELD".split())
_SIMPLE = re.compile(r"\s*(?:\(|[A-Za-z_$\"'\[{\d])")
#: words that are not always identifiers
_SPECIAL = frozenset([*_FIXED, *_PARAM_MODS, *"of as from async satisfies is keyof readonly unique infer implements interface enum type declare abstract namespace module".split()])
_TARGET = re.compile(r"\s*=(?![=>])|\s+(?:of|in)\b")  # behind a pattern
_BLANK = frozenset(" \t\v\f\r\n/")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*+(?![\\\u0080-\U0010ffff])")
_MEMBER = re.compile(r"\.[A-Za-z_$][A-Za-z0-9_$]*+(?![\\\u0080-\U0010ffff])")


class _Bad(Exception):
    """The text can't be cut into tokens here."""


class Lexer:
    """``tokens``: terminals; ``line_before``: 1 where a line end stands before the token; ``starts``: offsets."""

    def __init__(self, text: str, typed: bool, elements: bool):
        self.text, self.typed, self.elements = text, typed, elements
        self.tokens: list[str] = []
        self.line_before: list[int] = []
        self.starts: list[int] = []
        self.stack: list[list] = []  # [kind, index of the opening token, flag, pending = of keys]
        self.returns: dict[int, tuple[int, int]] = {}  # per depth the last parenthesis with a colon behind it, a typed arrow function's perhaps
        self.angles: dict[int, int] = {}  # open type arguments by depth of brackets
        self.closers: set[int] = set()  # offsets of > that close type arguments
        self.classes: list[tuple[int, str]] = []  # (depth, kind of body) of headers whose body is still to come
        self.cases = 0
        try:
            self._run()
        except _Bad as bad:
            self._put("ERR", bad.args[0], 0)

    def _put(self, kind: str, at: int, line: int) -> None:
        self.tokens.append(kind)
        self.line_before.append(line)
        self.starts.append(at)

    def _run(self) -> None:
        text, n = self.text, len(self.text)
        pos = text.find("\n") if text.startswith("#!") else 0
        if pos < 0:
            return
        tokens, lines, starts, stack = self.tokens, self.line_before, self.starts, self.stack
        skip, name, member = _SKIP.match, _NAME.match, _MEMBER.match
        while pos < n:
            line = 0
            c = text[pos]
            if c == " ":
                pos += 1
                if pos >= n:
                    break
                c = text[pos]
            if c in _BLANK or c > "\x7f":
                m = skip(text, pos)
                if m:
                    line = 1 if "\n" in m[0] or "\r" in m[0] else 0
                    pos = m.end()
                    if pos >= n:
                        break
                    c = text[pos]
            prev = tokens[-1] if tokens else ""
            if line and prev in _RESTRICTED and prev != "YIELD":
                self._put(";", pos, 0)
                prev = ";"
            m = name(text, pos)
            if m:
                word = m[0]
                if word in _SPECIAL or prev == "." or prev == "?." or stack and stack[-1][0] in "OCTM":
                    self._word(word, pos, m.end(), prev, line)
                else:
                    tokens.append("IDENT")
                    lines.append(line)
                    starts.append(pos)
                pos = m.end()
            elif c == ";" or c == ",":
                tokens.append(c)
                lines.append(line)
                starts.append(pos)
                pos += 1
            elif c == "." and (m := member(text, pos)):
                tokens += (".", "IDENT")
                lines += (line, 0)
                starts += (pos, pos + 1)
                pos = m.end()
            elif c.isalpha() or c in "_$\\":
                m = _WORD.match(text, pos)
                if not m:
                    raise _Bad(pos)
                self._word(m[0], pos, m.end(), prev, line)
                pos = m.end()
            elif c in "\"'":
                m = _STRING.match(text, pos)
                if not m:
                    raise _Bad(pos)
                self._put("STR", pos, line)
                pos = m.end()
            elif c.isdigit() or c == "." and pos + 1 < n and text[pos + 1].isdigit():
                m = _NUMBER.match(text, pos)
                if not m:
                    raise _Bad(pos)
                self._put("LIT", pos, line)
                pos = m.end()
            elif c == "`":
                pos = self._template(pos + 1, "TPLH", pos, line)
            elif c == "/" and not self._ended(prev):
                m = _REGEX.match(text, pos)
                if not m or not _balanced(m[1]):
                    raise _Bad(pos)
                self._put("LIT", pos, line)
                pos = m.end()
            elif c == "<" and self.elements and not self._ended(prev) and not (self.typed and re.match(r"<\s*[\w$]+\s*(?:,|extends\s)", text[pos : pos + 80])):
                pos = self._elements(self._element(pos, line))
            else:
                pos = self._mark(pos, prev, line)
        self._put("EOF", n, 1)

    def _ended(self, prev: str) -> bool:
        """An expression ends with the token before."""
        if prev == ")":
            return not self.closed_control
        return prev in _ENDS or prev == "}" and self.closed_object

    closed_object = False
    closed_control = False

    # words

    def _key_place(self, prev: str, line: int) -> bool:
        """A name of a property or member is due here."""
        if not self.stack:
            return False
        kind, opened, *_ = self.stack[-1]
        if kind not in "OCTM" or self.angles.get(len(self.stack)):
            return False
        if len(self.tokens) - 1 == opened or prev in (",", "MOD") or prev == "*" and self._star_of_key():
            return True
        if kind in "CT":
            return prev == ";" or prev == "}" and (kind == "C" or line) or line and (prev in _ENDS or prev == "VOID" or prev == "OPT") and prev != "MOD"
        return prev == ";" and self.typed

    def _star_of_key(self) -> bool:
        before = self.tokens[-2]
        return before in (",", "MOD", ";", "}", "OB", "LB")

    def _word(self, word: str, at: int, end: int, prev: str, line: int) -> None:
        text, tokens = self.text, self.tokens
        if prev in (".", "?."):
            self._put("IDENT", at, line)
            return
        if self._key_place(prev, line):
            if word in _MODS or self.stack[-1][0] == "M" and word == "type" and self.typed:
                after = _SKIP.match(text, end)
                follow = text[after.end() if after else end :][:1]
                if follow and (follow.isalnum() or follow in "_$\"'[*#{" and (follow != "{" or word == "static")) and not (word == "async" and after and "\n" in after[0]) and not (self.stack[-1][0] == "M" and re.match(r"\s+as\b", text[end:])):
                    self._put("MOD", at, line)
                    return
            self._put("KEY", at, line)
            return
        kind = _FIXED.get(word)
        if kind is None or kind == "ERR" or kind == "ENUM":
            self._name(word, at, end, prev, line)
            return
        if kind == "IMPORT":
            follow = re.match(r"\s*[(.]", text[end:])
            if follow:
                kind = "IDENT"
        elif kind == "NEW" and re.match(r"\s*\.\s*target", text[end:]):
            kind = "IDENT"
        elif kind == "IN" and self.stack and self.stack[-1][0] == "f":
            kind = "OF"
        elif kind == "CLASS":
            self.classes.append((len(self.stack), "C"))
        elif kind == "CASE":
            self.cases += 1
        elif kind == "DEFAULT" and prev not in ("EXPORT", "AS"):
            self.cases += 1
        elif kind == "VAR" and prev == "AS":
            kind = "IDENT"
        if prev == "AS" and kind in ("DEFAULT", "CLASS"):
            kind = "IDENT"
        self._put(kind, at, line)

    def _name(self, word: str, at: int, end: int, prev: str, line: int) -> None:
        """An identifier or a word that is one only in some places."""
        text = self.text
        inside = self.stack[-1][0] if self.stack else ""
        kind = "IDENT"
        if word == "of" and inside == "f" and prev in ("IDENT", "}", "]"):
            kind = "OF"
        elif word == "as" and (inside == "M" and prev in ("KEY", "STR", "IDENT") or prev == "*" and self.tokens[-2] in ("IMPORT", "EXPORT", ",", "TYPE")):
            kind = "AS"
        elif word == "from" and re.match(r"\s*[\"']", text[end:]) and prev in ("}", "IDENT", "*", "STR"):
            kind = "FROM"
        elif word == "async" and re.match(r"[ \t]+function\b", text[end:]):
            kind = "ASYNC"
        elif self.typed:
            if word in ("as", "satisfies") and self._ended(prev) and not line:
                kind = "AS"
            elif word == "is" and prev == "IDENT" and not line:
                kind = "IS"
            elif word in ("keyof", "readonly", "unique", "infer") and re.match(r"\s*[\w$({\[]", text[end:]) and not self._ended(prev):
                kind = "KEYOF" if not (inside == "p" and word == "readonly") else "MOD"
            elif word in _PARAM_MODS and inside in "p(" and prev in ("(", ",", "MOD") and re.match(r"\s+[\w$]", text[end:]):
                kind = "MOD"
            elif word == "implements":
                kind = "IMPLEMENTS"
            elif word == "interface" and re.match(r"\s+[\w$]", text[end:]):
                kind = "INTERFACE"
                self.classes.append((len(self.stack), "T"))
            elif word == "enum":
                kind = "ENUM"
                self.classes.append((len(self.stack), "O"))
            elif word == "type" and not self._ended(prev if not line else "") and (re.match(r"\s+[\w$]+\s*[<=]", text[end:]) or prev in ("IMPORT", "EXPORT") and re.match(r"\s*[{*]|\s+[\w$]+\s+from\b", text[end:])):
                kind = "TYPE"
            elif word == "declare" and re.match(r"[ \t]+[a-z]", text[end:]) and not (self._ended(prev) and not line):
                kind = "DECLARE"
            elif word == "abstract" and re.match(r"[ \t]+class\b", text[end:]):
                kind = "ABSTRACT"
            elif word in ("namespace", "module") and re.match(r"[ \t]+[\w$\"']", text[end:]) and not (self._ended(prev) and not line):
                kind = "NAMESPACE"
            elif word in _FIXED and word not in ("private", "public", "protected", "static", "package"):
                kind = "ERR"
        elif word in _FIXED:
            kind = "ERR"
        self._put(kind, at, line)

    # templates and elements

    def _template(self, pos: int, begin: str, at: int, line: int) -> int:
        m = _CHUNK.match(self.text, pos)
        end = m.end()
        if self.text.startswith("`", end):
            self._put("TPL" if begin == "TPLH" else "TPLT", at, line)
            return end + 1
        if not self.text.startswith("${", end):
            raise _Bad(at)
        self._put(begin, at, line)
        self.stack.append(["X", len(self.tokens) - 1, False, []])
        return end + 2

    def _element(self, pos: int, line: int) -> int:
        """``<`` of an element."""
        self._put("JLT", pos, line)
        self.stack.append(["t", len(self.tokens) - 1, False, []])
        return pos + 1

    def _elements(self, pos: int) -> int:
        """Through tags and children until an expression in braces begins or the outermost element has ended."""
        while self.stack:
            kind = self.stack[-1][0]
            if kind == "t":
                pos = self._tag(pos)
            elif kind == "c":
                pos = self._children(pos)
            else:
                break
        return pos

    def _close(self, pos: int) -> int:
        self._put("JGT", pos, 0)
        self.stack.pop()
        self.closed_object = True
        return pos + 1

    def _tag(self, pos: int) -> int:
        """Inside an opening tag, until something opens or closes."""
        text = self.text
        while True:
            m = _SKIP.match(text, pos)
            if m:
                pos = m.end()
            c = text[pos : pos + 1]
            if not c:
                raise _Bad(pos)
            m = _JNAME.match(text, pos)
            if m:
                self._put("JNAME", pos, 0)
                pos = m.end()
            elif c in "\"'":
                m = _JSTRING.match(text, pos)
                if not m:
                    raise _Bad(pos)
                self._put("STR", pos, 0)
                pos = m.end()
            elif c in ".:=":
                self._put(c, pos, 0)
                pos += 1
            elif c == "{":
                self._put("JB", pos, 0)
                self.stack.append(["J", len(self.tokens) - 1, False, []])
                return pos + 1
            elif c == "/":
                self._put("JSLASH", pos, 0)
                m = _SKIP.match(text, pos + 1)
                pos = m.end() if m else pos + 1
                if text[pos : pos + 1] != ">":
                    raise _Bad(pos)
                return self._close(pos)
            elif c == ">":
                self._put("JGT", pos, 0)
                self.stack[-1][0] = "c"
                return pos + 1
            elif c == "<" and self.tokens[-1] == "=":
                return self._element(pos, 0)
            else:
                raise _Bad(pos)

    def _children(self, pos: int) -> int:
        """Between tags, until something opens or closes."""
        text = self.text
        m = _JTEXT.match(text, pos)
        if m:
            self._put("JTEXT", pos, 0)
            pos = m.end()
        c = text[pos : pos + 1]
        if not c or c in ">}":
            raise _Bad(pos)
        if c == "{":
            self._put("JB", pos, 0)
            self.stack.append(["J", len(self.tokens) - 1, False, []])
            return pos + 1
        m = _JCLOSE.match(text, pos)
        if not m:
            if text.startswith("</", pos):
                raise _Bad(pos)
            return self._element(pos, 0)
        self._put("JLTS", pos, 0)
        if m[1] != self._tag_name(self.stack[-1][1]):
            raise _Bad(pos)
        for k, part in enumerate(re.split(r"([.:])", m[1])):
            if part:
                self._put(part if k % 2 else "JNAME", pos + 1, 0)
        return self._close(m.end() - 1)

    def _tag_name(self, opened: int) -> str:
        m = re.compile(r"<\s*([\w$.:-]*)").match(self.text, self.starts[opened])
        return m[1]

    # marks

    def _mark(self, pos: int, prev: str, line: int) -> int:
        text, tokens, stack = self.text, self.tokens, self.stack
        mark, end = text[pos], pos + 1
        if mark not in "{}()[]":
            m = _MARK.match(text, pos)
            if not m:
                raise _Bad(pos)
            mark, end = m[0], m.end()
        if mark == "{":
            self._open_brace(pos, prev, line)
        elif mark == "}":
            if not stack or stack[-1][0] not in "BOCTMJX":
                raise _Bad(pos)
            kind, opened, flag, pending = stack.pop()
            if kind == "X":
                return self._template(end, "TPLM", pos, line)
            self._put("}", pos, line)
            if kind == "J":
                return self._elements(end)
            self.closed_object = kind == "O"
            if pending:
                self._settle(flag or bool(_TARGET.match(text, end)), pending)
        elif mark == "(":
            kind = "("
            if prev in ("IF", "WHILE", "SWITCH"):
                kind = "k"
            elif prev == "FOR" or prev == "AWAIT" and len(tokens) > 1 and tokens[-2] == "FOR":
                kind = "f"
            elif prev in ("FUNCTION", "KEY", "CATCH") or prev == "IDENT" and len(tokens) > 1 and (tokens[-2] == "FUNCTION" or tokens[-2] == "*" and len(tokens) > 2 and tokens[-3] == "FUNCTION") or prev == "TGT" and self._declares():
                kind = "p"
            elif prev in ("STR", "LIT", "]") and self._method(len(tokens) - 1):
                kind = "p"
            self._put("(", pos, line)
            stack.append([kind, len(tokens) - 1, kind == "p", []])
        elif mark == ")":
            if not stack or stack[-1][0] not in "(kfp":
                raise _Bad(pos)
            kind, opened, flag, pending = stack.pop()
            self._put(")", pos, line)
            self.closed_control = kind in "kf"
            self.closed_object = False
            self.last_paren = (opened, len(tokens) - 1)
            if pending or self.typed and kind == "(":
                after = _SKIP.match(text, end)
                at = after.end() if after else end
                self._settle(flag or text.startswith("=>", at), pending)
                if self.typed and kind == "(" and text.startswith(":", at):
                    self.returns[len(stack)] = opened, len(tokens) - 1
        elif mark == "[":
            self._put("[", pos, line)
            stack.append(["[", len(tokens) - 1, prev == "VAR", []])
        elif mark == "]":
            if not stack or stack[-1][0] != "[":
                raise _Bad(pos)
            _, _, flag, pending = stack.pop()
            self._put("]", pos, line)
            if pending:
                self._settle(flag or bool(_TARGET.match(text, end)), pending)
        elif mark == "=>":
            self._arrow(pos, line)
        elif mark in ("++", "--"):
            self._put("POST" if self._ended(prev) and not line else "INC", pos, line)
        elif mark == "=":
            if prev == "KEY" and stack and stack[-1][0] == "O" and not self._enum():
                self._put("KEQ", pos, line)
                stack[-1][3].append(len(tokens) - 1)
            else:
                self._put("=", pos, line)
        elif mark == ":":
            self._put(":", pos, line)
            if self.cases and (not stack or stack[-1][0] == "B"):
                self.cases -= 1
                self.case_colon = len(tokens) - 1
        elif mark == "?":
            if self.typed and re.match(r"\s*[:),;=]|\s*\]|\s*\(", text[end : end + 40]) and (prev in ("IDENT", "}", "]", "TGT", "LIT", "STR") and not re.match(r"\s*\(", text[end : end + 40]) or prev == "KEY"):
                self._put("OPT", pos, line)
            else:
                self._put("?", pos, line)
        elif mark[0] == "<" and self.typed and self._arguments(pos, prev):
            kind = "TAS" if not (prev in _ENDS or prev in ("FUNCTION", "CLASS", "KEY", "TYPE", "EXTENDS")) and self._next_is_operand(pos) else "TLT"
            self._put(kind, pos, line)
            self.angles[len(stack)] = self.angles.get(len(stack), 0) + 1
            return pos + 1
        elif mark[0] == ">" and pos in self.closers:
            self.angles[len(stack)] = self.angles.get(len(stack), 0) - 1
            self._put("TGT", pos, line)
            return pos + 1
        elif mark == "!" and self.typed and self._ended(prev) and not line and not text.startswith("=", end):
            self._put("BANG", pos, line)
        elif mark == "#":
            m = _WORD.match(text, end)
            if not m:
                raise _Bad(pos)
            self._put("KEY" if self._key_place(prev, line) else "IDENT", pos, line)
            return m.end()
        elif mark == "@":
            m = re.compile(r"@[\w$.]+").match(text, pos)
            if not m or not self.typed:
                raise _Bad(pos)
            return self._decorator(m.end())
        else:
            self._put(_MARKS.get(mark, mark), pos, line)
        return end

    def _decorator(self, pos: int) -> int:
        """Decorators add nothing to the grammar: a name and, if there are, balanced arguments."""
        if not self.text.startswith("(", pos):
            return pos
        depth = 0
        for m in re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[(){}\[\]]", re.S).finditer(self.text, pos):
            depth += (m[0] in "({[") - (m[0] in ")}]")
            if depth == 0:
                return m.end()
        raise _Bad(pos)


    last_paren = (-1, -1)
    case_colon = -1

    def _settle(self, resolved: bool, pending: list[int]) -> None:
        """``=`` behind keys is right in patterns; it waits in the bracket outside until that is known to be one."""
        if resolved or not pending:
            return
        if self.stack and self.stack[-1][0] in "(pO[":
            self.stack[-1][3].extend(pending)
        else:
            for i in pending:
                self.tokens[i] = "ERR"

    def _enum(self) -> bool:
        return self.stack[-1][2] == "enum"

    def _declares(self) -> bool:
        """The type parameters that end here belong to a function or a method, not to a call."""
        depth = 0
        for i in range(len(self.tokens) - 1, -1, -1):
            t = self.tokens[i]
            depth += (t == "TGT") - (t == "TLT")
            if depth == 0:
                return i > 0 and (self.tokens[i - 1] in ("KEY", "FUNCTION") or self.tokens[i - 1] == "IDENT" and i > 1 and self.tokens[i - 2] == "FUNCTION")
        return False

    def _method(self, i: int) -> bool:
        """The token at i names a member by a literal or an expression."""
        if not self.stack or self.stack[-1][0] not in "OCT":
            return False
        if self.tokens[i] == "]":
            depth = 0
            while i >= 0:
                depth += (self.tokens[i] == "]") - (self.tokens[i] == "[")
                if depth == 0:
                    break
                i -= 1
        return i > 0 and (i - 1 == self.stack[-1][1] or self.tokens[i - 1] in (",", ";", "MOD", "}", "*"))

    def _open_brace(self, pos: int, prev: str, line: int) -> None:
        stack = self.stack
        if self.classes and self.classes[-1][0] == len(stack) and prev not in ("EXTENDS", "(", ",", ":", "="):
            kind = self.classes.pop()[1]
            self._put("LB", pos, line)
            stack.append([kind, len(self.tokens) - 1, "enum" if kind == "O" else False, []])
            return
        flag = False
        if prev in ("IMPORT", "EXPORT") or prev == "TYPE" or prev == "," and self._imports():
            kind = "M"
        elif prev == ":":
            kind = "B" if self.case_colon == len(self.tokens) - 1 else "O"
        elif prev in _BEFORE_OBJECT:
            kind, flag = "O", prev == "VAR"
        elif prev == "MOD":
            kind = "B"
        else:
            kind = "B"
        self._put("LB" if kind == "B" else "OB", pos, line)
        stack.append([kind, len(self.tokens) - 1, flag, []])

    def _imports(self) -> bool:
        return len(self.tokens) > 2 and self.tokens[-2] == "IDENT" and self.tokens[-3] == "IMPORT"

    def _arrow(self, pos: int, line: int) -> None:
        tokens = self.tokens
        head = -1
        if tokens and tokens[-1] == ")":
            head = self.last_paren[0]
            if self.last_paren[1] == len(tokens) - 1:
                tokens[head] = "ALP"
        elif tokens and tokens[-1] == "IDENT" and not (self.typed and self._returned()):
            head = len(tokens) - 1
            tokens[head] = "AID"
        if self.typed and self._returned():
            opened, _ = self.returns.pop(len(self.stack), (-1, -1))
            if opened >= 0 and tokens[opened] == "(":
                tokens[opened] = "ALP"
                head = opened
        before = head - 1
        if before >= 0 and tokens[before] == "TGT":
            nesting = 0
            while before >= 0:
                nesting += (tokens[before] == "TGT") - (tokens[before] == "TLT")
                before -= 1
                if nesting == 0:
                    break
        if before >= 0 and tokens[before] == "IDENT" and self.text.startswith("async", self.starts[before]) and not self.line_before[before + 1]:
            tokens[before] = "ASYNC"
        self._put("=>", pos, line)

    def _returned(self) -> bool:
        """A parenthesis with a colon behind it waits for its arrow at this depth: behind it there is only a type."""
        opened, closed = self.returns.get(len(self.stack), (-1, -1))
        if opened < 0 or self.tokens[opened] != "(":
            return False
        depth = 0
        for i in range(closed + 1, len(self.tokens)):
            t = self.tokens[i]
            depth -= t in ("}", ")", "]", "TGT")
            if depth < 0 or depth == 0 and t in (";", "=", ",", "=>", "LB"):
                del self.returns[len(self.stack)]
                return False
            depth += t in ("OB", "LB", "(", "[", "TLT", "ALP")
        return True

    def _arguments(self, pos: int, prev: str) -> bool:
        """``<`` opens type arguments or parameters: types and marks of types up to its ``>``, and behind that no operand."""
        after_name = prev in ("IDENT", "KEY", "TGT", "FUNCTION", "CLASS", "TPLT")
        if not after_name and (self._ended(prev) or prev in ("}",)):
            return False
        if line_operator := self.text[pos : pos + 2]:
            if line_operator in ("<=", "<<"):
                return False
        open_marks, ends, at = [], [], pos
        for m in _TARGS.finditer(self.text, pos, pos + 2000):
            t = m[0]
            if t in ("&&", "||", "=="):
                return False
            if t in ("(", "[", "{", "<"):
                open_marks.append(t)
            elif t in (")", "]", "}", ">"):
                if not open_marks or open_marks[-1] != {")": "(", "]": "[", "}": "{", ">": "<"}[t]:
                    return False
                if t == ">":
                    ends.append(m.start())
                open_marks.pop()
                if not open_marks:
                    at = m.end()
                    break
            elif t in ("=>", "=") or t[0] in "\"'" or re.match(r"[\w$.,\s|&?:;\-]", t):
                if ";" in t and "{" not in open_marks:
                    return False
                continue
            else:
                return False
        else:
            return False
        if open_marks:
            return False
        if after_name and re.match(r"[ \t]*(?:[\w$\"'+\-!~]|/(?!/))", self.text[at:]) and not re.match(r"\s*(?:extends|implements|is|as|of)\b", self.text[at:]):
            return False
        self.closers.update(ends)
        return True

    def _next_is_operand(self, pos: int) -> bool:
        """Behind the type in angle brackets stands an operand, so it is an assertion (a parenthesis would be an arrow function's)."""
        last = max((e for e in self.closers if e > pos), default=pos)
        return not re.match(r"\s*\(", self.text[last + 1 :])


def _balanced(pattern: str) -> bool:
    """Groups of a regular expression open and close in pairs, and nothing is repeated at its beginning."""
    depth = 0
    for m in re.finditer(r"\\.|\[(?:[^\]\\]|\\.)*\]|[()]", pattern):
        depth += (m[0] == "(") - (m[0] == ")")
        if depth < 0:
            return False
    return depth == 0 and not re.match(r"[*+?]", pattern)


def lex(text: str, typed: bool, elements: bool) -> Lexer:
    return Lexer(text, typed, elements)


def line_of(text: str, at: int, breaks: list[int] | None = None) -> int:
    """1-based line of an offset."""
    if breaks is None:
        return text.count("\n", 0, at) + 1
    return bisect_left(breaks, at) + 1
