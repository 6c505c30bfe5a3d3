"""Lexers: a text of a language as a list of (token class, line), for the grammars in `syntax_languages`.

A lexer never fails: what can't be a token is BAD, an unclosed string or comment OPEN, a marker of a merge conflict
outside strings and comments CONFLICT; no grammar knows these.
"""

from __future__ import annotations

import re

CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?=[ \t\r\n]|\Z)|={7}(?=[ \t]*(?:\r?\n|\Z))")

_JS_WORDS = set(
    "if else for while do switch case default try catch finally return throw break continue var let const function class import export new delete typeof void in instanceof extends debugger yield with enum".split()
)
_JS_PLACES = set("async await of get set static as using".split())
_TS_PLACES = _JS_PLACES | set("type interface enum namespace module declare abstract is keyof infer satisfies unique asserts implements accessor out global".split())
_TS_MODS = set("public private protected readonly override".split())
_JAVA_WORDS = set("if else for while do switch case default try catch finally return throw break continue class interface enum import package new instanceof extends implements throws assert synchronized".split())
_JAVA_MODS = set("public private protected static final abstract native transient volatile strictfp".split())
_JAVA_PLACES = set("record var yield sealed permits when".split())
_GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())

_WORD = r"(?:[^\W\d]|[$\u0080-\u2027\u202a-\uffff\U00010000-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$]|[\u0080-\u2027\u202a-\uffff\U00010000-\U0010ffff]|\\u[0-9a-fA-F]{4})*"
_NUMBER = r"0[xXbBoO][0-9a-fA-F_]+[nlLuU]*|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eEpP][+-]?\d[\d_]*)?[nfFdDlLi]?"
_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_C = re.compile(
    rf"(?P<s>[ \t\r\f\v\u00a0\ufeff\u2028\u2029\u3000]+)|(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*[\s\S]*?\*/)|(?P<text>\"\"\"[\s\S]*?(?<!\\)\"\"\")|(?P<str>{_STRING})|(?P<num>{_NUMBER})|(?P<word>{_WORD})"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|&\^=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|:=|::|->|<-|<<|&\^|\*\*|[{}()\[\];,.?:~!@#<>=+\-*/%&|^])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_ENDS = frozenset("ID CK FID CID KID NUM STR TPL RE RP RB RCO RCC INC SUPER HASHID".split())
_STARTS = frozenset("BOF SM LCB RCB RCT RCD LAB CC".split())
_BLOCKS = frozenset("BOF SM LCB RCB RCT RCD RPH RP AR else try finally do CC LAB RCC catch LCC".split())
_ASSIGN = frozenset(">>>= **= <<= >>= &&= ||= ??= &^= += -= *= /= %= &= |= ^= :=".split()) | {"="}


def _template(text: str, at: int) -> int:
    """The end of a template literal that begins at `at`, -1 if it has none."""
    n, at = len(text), at + 1
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif c == "$" and text.startswith("${", at):
            at = _substitution(text, at + 2)
            if at < 0:
                return -1
        else:
            at += 1
    return -1


def _substitution(text: str, at: int) -> int:
    """The end of an expression in a template, past its brace, -1 if it has none."""
    n, depth, operand = len(text), 1, False
    while at < n:
        c = text[at]
        if c == "`":
            at = _template(text, at)
            if at < 0:
                return -1
            operand = True
            continue
        if c == "/" and not operand and (m := _REGEX.match(text, at)):
            at, operand = m.end(), True
            continue
        m = _C.match(text, at)
        if not m:
            return -1
        kind, value, at = m.lastgroup, m.group(), m.end()
        if kind in ("s", "nl", "lc", "bc"):
            continue
        if value == "{":
            depth += 1
        elif value == "}":
            depth -= 1
            if not depth:
                return at
        operand = kind in ("str", "num", "word", "text") and value not in ("return", "typeof", "in", "of", "case") or value in (")", "]", "}")
    return -1


def out_method(out: list[tuple[str, int]]) -> bool:
    """Whether the parenthesis just closed is the receiver of a method."""
    depth = 0
    for k in range(len(out) - 1, 0, -1):
        depth += (out[k][0] == "RP") - (out[k][0] == "LP")
        if not depth:
            return out[k - 1][0] == "func"
    return False


class _Place:
    """What is open: its bracket and what was seen in it since the statement began."""

    __slots__ = ("case", "cls", "close", "decl", "fn", "head", "kind", "new", "quest", "word")

    def __init__(self, kind: str, close: str):
        self.kind, self.close = kind, close
        self.case = self.cls = self.decl = self.fn = self.head = self.new = False
        self.quest, self.word = 0, ""

    def fresh(self) -> None:
        self.decl = self.fn = self.cls = self.head = self.new = self.case = False
        self.quest, self.word = 0, ""


def lex_c(text: str, language: str) -> list[tuple[str, int]]:
    """JavaScript, TypeScript, Java and Go."""
    js, ts, java, go = language in ("javascript", "typescript"), language == "typescript", language == "java", language == "go"
    words = _JS_WORDS if js else _JAVA_WORDS if java else _GO_WORDS
    places = _TS_PLACES if ts else _JS_PLACES if js else _JAVA_PLACES if java else frozenset()
    out = [("BOF", 1)]
    stack = [_Place("T", "")]
    at, n, line, broke, prev, first, last_new = 0, len(text), 1, True, "BOF", False, False
    word_before = word_now = ""
    if text.startswith("#!") and js:
        at = text.find("\n") if "\n" in text else n

    def emit(cls: str) -> None:
        nonlocal prev, broke, first
        top = stack[-1]
        first = prev in _STARTS or (broke and js and top.kind in "TB")
        if js and broke and prev != "BOF" and len(out) > 0:
            out.append((f"^{cls}", line))
        else:
            out.append((cls, line))
        prev, broke = cls, False

    while at < n:
        if broke and text[at] in "<>=|" and (at == 0 or text[at - 1] == "\n") and (m := CONFLICT.match(text, at)):
            emit("CONFLICT")
            end = text.find("\n", at)
            at = n if end < 0 else end
            continue
        c = text[at]
        if c == " " and text[at + 1 : at + 2] != " ":  # most gaps are one blank and need no expression
            at += 1
            continue
        if js and c == "`":
            end = _template(text, at)
            emit("TPL" if end >= 0 else "OPEN")
            line += text.count("\n", at, end if end >= 0 else n)
            at = end if end >= 0 else n
            continue
        if go and c == "`":
            end = text.find("`", at + 1)
            emit("STR" if end >= 0 else "OPEN")
            line += text.count("\n", at, end if end >= 0 else n)
            at = end + 1 if end >= 0 else n
            continue
        if js and c == "/" and prev not in _ENDS and (m := _REGEX.match(text, at)):
            emit("RE")
            at = m.end()
            continue
        m = _C.match(text, at)
        if not m:
            emit("OPEN" if c in "\"'" or text.startswith("/*", at) else "BAD")
            if c in "\"'":
                end = text.find("\n", at)
                at = n if end < 0 else end
            elif text.startswith("/*", at):
                at = n
            else:
                at += 1
            continue
        kind, value = m.lastgroup, m.group()
        at = m.end()
        top = stack[-1]
        if kind == "word":
            word_before, word_now = word_now, value
        if kind == "s" or kind == "lc":
            continue
        if kind == "nl" or kind == "bc":
            lines = value.count("\n")
            if lines:
                if go and prev in _GO_ENDS:
                    emit("SM")
                    stack[-1].fresh()
                line += lines
                broke = True
            continue
        if kind == "text":
            if java or prev not in _ENDS and not js and not go:
                emit("STR")
                line += value.count("\n")
                continue
            at = m.start() + 2
            emit("STR")
            continue
        if kind == "str":
            if value.count("\n") and "\\\n" not in value:
                emit("OPEN")
            elif go and value[0] == "'" and not re.match(r"'(?:[^\\]|\\.{1,10})'$", value):
                emit("BAD")
            elif java and value[0] == "'" and not re.match(r"'(?:[^\\]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'$", value):
                emit("BAD")
            else:
                emit("STR")
            line += value.count("\n")
            continue
        if kind == "num":
            emit("BAD" if at < n and (text[at].isalnum() or text[at] in "_$") else "NUM")
            continue
        if kind == "word":
            after = text[at : at + 40].lstrip(" \t")[:1]
            if prev == "DOT":
                emit("new" if value == "new" and java else "ID")
                continue
            if js and value == "default" and top.kind == "O":
                emit("ID")
                continue
            if js and top.kind in "OC" and (value in words or value == "super") and (prev in ("LCO", "CM", "LCC", "SM", "RCB", "CK", "MOD", "STAR") or broke) and after in (":", "(", ",", "}", "?", "=", "<") and not (value in ("new",) and ts):
                emit("ID")
                continue
            if value in words and not (ts and value == "enum"):
                if js and value == "default" and prev == "export":
                    emit("default")
                    continue
                if java and value == "default" and after not in (":", "-"):
                    emit("MOD" if prev != "RP" else "default")
                    continue
                if java and value == "synchronized" and after != "(":
                    emit("MOD")
                    continue
                if js and value == "yield" and after in ("", "=", ":", ","):
                    emit("ID")
                    continue
                if value in ("case", "default"):
                    top.case = True
                if value in ("class", "interface", "enum") and not go:
                    top.cls = "E" if value == "enum" and java else "C"
                if value in ("if", "for", "while", "switch", "catch", "with", "select", "synchronized") or value == "try" and java:
                    top.head = True
                if value in ("var", "let", "const", "type"):
                    top.decl = True
                if value == "func":
                    top.fn = top.decl = True
                if value == "new":
                    top.new = True
                if value in ("import", "export", "package"):
                    top.word = value
                emit(value)
                continue
            if java and value in _JAVA_MODS:
                emit("MOD")
                continue
            if ts and value in _TS_MODS and (after.isalnum() or after in "_$[{#*\"'"):
                emit("MOD")
                continue
            if js and value == "from" and top.word in ("import", "export") and prev in ("ID", "CK", "RCO", "RCI", "STAR", "default"):
                emit("from")
                continue
            if value == "super" or value == "SUPER_":
                emit("SUPER")
                continue
            if value in places:
                if ts and value in ("interface", "enum") and (after.isalpha() or after in "_$"):
                    top.cls = "C"
                if java and value == "record" and after.isalpha():
                    top.cls = "C"
                if prev == "const" and top.kind != "P" and js and value != "enum":
                    emit("KID")
                elif js and prev == "class" and value != "implements" or java and False:
                    emit("CID")
                else:
                    emit("CK")
                continue
            if js and prev == "const" and top.kind != "P" and out[-2][0] not in ("LT", "CM"):
                emit("KID")
            elif js and (prev in ("function",) or prev == "STAR" and out[-2][0].lstrip("^") == "function"):
                emit("FID")
            elif js and top.cls and (prev == "class" or prev == "CK" and word_before in ("interface", "enum")):
                emit("CID")
            elif go and prev == "func" and top.kind in "TB" or go and prev == "RP" and top.kind == "T" and top.fn and not top.word and out_method(out):
                emit("FID")
                top.word = "func"
            elif go and prev == "type":
                emit("TID")
            elif go and prev == "package":
                emit("PKG")
            elif go and prev == "import":
                emit("IMP")
            elif go and prev == "ID" and top.kind in "TB" and not top.decl:
                emit("BAD")
            else:
                emit("ID")
            continue
        op = value
        if op == "{":
            if top.cls and prev not in ("LT", "CM", "BI", "AC", "OC", "LP", "extends", "EL", "AS", "LB"):
                kind_, cls = ("E", "LCE") if top.cls == "E" else ("C", "LCC")
                top.cls = False
            elif go:
                if prev in ("struct", "interface"):
                    kind_, cls = "C", "LCC"
                elif top.head or top.fn or prev in ("SM", "BOF", "LCB", "else", "CC", "LAB"):
                    kind_, cls = "B", "LCB"
                    top.head = top.fn = False
                else:
                    kind_, cls = "O", "LCO"
            elif java:
                if prev == "RP" and last_new:
                    kind_, cls = "C", "LCC"
                elif prev in ("AS", "RB", "LP", "CM", "LCO"):
                    kind_, cls = "O", "LCO"
                else:
                    kind_, cls = "B", "LCB"
            elif prev == "CK" and word_now in ("as", "is", "satisfies", "keyof"):
                kind_, cls = "O", "LCO"
            elif ts and top.fn and prev in ("ID", "CK", "GT", "RB", "STR", "void", "null", "RCO", "NUM"):
                kind_, cls = "B", "LCB"
                top.fn = False
            elif prev in ("import", "export") or prev == "CK" and top.word in ("import", "export") and out[-2][0].lstrip("^") in ("import", "export") and not top.fn:
                kind_, cls = "O", "LCO"
            elif prev in _BLOCKS or broke and top.kind in "TB" and prev in _ENDS:
                kind_, cls = "B", "LCB"
            elif prev in ("ID", "CK", "GT", "RB", "STR", "void", "null", "RCO", "NUM") and top.kind != "P":
                kind_, cls = "B", "LCB"
            else:
                kind_, cls = "O", "LCO"
            if js and cls == "LCB":
                top.head = False
            close = {"B": "RCB", "O": "RCO", "C": "RCC", "E": "RCE"}[kind_]
            if js and cls == "LCO" and top.word == "import" and top.kind == "T" and not top.decl:
                close = "RCI"
            if cls == "LCB" and prev == "do":
                close = "RCD"
            if cls == "LCB" and (prev == "try" or java and prev == "RPH" and top.word == "try"):
                close = "RCT"
                top.word = ""
            emit(cls)
            stack.append(_Place(kind_, close))
        elif op in "([" and len(op) == 1:
            head = op == "(" and top.head and prev != "DOT"
            if java and head and prev == "try":
                top.word = "try"
            place = _Place("P" if op == "(" else "L", "RPH" if head and not go else "RP" if op == "(" else "RB")
            place.new = top.new and op == "("
            top.new = False
            if head and not go:
                top.head = False
            emit("LP" if op == "(" else "LB")
            stack.append(place)
        elif op in "})]" and len(op) == 1:
            want = {"}": "BOCE", ")": "P", "]": "L"}[op]
            if len(stack) > 1 and top.kind in want:
                stack.pop()
                last_new = top.new
                cls = top.close
                emit(cls)
                if cls in ("RCB", "RCC", "RCE", "RCT", "RCD") and stack[-1].kind in "TBCE" and not go:
                    keep, asked = stack[-1].word if cls == "RCT" else "", stack[-1].quest
                    if not (js and stack[-1].decl):
                        stack[-1].fresh()
                    stack[-1].word, stack[-1].quest = keep, asked
            else:
                emit({"}": "RCB", ")": "RP", "]": "RB"}[op] if len(stack) > 1 else "STRAY")
        elif op == ";":
            emit("SM")
            if go and top.head:
                pass
            else:
                top.fresh()
        elif op == ",":
            emit("CM")
            if go or top.kind in "OPL":
                top.fn = False
        elif op == ".":
            emit("DOT")
        elif op == "?.":
            emit("DOT")
        elif op == "...":
            emit("EL")
        elif op == "?":
            after = text[at : at + 20].lstrip()[:1]
            if (prev in _ENDS or prev in ("GT", "void", "null") and ts) and not (ts and after in ":),;=") and not (java and prev in ("LT", "CM")):
                top.quest += 1
            emit("QM")
        elif op == ":":
            if top.quest > 0:
                top.quest -= 1
                emit("TC")
            elif top.case:
                top.case = False
                emit("CC")
            elif top.kind == "O":
                emit("OC")
            elif go:
                emit("TC" if top.kind == "L" else "LAB" if prev == "ID" and first else "XC")
            elif java:
                emit("TC" if top.kind == "P" or top.word == "assert" else "LAB" if prev in ("ID", "CK") and first else "TC" if out[-1][0] in _ENDS and any(t == "assert" for t, _ in out[-40:]) else "XC")
            elif ts and (top.kind in "PLC" or top.decl or prev == "RP"):
                if prev == "RP":
                    top.fn = True
                emit("AC")
            elif prev in ("ID", "CK") and first:
                emit("LAB")
            else:
                emit("XC")
        elif op == "=>" or op == "->" and not go:
            if top.case:
                top.case = False
            emit("AR" if js or java and op == "->" else "BAD")
        elif op == "<-":
            if go:
                emit("ARROW")
            else:
                emit("LT")
                at -= 1
        elif op in _ASSIGN:
            emit("BAD" if op == ":=" and not go else "AS")
            if go:
                top.fn = False
        elif op in ("++", "--"):
            emit("INC")
        elif op in "+-" and len(op) == 1:
            emit("PM")
        elif op == "*":
            emit("STAR" if go or prev not in _ENDS or js and top.kind == "C" and prev in ("CK", "MOD") or ts and prev == "CK" and word_now == "type" or java and prev == "DOT" else "BI")
        elif op == "<":
            emit("LT")
        elif op == ">":
            emit("GT")
        elif op == "!":
            emit("BANG" if ts and prev in _ENDS and not broke else "UN")
        elif op == "~":
            emit("UN")
        elif op == "@":
            emit("AT" if not go else "BAD")
        elif op == "::":
            emit("DCOL" if java else "BAD")
        elif op == "#":
            w = re.compile(r"[A-Za-z_$][\w$]*").match(text, at)
            if js and w:
                emit("HASHID")
                at = w.end()
            else:
                emit("BAD")
        elif op in (">>=",):
            emit("AS")
        elif op in ("===", "!==", "**", "??") and not js or op in ("&^",) and not go:
            emit("BAD")
        else:
            emit("BI")
    if go and prev in _GO_ENDS:
        emit("SM")
    if len(stack) > 1:
        out.append(("OPEN", line))
    out.append(("^EOF" if js else "EOF", line))
    return out


_GO_ENDS = frozenset("ID FID TID PKG NUM STR break continue fallthrough return INC RP RB RCB RCO RCC".split())

_HCL = re.compile(r"(?P<s>[ \t\r\ufeff]+)|(?P<nl>\n)|(?P<lc>(?://|#)[^\n]*)|(?P<bc>/\*[\s\S]*?\*/)|(?P<here><<-?(?P<tag>\w+)[ \t]*\r?\n[\s\S]*?^[ \t]*(?P=tag)[ \t]*$)|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d][\w\-]*)|(?P<op>\.\.\.|=>|==|!=|<=|>=|&&|\|\||[{}()\[\],.?:!<>=+\-*/%])", re.M)


def _quoted(text: str, at: int) -> int:
    """The end of a quoted template that begins at `at`, -1 if it has none."""
    n, at = len(text), at + 1
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == '"':
            return at + 1
        elif c == "\n":
            return -1
        elif c in "$%" and text.startswith("{", at + 1) and text[at - 1] != c:
            at, depth = at + 2, 1
            while at < n and depth:
                if text[at] == '"':
                    at = _quoted(text, at)
                    if at < 0:
                        return -1
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            at += 1
    return -1


def lex_hcl(text: str) -> list[tuple[str, int]]:
    out, at, n, line, prev = [("BOF", 1)], 0, len(text), 1, "BOF"
    stack, assigned, quest = ["T"], False, 0

    def emit(cls: str) -> None:
        nonlocal prev
        out.append((cls, line))
        prev = cls

    while at < n:
        if (at == 0 or text[at - 1] == "\n") and CONFLICT.match(text, at):
            emit("CONFLICT")
            end = text.find("\n", at)
            at = n if end < 0 else end
            continue
        if text[at] == '"':
            end = _quoted(text, at)
            emit("OPEN" if end < 0 else "LBL" if stack[-1] in "TB" and not assigned else "STR")
            if end < 0:
                end = text.find("\n", at)
                end = n if end < 0 else end
            at = end
            continue
        m = _HCL.match(text, at)
        if not m:
            emit("OPEN" if text.startswith("/*", at) else "BAD")
            at = n if text.startswith("/*", at) else at + 1
            continue
        kind, v = m.lastgroup, m.group()
        if m.group("here"):
            kind = "here"
        at = m.end()
        if kind in ("s", "lc"):
            continue
        if kind == "bc":
            line += v.count("\n")
        elif kind == "nl":
            if prev not in ("NL",):
                emit("NL")
            line += 1
            if stack[-1] in "TB":
                assigned, quest = False, 0
        elif kind == "here":
            emit("STR")
            line += v.count("\n")
        elif kind == "num":
            emit("NUM")
        elif kind == "word":
            if v in ("for", "in", "if") and (stack[-1] in "OL") and (v != "for" or prev in ("LB", "LCO", "NL")):
                emit(v)
            elif stack[-1] in "TB" and not assigned:
                emit("KEY" if prev in ("BOF", "NL", "LCB") else "LBL")
            else:
                emit("ID")
        elif v == "{":
            block = stack[-1] in "TB" and not assigned
            emit("LCB" if block else "LCO")
            stack.append("B" if block else "O")
        elif v in "([":
            emit("LP" if v == "(" else "LB")
            stack.append("P" if v == "(" else "L")
        elif v in "})]" and len(v) == 1:
            want = {"}": "BO", ")": "P", "]": "L"}[v]
            if len(stack) > 1 and stack[-1] in want:
                was = stack.pop()
                emit({"B": "RCB", "O": "RCO", "P": "RP", "L": "RB"}[was])
            else:
                emit("STRAY")
        elif v == "=":
            assigned = True
            emit("AS")
        elif v == "=>":
            emit("AR")
        elif v == ":":
            if quest:
                quest -= 1
                emit("TC")
            else:
                emit("OC")
        elif v == "?":
            quest += 1
            emit("QM")
        elif v == ",":
            emit("CM")
        elif v == ".":
            emit("DOT")
        elif v == "...":
            emit("EL")
        elif v in "+-":
            emit("PM")
        elif v == "*":
            emit("STAR")
        elif v == "!":
            emit("UN")
        elif v == "<":
            emit("LT")
        elif v == ">":
            emit("GT")
        else:
            emit("BI")
    if len(stack) > 1:
        emit("OPEN")
    emit("EOF")
    return out


_PY_WORDS = set("def class if elif else while for in try except finally with as return raise from pass break continue del assert global nonlocal import lambda not and or is await async yield".split())
_PY = re.compile(
    r"(?P<s>[ \t\f]+|\\\r?\n)|(?P<nl>\r?\n)|(?P<c>#[^\n]*)|(?P<str>(?:[rRbBuUfFtT]{0,3})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'))"
    r"|(?P<num>0[xX][\da-fA-F_]+|0[bBoO][\d_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)|(?P<word>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\];,.:~<>=+\-*/%&|^@])"
)


_INDENT = re.compile(r"[ \t\f\ufeff]*")


def lex_python(text: str) -> list[tuple[str, int]]:
    out, at, n, line, prev, depth = [("BOF", 1)], 0, len(text), 1, "BOF", []
    indents, fresh = [0], True

    def emit(cls: str) -> None:
        nonlocal prev
        out.append((cls, line))
        prev = cls

    while at < n:
        if fresh and not depth:
            m = _INDENT.match(text, at)
            rest = text[m.end() : m.end() + 2]
            if rest[:1] in ("", "\n", "#") or rest == "\r\n":
                at = m.end()
                fresh = False
                if rest[:1] == "":
                    break
                continue
            if CONFLICT.match(text, at):
                emit("CONFLICT")
            width = len(m.group().expandtabs(8))
            if width > indents[-1]:
                indents.append(width)
                emit("INDENT")
            while width < indents[-1]:
                indents.pop()
                emit("DEDENT")
            if width != indents[-1]:
                emit("BAD")
                indents.append(width)
            at, fresh = m.end(), False
            continue
        if text[at] == " " and text[at + 1 : at + 2] != " ":
            at += 1
            continue
        m = _PY.match(text, at)
        if not m:
            if text[at] in "\"'":
                emit("OPEN")
                end = n if text[at : at + 3] in ('"""', "'''") else text.find("\n", at)
                at = n if end < 0 else end
            else:
                emit("BAD")
                at += 1
            continue
        kind, v, at = m.lastgroup, m.group(), m.end()
        if kind == "s":
            line += v.count("\n")
        elif kind == "c":
            continue
        elif kind == "nl":
            if not depth:
                if prev not in ("BOF", "NL", "INDENT", "DEDENT"):
                    emit("NL")
                fresh = True
            line += 1
        elif kind == "str":
            emit("STR")
            line += v.count("\n")
        elif kind == "num":
            emit("BAD" if (at < n and (text[at].isalpha() or text[at] == "_")) or re.match(r"0\d", v) and not re.search(r"[.eEjJ]", v) and v.strip("0_") else "NUM")
        elif kind == "word":
            emit(v if v in _PY_WORDS and prev != "DOT" else "ID")
        elif v in "([{":
            depth.append(v)
            emit({"(": "LP", "[": "LB", "{": "LC"}[v])
        elif v in ")]}":
            if depth and {"(": ")", "[": "]", "{": "}"}[depth[-1]] == v:
                depth.pop()
                emit({")": "RP", "]": "RB", "}": "RC"}[v])
            else:
                emit("STRAY")
        else:
            emit(
                {":": "CO", ";": "SM", ",": "CM", ".": "DOT", "...": "EL", "->": "AR", ":=": "WALRUS", "*": "STAR", "**": "POW", "/": "SLASH", "@": "AT", "~": "UN", "+": "PM", "-": "PM", "=": "AS"}.get(
                    v, "AS" if v[-1] == "=" and v not in ("==", "!=", "<=", ">=") else "BI"
                )
            )
    if depth:
        emit("OPEN")
    if prev not in ("BOF", "NL", "INDENT", "DEDENT"):
        emit("NL")
    for _ in indents[1:]:
        emit("DEDENT")
    emit("EOF")
    return out


_DATA = re.compile(r"(?P<s>[ \t\r\ufeff]+)|(?P<nl>\n)|(?P<str>\"(?:[^\"\\\n\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>true|false|null)|(?P<op>[{}\[\]:,])")
_TOML = re.compile(r"(?P<s>[ \t\r\ufeff]+)|(?P<nl>\n)|(?P<c>#[^\n]*)|(?P<str>\"\"\"[\s\S]*?\"\"\"\"{0,2}|'''[\s\S]*?''''{0,2}|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')|(?P<num>[+-]?(?:\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?|0[xob][\da-fA-F_]+|inf|nan|\d[\d_]*(?:\.[\d_]+)?(?:[eE][+-]?\d[\d_]*)?)(?![\w\-]))|(?P<word>[\w\-]+)|(?P<op>[{}\[\]=,.])")


def lex_data(text: str, language: str) -> list[tuple[str, int]]:
    """JSON and TOML."""
    toml = language == "toml"
    pattern = _TOML if toml else _DATA
    out, at, n, line, prev, depth = [("BOF", 1)], 0, len(text), 1, "BOF", 0
    while at < n:
        m = pattern.match(text, at)
        if not m:
            out.append(("BAD", line))
            end = text.find("\n", at)
            at = n if end < 0 else max(end, at + 1)
            continue
        kind, v, at = m.lastgroup, m.group(), m.end()
        cls = None
        if kind == "nl":
            line += 1
            cls = "NL" if toml and prev != "NL" else None
        elif kind in ("str", "num"):
            cls = kind.upper()
            line += v.count("\n")
        elif kind == "word":
            cls = "ID"
        elif kind == "op":
            cls = {"{": "LC", "}": "RC", "[": "LB", "]": "RB", ":": "CO", ",": "CM", "=": "AS", ".": "DOT"}[v]
            depth += (v in "{[") - (v in "}]")
        if cls:
            out.append((cls, line))
            prev = cls
    if depth:
        out.append(("OPEN", line))
    out.append(("EOF", line))
    return out


_SH_WORDS = set("if then elif else fi for while until do done case esac select function in".split())
_SH_OP = re.compile(r"&&|\|\||;;&|;;|;&|\|&|[;&|()]")
_SH_REDIR = re.compile(r"\d*(?:<<<|<<-?|<>|<&|>&|>>|>\||&>>|&>|<|>)(?!\()[ \t]*")


def _sh_word(text: str, at: int) -> int:
    """The end of a shell word that begins at `at`, -1 if a quote or substitution in it is never closed."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "'":
            end = text.find("'", at + 1)
            if end < 0:
                return -1
            at = end + 1
        elif c == '"':
            at = _sh_double(text, at)
            if at < 0:
                return -1
        elif c == "`":
            end = text.find("`", at + 1)
            if end < 0:
                return -1
            at = end + 1
        elif c == "$" and text[at + 1 : at + 2] in ("(", "{", "'", '"'):
            at = _sh_dollar(text, at)
            if at < 0:
                return -1
        elif c in "<>" and text[at + 1 : at + 2] == "(":
            at = _sh_close(text, at + 2, "(", ")")
            if at < 0:
                return -1
        elif c in " \t\r\n;&|()<>":
            return at
        else:
            at += 1
    return at


def _sh_dollar(text: str, at: int) -> int:
    if text.startswith("$((", at):
        end = _sh_close(text, at + 2, "(", ")")
        return end
    if text.startswith("$(", at):
        return _sh_close(text, at + 2, "(", ")")
    if text.startswith("${", at):
        return _sh_close(text, at + 2, "{", "}")
    if text.startswith('$"', at):
        return _sh_double(text, at + 1)
    end = at + 2
    while end < len(text) and text[end] != "'":
        end += 2 if text[end] == "\\" else 1
    return end + 1 if end < len(text) else -1


def _sh_double(text: str, at: int) -> int:
    n, at = len(text), at + 1
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == '"':
            return at + 1
        elif c == "$" and text[at + 1 : at + 2] in ("(", "{"):
            at = _sh_dollar(text, at)
            if at < 0:
                return -1
        elif c == "`":
            end = text.find("`", at + 1)
            if end < 0:
                return -1
            at = end + 1
        else:
            at += 1
    return -1


def _sh_close(text: str, at: int, opens: str, closes: str) -> int:
    n, depth = len(text), 1
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == "'" and opens == "(" or c == "'" and text[at - 1] == "$":
            end = text.find("'", at + 1)
            if end < 0:
                return -1
            at = end + 1
            continue
        if c == '"':
            at = _sh_double(text, at)
            if at < 0:
                return -1
            continue
        if c == "$" and text[at + 1 : at + 2] in ("(", "{"):
            at = _sh_dollar(text, at)
            if at < 0:
                return -1
            continue
        if c == "#" and opens == "(" and text[at - 1] in " \t\n":
            end = text.find("\n", at)
            at = n if end < 0 else end
            continue
        if c == opens:
            depth += 1
        elif c == closes:
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def lex_shell(text: str) -> list[tuple[str, int]]:
    out, at, n, line, prev = [("BOF", 1)], 0, len(text), 1, "BOF"
    stack: list[str] = []
    heredocs: list[tuple[str, bool]] = []
    command = frozenset("BOF SM NL AMP AND OR PIPE BANG TIME then else elif do if while until LC LP DSEMI FN PATP".split())

    def emit(cls: str) -> None:
        nonlocal prev
        out.append((cls, line))
        prev = cls

    while at < n:
        c = text[at]
        if c in " \t\r":
            at += 1
        elif c == "\\" and text[at + 1 : at + 2] == "\n":
            at, line = at + 2, line + 1
        elif c == "#":
            end = text.find("\n", at)
            at = n if end < 0 else end
        elif c == "\n":
            if prev not in ("NL",):
                emit("NL")
            at, line = at + 1, line + 1
            for tag, strip in heredocs:
                while at < n:
                    end = text.find("\n", at)
                    end = n if end < 0 else end
                    body = text[at:end]
                    at, line = end + 1, line + 1
                    if (body.lstrip("\t") if strip else body).rstrip("\r") == tag:
                        break
            heredocs = []
        elif prev in command and text.startswith("((", at):
            end = _sh_close(text, at + 1, "(", ")")
            emit("ARITH" if end >= 0 else "OPEN")
            end = n if end < 0 else end
            line += text.count("\n", at, end)
            at = end
        elif prev == "for" and text.startswith("((", at):
            end = _sh_close(text, at + 1, "(", ")")
            emit("ARITH" if end >= 0 else "OPEN")
            at = n if end < 0 else end
        elif prev in command and text.startswith("[[", at) and text[at + 2 : at + 3] in " \t":
            end = text.find("]]", at)
            emit("TEST" if end >= 0 else "OPEN")
            end = n if end < 0 else end + 2
            line += text.count("\n", at, end)
            at = end
        elif stack and stack[-1] == "case" and (m := re.compile(r"\(?(?=[^\s()])(?:[^()\n\"'\\]|\\[\s\S]|\"[^\"\n]*\"|'[^'\n]*'|(?<=\|)\s*\n\s*)*\)").match(text, at)) and prev in ("in", "NL", "DSEMI", "SM") and not re.compile(r"esac\b").match(text, at):
            emit("PAT")
            prev = "PATP"
            stack.append("clause")
            at = m.end()
        elif (m := _SH_REDIR.match(text, at)) and not (c.isdigit() and prev not in command and False):
            here = re.match(r"\d*<<(-?)[ \t]*$", m.group())
            start = m.end()
            end = _sh_word(text, start) if start < n and (text[start] not in "\n;&|()<>" or text[start : start + 2] in ("<(", ">(")) else start
            if end < 0 or end == start:
                emit("OPEN" if end < 0 else "BAD")
                at = n if end < 0 else start
                continue
            if here and "<<<" not in m.group():
                heredocs.append((re.sub(r"[\"'\\]", "", text[start:end]), here[1] == "-"))
            emit("REDIR")
            line += text.count("\n", at, end)
            at = end
        elif m := _SH_OP.match(text, at):
            v, at = m.group(), m.end()
            if v in (";;", ";&", ";;&"):
                emit("DSEMI")
                if stack and stack[-1] == "clause":
                    stack.pop()
            elif v == "(":
                if prev == "ASG":
                    end = _sh_close(text, at, "(", ")")
                    emit("ARR" if end >= 0 else "OPEN")
                    end = n if end < 0 else end
                    line += text.count("\n", at, end)
                    at = end
                else:
                    emit("LP")
                    stack.append("(")
            elif v == ")":
                if stack and stack[-1] == "(":
                    stack.pop()
                    emit("RP")
                else:
                    emit("STRAY")
            else:
                emit({"&&": "AND", "||": "OR", "|": "PIPE", "|&": "PIPE", ";": "SM", "&": "AMP"}[v])
        else:
            if (prev in command or prev == "function") and (m := re.compile(r"[^\s;&|()<>\"'$`\\]+[ \t]*\([ \t]*\)").match(text, at)):
                emit("FN")
                at = m.end()
                continue
            end = _sh_word(text, at)
            if end < 0:
                emit("OPEN")
                at = n
                continue
            if end == at:
                emit("BAD")
                at += 1
                continue
            w = text[at:end]
            line += w.count("\n")
            at = end
            start_ok = prev in command or prev == "WORD" and out[-2][0] == "function" or prev in ("fi", "done", "esac", "RC", "RP", "TEST", "ARITH", "PATP")
            if start_ok and w in _SH_WORDS and w != "in":
                emit(w)
                if w in ("if", "case"):
                    stack.append(w)
                elif w in ("for", "while", "until", "select"):
                    stack.append("loop")
                elif w in ("fi", "done", "esac"):
                    if w == "esac" and stack and stack[-1] == "clause":
                        stack.pop()
                    want = {"fi": "if", "done": "loop", "esac": "case"}[w]
                    if stack and stack[-1] == want:
                        stack.pop()
                    else:
                        out[-1] = ("STRAY", line)
            elif w == "in" and len(out) >= 2 and (out[-2][0] in ("for", "case", "select") or prev == "NL" and out[-3][0] in ("for", "case", "select")):
                emit("in")
            elif start_ok and w == "{":
                emit("LC")
                stack.append("{")
            elif start_ok and w == "}":
                if stack and stack[-1] == "{":
                    stack.pop()
                    emit("RC")
                else:
                    emit("STRAY")
            elif prev in command and w == "!":
                emit("BANG")
            elif prev in command and w == "time":
                emit("TIME")
            elif (prev in command or prev in ("ASG", "ARR", "WORD")) and re.match(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=", w) and re.match(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=$", w) and text[at : at + 1] == "(":
                emit("ASG")
            elif prev in command and re.match(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=", w):
                emit("ASG")
                if text[at : at + 1] != "(":
                    prev = "BOFA"
                    out[-1] = ("ASG", line)
                    prev = "ASG"
            elif prev == "ASG" and w in _SH_WORDS:
                emit("WORD")
            else:
                emit("WORD")
    if stack:
        emit("OPEN")
    emit("EOF")
    return out


_SQL = re.compile(
    r"(?P<s>\s+)|(?P<c>--[^\n]*|#[^\n]*)|(?P<bc>/\*[\s\S]*?\*/)|(?P<dollar>\$(?P<tag>\w*)\$[\s\S]*?\$(?P=tag)\$)|(?P<str>[eEnNxXbB]?'(?:[^']|'')*')|(?P<id>\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[A-Za-z_]\w*\])|(?P<num>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d][\w$]*|[@:][A-Za-z_]\w*|\$\d+)"
    r"|(?P<op>::|<=>|<=|>=|<>|!=|\|\||:=|->>|->|[-+*/%<>=~^&|!?(),;.:\[\]])"
)


def lex_sql(text: str) -> list[tuple[str, int, str]]:
    """(class, line, word in capitals); classes KW-like words stay ID, productions judge them."""
    out, at, n, line, depth = [("BOF", 1, "")], 0, len(text), 1, 0
    while at < n:
        if (at == 0 or text[at - 1] == "\n") and CONFLICT.match(text, at):
            out.append(("CONFLICT", line, ""))
            end = text.find("\n", at)
            at = n if end < 0 else end
            continue
        m = _SQL.match(text, at)
        if not m:
            out.append(("OPEN" if text[at] in "'\"`$" or text.startswith("/*", at) else "BAD", line, ""))
            at = n if text[at] in "'\"`" or text.startswith("/*", at) else at + 1
            continue
        kind, v = m.lastgroup, m.group()
        if m.group("dollar"):
            kind = "dollar"
        at = m.end()
        if kind not in ("s", "c", "bc"):
            if kind == "word":
                out.append(("ID", line, v.upper()))
            elif kind == "num":
                out.append(("BAD" if at < n and (text[at].isalpha() or text[at] == "_") else "NUM", line, ""))
            elif kind == "op":
                if v == "(":
                    depth += 1
                elif v == ")":
                    depth -= 1
                cls = {"(": "LP", ")": "RP", ",": "CM", ";": "SM", ".": "DOT"}.get(v, "OP")
                out.append(("STRAY" if cls == "RP" and depth < 0 else cls, line, v))
                depth = max(depth, 0)
            else:
                out.append(({"str": "STR", "dollar": "STR", "id": "ID"}[kind], line, ""))
        line += v.count("\n")
    if depth:
        out.append(("OPEN", line, ""))
    out.append(("EOF", line, ""))
    return out


def lex(text: str, language: str) -> list[tuple[str, int]]:
    """The tokens of a text; the last is EOF."""
    if language in ("javascript", "typescript", "java", "go"):
        return lex_c(text, language)
    if language == "terraform":
        return lex_hcl(text)
    if language == "python":
        return lex_python(text)
    if language in ("json", "toml"):
        return lex_data(text, language)
    if language == "shell":
        return lex_shell(text)
    raise ValueError(language)
