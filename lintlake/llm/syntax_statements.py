"""Statements of the languages whose productions are judged line by line: Python, SQL, YAML and Dockerfiles.

A statement is (seq, indent, head, shape). A shape is judged once for all files; what depends on neighbours (blocks,
handlers, mapping keys) is judged by windows over a file's statements in `syntax`.
"""

from __future__ import annotations

import re

from lintlake.llm.syntax_lex import CONFLICT, lex_python, lex_sql

PYTHON_BLOCKS = frozenset("def class if elif else for while try except finally with async".split())


def python_statements(tokens: list[tuple[str, int]]) -> list[tuple[int, int, str, str]]:
    """A row per statement: its head, and `block` when it opens one, `inline` when it holds one, `cut` when its colon is missing."""
    out, depth, indent, head, colon, last = [], 0, 0, None, False, ""
    lambdas = 0
    for t, _ in tokens:
        if t == "INDENT":
            indent += 1
        elif t == "DEDENT":
            indent -= 1
        elif t == "NL" and head is not None:
            shape = "plain"
            if head in PYTHON_BLOCKS:
                shape = "cut" if not colon else "block" if last == "CO" else "inline"
            elif head == "from" and "import" not in seen:
                shape = "cut"
            out.append((len(out), indent, head, shape))
            head = None
        elif t not in ("BOF", "EOF", "NL"):
            if head is None:
                head, colon, lambdas, seen = t, False, 0, set()
            seen.add(t)
            depth += (t in ("LP", "LB", "LC")) - (t in ("RP", "RB", "RC"))
            if t == "lambda":
                lambdas += 1
            if t == "CO" and not depth:
                if lambdas:
                    lambdas -= 1
                else:
                    colon = True
            last = t
    return out


# Words of SQL that shape a statement, and verbs that may begin one.
SQL_WORDS = frozenset(
    "SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET UNION ALL EXCEPT INTERSECT INSERT INTO OVERWRITE VALUES UPDATE SET DELETE CREATE OR REPLACE TEMP TEMPORARY GLOBAL LOCAL UNLOGGED EXTERNAL TABLE IF NOT EXISTS "
    "VIEW MATERIALIZED INDEX UNIQUE ON USING AS WITH RECURSIVE JOIN LEFT RIGHT FULL INNER OUTER CROSS NATURAL LATERAL AND IN IS LIKE ILIKE BETWEEN CASE WHEN THEN ELSE END DISTINCT DEFAULT RETURNING ALTER DROP TRUNCATE "
    "GRANT REVOKE TO MERGE MATCHED ADD COLUMN CONSTRAINT PRIMARY FOREIGN KEY REFERENCES CHECK".split()
)
SQL_VERBS = frozenset(
    "SELECT WITH VALUES INSERT UPDATE DELETE MERGE CREATE ALTER DROP TRUNCATE GRANT REVOKE SET USE BEGIN START COMMIT ROLLBACK END SAVEPOINT RELEASE EXPLAIN ANALYZE VACUUM COMMENT COPY CALL EXEC EXECUTE DECLARE DO SHOW DESCRIBE "
    "DESC PRAGMA REINDEX REFRESH LOCK UNLOCK PREPARE DEALLOCATE FETCH CLOSE OPEN REPLACE RENAME ATTACH DETACH LOAD INSTALL CHECKPOINT DISCARD LISTEN NOTIFY RESET CLUSTER TABLE PIVOT UNPIVOT GO DELIMITER".split()
)
_NAME = r"i(?: \. i)*"
_TAIL = r"(?:.* )?(?:i|n|s|\(q?\)|END|DEFAULT|ALL|\*|KEY|COLUMN|TABLE|UNIQUE|INDEX|TO|MATCHED)"
SQL_SHAPES = {
    "SELECT": re.compile(rf"SELECT (?!(?:FROM|WHERE|,)(?: |$)){_TAIL}$"),
    "WITH": re.compile(rf"WITH (?:RECURSIVE )?{_NAME}(?: \(q?\))? AS (?:(?:NOT )?MATERIALIZED )?\(q?\)(?: , {_NAME}(?: \(q?\))? AS (?:(?:NOT )?MATERIALIZED )?\(q?\))* (?:SELECT|INSERT|UPDATE|DELETE|MERGE|VALUES|\(q?\)){_TAIL}?$|WITH .* (?:SELECT|INSERT|UPDATE|DELETE|VALUES) {_TAIL}$"),
    "VALUES": re.compile(r"VALUES \(q?\)(?: , \(q?\))*(?: (?:ORDER|LIMIT|UNION) .*)?$"),
    "INSERT": re.compile(rf"INSERT (?:(?:OR i|OR REPLACE|i) )*(?:INTO |OVERWRITE )(?:TABLE )?{_NAME}(?: AS i)?(?: \(\))?(?: i i)*(?: \(\))? (?:VALUES \(q?\)(?: ,? ?\(q?\))*|(?:SELECT|WITH) {_TAIL}|DEFAULT VALUES|\(q\)|SET .+)(?: (?:ON|RETURNING|AS|WHERE|UNION|EXCEPT) {_TAIL})?$"),
    "UPDATE": re.compile(rf"UPDATE (?:i )?{_NAME}(?: (?:AS )?i)? (?:.* )?SET .+ o {_TAIL}$"),
    "DELETE": re.compile(rf"DELETE (?:.* )?FROM {_NAME}(?: (?:AS )?i)?(?: (?:WHERE|USING|RETURNING|LIMIT|ORDER|AS) {_TAIL})?$"),
    "CREATE": re.compile(
        rf"CREATE (?:(?:OR REPLACE|TEMP|TEMPORARY|GLOBAL|LOCAL|UNLOGGED|EXTERNAL|i) )*(?:TABLE (?:IF NOT EXISTS )?{_NAME} (?:\(q?\).*|AS {_TAIL}|LIKE .+|USING .+|i .+)"
        rf"|(?:UNIQUE )?INDEX (?:i )?(?:IF NOT EXISTS )?(?:{_NAME} )?ON (?:i )?{_NAME}(?: USING i)? \(q?\).*|(?:MATERIALIZED )?(?:RECURSIVE )?VIEW (?:IF NOT EXISTS )?{_NAME}(?: \(q?\))?(?: WITH \(q?\))? AS {_TAIL}|i .+|OR .+)$"
    ),
    "ALTER": re.compile(r"ALTER \S+ \S+ .*"),
    "DROP": re.compile(r"DROP \S+ (?:IF EXISTS )?\S+.*"),
    "TRUNCATE": re.compile(r"TRUNCATE \S+.*"),
    "GRANT": re.compile(r"GRANT .+ TO \S+.*|GRANT i TO \S+.*"),
    "REVOKE": re.compile(r"REVOKE .+ FROM \S+.*"),
    "MERGE": re.compile(r"MERGE INTO .+ USING .+ ON .+"),
    "SET": re.compile(r"SET \S+.*"),
}
_SHORT_VERBS = frozenset("BEGIN COMMIT ROLLBACK END GO ANALYZE VACUUM CHECKPOINT".split())


def sql_statements(text: str) -> tuple[list[tuple[str, int]], list[tuple[int, int, str, str]]]:
    """The tokens and a row per statement, its shape being its words outside parentheses."""
    tokens = lex_sql(text)
    out, depth, words, head = [], 0, [], None
    for k, (cls, _, word) in enumerate(tokens):
        if cls in ("BOF",):
            continue
        if cls in ("SM", "EOF") and depth == 0 or cls == "EOF":
            if words:
                out.append((len(out), 0, head, " ".join(words)))
            words, head = [], None
            continue
        if head is None:
            head = word if cls == "ID" and word else "(" if cls == "LP" else "?"
        if cls == "LP":
            depth += 1
            if depth == 1:
                words.append("(q)" if tokens[k + 1][2] in ("SELECT", "WITH") else "()")
        elif cls == "RP":
            depth -= 1
        elif depth == 0:
            words.append(word if word in SQL_WORDS else {"ID": "i", "NUM": "n", "STR": "s", "CM": ",", "DOT": ".", "OP": "*" if word == "*" else "o"}.get(cls, "?"))
    return [(c, line) for c, line, _ in tokens], out


def legal_sql(head: str, shape: str) -> bool:
    if head == "(":
        return True
    if head not in SQL_VERBS:
        return False
    if head in SQL_SHAPES:
        return bool(SQL_SHAPES[head].match(shape))
    return head in _SHORT_VERBS or " " in shape


DOCKER = frozenset("FROM RUN CMD LABEL MAINTAINER EXPOSE ENV ADD COPY ENTRYPOINT VOLUME USER WORKDIR ARG ONBUILD STOPSIGNAL HEALTHCHECK SHELL".split())
_HERE = re.compile(r"<<-?[\"']?([A-Za-z_]\w*)[\"']?")


def docker_statements(text: str) -> list[tuple[int, int, str, str]]:
    """A row per instruction: its name, and how many words and pairs its arguments have, or `open` for an unclosed quotation."""
    out, lines, k = [], text.replace("\r\n", "\n").split("\n"), 0
    escape = "`" if re.match(r"(?i)^\s*#\s*escape\s*=\s*`", text) else "\\"
    while k < len(lines):
        line = lines[k]
        k += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        whole = line
        while whole.rstrip().endswith(escape) and k < len(lines):
            whole = whole.rstrip()[:-1]
            while k < len(lines) and (lines[k].lstrip().startswith("#") or not lines[k].strip()):
                k += 1
            if k < len(lines):
                whole += lines[k]
                k += 1
        head, _, rest = whole.strip().partition(" ")
        if "\t" in head:
            head, _, rest = whole.strip().partition("\t")
        name, rest = head.upper(), rest.strip()
        if name in ("RUN", "COPY", "ADD"):
            for tag in _HERE.findall(rest):
                end = next((j for j in range(k, len(lines)) if lines[j].strip("\t").rstrip() == tag), None)
                if end is None:
                    out.append((len(out), 0, name, "open"))
                    k = len(lines)
                    break
                k = end + 1
        words = [w for w in rest.split() if not (w.startswith("--") and name in ("FROM", "RUN", "COPY", "ADD", "HEALTHCHECK"))]
        bare = re.sub(r"\\.|\"(?:[^\"\\]|\\.)*\"|'[^']*'", "q", rest)
        shape = f"{min(len(words), 3)} words"
        if name in ("LABEL", "ENV"):
            if re.search(r"[\"']", bare):
                shape = "open"
            elif all("=" in w for w in bare.split()) and words:
                shape = "pairs"
        if rest.startswith("[") and name in ("COPY", "ADD"):
            shape = "2 words" if rest.endswith("]") and rest.count(",") else "1 words"
        out.append((len(out), 0, name if name in DOCKER else "?", shape))
    return out


def legal_docker(head: str, shape: str) -> bool:
    if head == "?" or shape == "open":
        return False
    if head == "LABEL":
        return shape == "pairs"
    if head == "ENV":
        return shape in ("pairs", "2 words", "3 words")
    if head in ("COPY", "ADD"):
        return shape in ("2 words", "3 words")
    if head in ("FROM",):
        return shape in ("1 words", "3 words")
    if head in ("USER", "STOPSIGNAL"):
        return shape == "1 words"
    if head in ("CMD", "ENTRYPOINT"):
        return True
    return shape != "0 words"


_YAML_KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\-?:,\[\]{}&*!|>'\"%@`](?:[^:#]|:(?=\S)|(?<=\S)#)*?|[?:\-](?=\S)(?:[^:#]|:(?=\S)|(?<=\S)#)*?|<<)\s*:(?=\s|$)")


def yaml_statements(text: str) -> list[tuple[int, int, str, str]]:
    """A row per logical line: its indentation, how it begins (key, item, scalar, other) and what it holds."""
    out, lines, k = [], text.replace("\r\n", "\n").split("\n"), 0
    while k < len(lines):
        line = lines[k]
        k += 1
        body = line.lstrip(" ")
        indent = len(line) - len(body)
        if CONFLICT.match(line):
            out.append((len(out), indent, "other", "conflict"))
            continue
        if not body or body.startswith("#") or re.match(r"(?:---|\.\.\.)(?:\s|$)", line) or indent == 0 and body.startswith("%"):
            continue
        if body.startswith("\t"):
            out.append((len(out), indent, "other", "tab"))
            continue
        head, dashes = "scalar", 0
        while re.match(r"-(?:\s|$)", body):
            head = "item"
            rest = body[1:].lstrip(" ")
            indent_in = len(body) - len(rest)
            dashes += indent_in
            body = rest
        key = _YAML_KEY.match(body)
        if key:
            head = "key" if head == "scalar" else "item key"
            value = body[key.end() :].strip()
        else:
            value = body.strip()
        shape = "empty"
        if value and not value.startswith("#"):
            value = re.sub(r"^(?:[&!][^\s]*\s*)+", "", value)
            first = value[:1]
            if re.match(r"[|>][+\-\d]*\s*(?:#.*)?$", value):
                base = indent
                while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip(" ")) > base):
                    k += 1
                shape = "block"
            elif first in "\"'":
                shape = "quoted"
                closed = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"" if first == '"' else r"'(?:[^']|'')*'")
                joined = value
                while not closed.match(joined) and k < len(lines) and not CONFLICT.match(lines[k]):
                    joined += "\n" + lines[k]
                    k += 1
                m = closed.match(joined)
                if not m or joined[m.end() :].strip() and not joined[m.end() :].lstrip().startswith("#"):
                    shape = "open"
            elif first in "[{":
                shape = "flow"
                bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", "q", value)
                while bare.count("[") + bare.count("{") > bare.count("]") + bare.count("}") and k < len(lines):
                    bare += " " + re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", "q", lines[k])
                    k += 1
                if bare.count("[") != bare.count("]") or bare.count("{") != bare.count("}") or re.search(r"[\"']", bare) or re.search(r"[\]}]\s*[^\s,\]}#:]", bare):
                    shape = "open"
            elif first in "@`%" or re.search(r":(?:\s|$)", re.sub(r"\s#.*", "", value)) or first in "*&" and len(value) < 2:
                shape = "odd"
            else:
                shape = "plain"
        out.append((len(out), indent + dashes, head, shape))
    return out


_CONTROLS = frozenset("if else for while do switch try catch finally with synchronized".split())


def brace_statements(tokens: list[tuple[str, int]]) -> list[tuple[int, int, str, str]]:
    """(seq, block depth, head, shape) of `else`, `case` and `for` of JavaScript, TypeScript and Java; `orphan` follows no production.

    An `else` needs an open `if` before it in its block, a `case` the block of a `switch`, a `for` header none or two semicolons.
    Where statements end without semicolon or block, an `if` stays open, so nothing legal is an orphan.
    """
    out = []
    prev = closed = ""
    stack = [{"open": "", "head": "", "ifs": 0, "dos": 0, "semis": 0, "ended": False}]
    for k, (token, _) in enumerate(tokens):
        t, top = token.lstrip("^"), stack[-1]
        if top["ended"]:
            top["ended"] = False
            if t == "while" and top["dos"]:
                top["dos"] -= 1
            elif t not in ("else", "catch", "finally"):
                top["ifs"] = top["dos"] = 0
        if t == "SM":
            top["semis"] += 1
            top["ended"] = top["open"] != "LP"
        elif t == "if":
            top["ifs"] += 1
        elif t == "do":
            top["dos"] += 1
        elif t == "else":
            out.append((len(out), len(stack) - 1, "else", "if" if top["ifs"] else "orphan"))
            top["ifs"] = max(top["ifs"] - 1, 0)
        elif t == "case":
            following = tokens[k + 1][0].lstrip("^") if k + 1 < len(tokens) else ""
            if top["open"] == "LCB" and following not in ("CC", "XC", "TC", "LAB"):
                out.append((len(out), len(stack) - 1, "case", "switch" if top["head"] == "switch" else "orphan"))
        elif t in ("LP", "LB") or t.startswith("LC"):
            stack.append({"open": t, "head": closed if prev == "RPH" else prev, "ifs": 0, "dos": 0, "semis": 0, "ended": False})
        elif (t in ("RP", "RPH", "RB") or t.startswith("RC")) and len(stack) > 1:
            level = stack.pop()
            if level["open"] == "LP":
                closed = level["head"]
                if closed == "for":
                    out.append((len(out), len(stack) - 1, "for", "header" if level["semis"] in (0, 2) else "orphan"))
            stack[-1]["ended"] = level["open"].startswith("LC") and level["head"] in _CONTROLS
        prev = t
    return out


def statements(text: str, language: str, tokens: list[tuple[str, int]]) -> list[tuple[int, int, str, str]]:
    if language == "python":
        return python_statements(tokens)
    if language == "dockerfile":
        return docker_statements(text)
    if language == "yaml":
        return yaml_statements(text)
    if language in ("javascript", "typescript", "java"):
        return brace_statements(tokens)
    return []


def legal(language: str, head: str, shape: str) -> bool:
    """Whether a statement of this shape follows a production, its neighbours aside."""
    if language == "sql":
        return legal_sql(head, shape)
    if language == "dockerfile":
        return legal_docker(head, shape)
    if language == "python":
        return shape != "cut"
    return shape not in ("conflict", "tab", "open", "odd", "orphan") and not (language == "yaml" and head == "scalar" and shape != "empty")
