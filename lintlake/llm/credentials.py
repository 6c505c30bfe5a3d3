"""Problem 4: find credentials embedded in source code and redact them.

The texts go into a stored trigram index (`trigram_index`): postings of trigrams over chunks of texts, block by block.
What an expression requires of a text is derived from it (`trigrams.required`), the postings of those trigrams are
intersected, and the expression is run only on texts that are let through. A match counts when the value is literal: no
reference, placeholder, mask, hash or name. Expressions take time in proportion to a text, whatever it holds.

Parameters of the method: a value has at least `LEAST` characters, and one in quotes after a mere name at least
`LEAST_NAMED` unless it has digits or marks.

Null or empty text: no row. Repeated rows: each its own result. Of matches that overlap the outermost stays.
Positions are in code points from 1. Key columns may have any names and types.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from lintlake.llm.trigram_index import TrigramIndex
from lintlake.llm.trigrams import leaves, required

LEAST = 4
LEAST_NAMED = 8

# Words that name a secret, the last word of a name deciding; and words that qualify `key`.
SECRET_WORDS = "password passwd passphrase passwort kennwort contrasena contraseña contrasenya senha clave secret token jeton credential credentials pwd pw pass apikey authtoken accesstoken webhooksecret authorization auth".split()
KEY_QUALIFIERS = "api access secret private signing service encryption account master auth client shared storage deploy license webhook admin app crypto subscription".split()
MORE_NAMES = ("clave api", "mot de passe", "palabra de paso")
NAME_PARTS = "passw|passphrase|pwd|pass|[_.-]pw|kennwort|contrase|senha|clave|secret|token|jeton|credential|auth|key"

_VALUE = r"""(?:(?P<q>\\?["'`])(?P<c1>(?:(?!(?P=q))[^\n])*)(?P=q)|(?P<c2>[^\s'"`,;<>(){}\[\]]+)(?=(?P<after>.?)))"""
NAMED = rf"""(?i)(?<![\w.\-$])(?P<name>(?=[\w.\-$]*?(?:{NAME_PARTS}))[\w.\-$]++)(?P<nq>["'\]]*)[ \t]*(?P<op>=>|:=|[:=])[ \t]*{_VALUE}"""

#: name -> expression; the credential is the group c, or c1 or c2. Those of `NAMED` kind are judged by name too.
RULES: dict[str, str] = {
    "private_key": r"(?P<c>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\s|\\n|\\r)+(?>[^-\n:]+: [^\n]+\n)*+[A-Za-z0-9+/=\s\\]{24,}(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?)",
    "aws_key_id": r"(?<![A-Za-z0-9])(?P<c>(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16})(?![A-Za-z0-9])",
    "forge_token": r"(?<![A-Za-z0-9])(?P<c>gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{16,})",
    "chat_token": r"(?<![A-Za-z0-9])(?P<c>xox[abeoprs]-[A-Za-z0-9\-]{16,}|xapp-[A-Za-z0-9\-]{16,})",
    "live_key": r"(?<![A-Za-z0-9])(?P<c>(?:sk|rk|pk)_live_[A-Za-z0-9]{12,}|whsec_[A-Za-z0-9]{16,})",
    "package_token": r"(?<![A-Za-z0-9])(?P<c>npm_[A-Za-z0-9]{24,}|pypi-[A-Za-z0-9_\-]{24,}|dckr_pat_[A-Za-z0-9_\-]{16,}|hf_[A-Za-z0-9]{24,})",
    "cloud_key": r"(?<![A-Za-z0-9])(?P<c>AIza[A-Za-z0-9_\-]{30,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|sk-[A-Za-z0-9]{20,}|sk-(?:proj|ant)-[A-Za-z0-9_\-]{20,}|dop_v1_[a-f0-9]{40,})",
    "signed_token": r"(?<![A-Za-z0-9_\-])(?>[A-Za-z0-9_\-]*?(?<![A-Za-z0-9])(?=eyJ))(?P<c>eyJ[A-Za-z0-9_\-]{8,}+\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})",
    "url_user": r"(?<=[A-Za-z0-9+.\-])://[^\s:/@'\"<>]*:(?P<c>[^\s/'\"<>]+)@[A-Za-z0-9\[$]",
    "connection": r"(?i)(?:password|pwd|accountkey|sharedaccesskey|sharedsecret)=(?P<c>[^;\s'\"<>]+)",
    "named": NAMED,
    "element": rf"(?i)<(?P<name>(?=[\w.\-:]*?(?:{NAME_PARTS}))[\w.\-:]++)(?:\s[^<>]*)?>(?P<c1>[^<>\n]+)</",
    "attribute": rf"""(?i)(?:key|name)=["'](?P<name>(?=[\w.\-:]*?(?:{NAME_PARTS}))[\w.\-:]++)["']\s+value=["'](?P<c1>[^"'\n]+)""",
    "bearer": r"(?i)bearer\s+(?P<c>[A-Za-z0-9+/=_.~\-]{16,})",
    "basic": r"(?i)basic\s+(?P<b>[A-Za-z0-9+/]{8,}={0,2})",
    "docker_auth": r"\"auth\"\s*:\s*\"(?P<b>[A-Za-z0-9+/]{8,}={0,2})\"",
    "cobol_move": rf"(?i)move\s+(?P<q>[\"'])(?P<c1>[^\"'\n]+)(?P=q)\s+to\s+(?P<name>(?=[\w\-]*?(?:{NAME_PARTS}))[\w\-]++)",
    "secure_string": r"""(?i)convertto-securestring\s+(?:-string\s+)?["'](?P<c1>[^"'\n]+)["']""",
    "ssh_password": r"""sshpass\s+-p\s*["']?(?P<c1>[^\s"']+)""",
    "command_password": r"""(?:--password[= ]|--token[= ]|--secret[= ])["']?(?P<c2>[^\s"']+)""",
    "command_user": r"""(?P<flag>(?<=\s)-u|--user)[= ]["']?[^\s:"']+:(?P<c>[^\s"']+)""",
    "signature": r"[?&](?:sig|signature|access_token|api_key|apikey|token|key)=(?P<c>[A-Za-z0-9%+/_\-]{16,})",
    "spring_env": rf"(?i)\benv\s+(?P<name>(?=\w*?(?:{NAME_PARTS}))\w++)\s+(?P<c2>[^\s\"'=]+)",
    "default_call": rf"""(?i)(?:getenv|environ\.get|env)\(\s*["'](?P<name>(?=\w*?(?:{NAME_PARTS}))\w++)["']\s*,\s*["'](?P<c1>[^"'\n]+)["']\s*\)""",
}

_PLACEHOLDER = re.compile(
    r"""(?ix)^(?: \$(?:[{(]|env:|[a-z_]\w*(?:$|[./:])) | \{\{ | \{%? | <[^<>]*>?$ | %[({] | %[a-z_]+%$ | \#\{ | !(?:ref|sub|join|getatt|importvalue|vault|secret|env|include|reference)\b | ![a-z]+\s | @(?:\{|microsoft|[a-z.]+\()
     | \*{3,} | \*[a-z][a-z_\-]*$ | \[[a-z _\-]+\]$ | \.\.\. | … | &lt; | \([a-z _\-]+\)$ | env[.(:] | vault[.:/] | arn: | ref[+:] | secret://
     | (?:your|my|the|some|insert|enter|change|replace)[-_ ]? (?:own|me|this|it|here|pass|password|secret|token|api|key|value|with).* | x{3,}.* | -+$ | _+$ | \.+$
     | (?:none|null|nil|true|false|undefined|empty|redacted|masked|hidden|removed|changeme|change_?it|example|placeholder|dummy|todo|tbd|test|string|str|secret|password|passwd|token|optional|required|int|bool|bytes|any|self|config|settings)[?;]?$
    )"""
)
_MASKED = re.compile(r"\*{3,}|…|•|x{6,}|X{6,}|\$\{|\{\{|\$\(|<[a-z_ \-]+>|\(hidden\)|redacted", re.I)
_HASHED = re.compile(r"^(?:\$2[aby]\$|\$argon2|\$[156]\$|\{S?SHA|pbkdf2|scrypt|bcrypt|(?:md5|sha1|sha256|sha384|sha512)[-:$])", re.I)
_WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-zà-ÿ]+|[A-Z]+|\d+")
_PIECES = re.compile(r"""["'](?:\s*+(?:\+|\.|\|\||&)\s*+(?:\\\n\s*+)?["'][^"'\n]*["'])+""")


@lru_cache(10_000)
def secret_name(name: str) -> bool:
    """Whether the last word of a name, or its last two, mean a secret; only the end of a name is looked at."""
    name = name[-200:]
    words = [w.lower() for w in _WORD.findall(name)]
    while words and (words[-1].isdigit() or words[-1] in ("value", "val", "plain", "literal")):
        words.pop()
    if not words:
        return False
    last, joined = words[-1], " ".join(words)
    if any(joined.endswith(n) for n in MORE_NAMES):
        return True
    if last == "key":
        return len(words) > 1 and words[-2] in KEY_QUALIFIERS
    if last in SECRET_WORDS:
        return True
    return last.endswith(("password", "passwd", "apikey", "secret", "token", "secretkey", "accesskey", "privatekey"))


def literal_value(value: str, quoted: bool) -> bool:
    """Whether a value is a literal, not a reference, placeholder, mask or hash."""
    v = value.strip()
    if len(v) < LEAST or _PLACEHOLDER.match(v) or _MASKED.search(v) or _HASHED.match(v):
        return False
    if len(set(v)) < 4 and len(v) > 5:
        return False
    if quoted:
        return not re.search(r"\s", v)
    turns = len(re.findall(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]", v))
    mixed = re.search(r"\d", v) or len(v) >= 8 and (turns >= 4 or turns and re.search(r"[#*!%^&+?~]", v))
    if re.match(r"(?:[A-Z][a-z]+)+-(?:[A-Z][a-z]+)+$", v):
        return False
    return bool(mixed) and not v.replace(".", "").isdigit() and not re.match(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$", v)


def _pair(encoded: str) -> bool:
    """Whether an encoding holds user:password."""
    try:
        plain = base64.b64decode(encoded + "=" * (-len(encoded) % 4), validate=True).decode("utf-8")
    except ValueError:
        return False
    user, colon, word = plain.partition(":")
    return bool(colon and user and literal_value(word, True))


COMPILED = {name: re.compile(p) for name, p in RULES.items()}
GROUPS = {name: tuple(g for g in ("c", "c1", "c2", "b") if g in p.groupindex) for name, p in COMPILED.items()}


def spans(text: str, rules) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the credentials in a text, from 0, by the rules named."""
    found, curls = [], {}
    for rule in rules:
        for m in COMPILED[rule].finditer(text):
            group = next((g for g in GROUPS[rule] if m.group(g) is not None), None)
            if group is None:
                continue
            value, (a, b) = m.group(group), m.span(group)
            if rule == "command_user" and m.group("flag") == "-u" and not _by_curl(text, m.start(), curls):
                continue
            if "name" in COMPILED[rule].groupindex and not secret_name(m.group("name")):
                continue
            if group == "b":
                ok = _pair(value)
            elif rule == "private_key":
                ok = True
            elif group == "c2":
                after = m.groupdict().get("after") or ""
                ok = after not in ("(", "[") and literal_value(value, False)
            else:
                ok = literal_value(value, True)
            if group == "c1" and rule == "named" and len(value) < LEAST_NAMED and not re.search(r"\d|[^\w]", value):
                ok = False
            if not ok:
                continue
            if group == "c1" and rule == "named" and (more := _PIECES.match(text, b)):
                b = more.end() - 1
            found.append((a, b, rule))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def redact(text: str, places: list[tuple[int, int, str]], mark: str = "*") -> str:
    """The text with every credential's letters replaced, its length, line breaks, quotes and joins kept."""
    out, at = [], 0
    for a, b, rule in places:
        out.append(text[at:a])
        body = text[a:b]
        out.append(re.sub(r"[^\s\"'+]", mark, body) if rule == "named" and re.search(r"[\"']", body) else re.sub(r"\S", mark, body))
        at = b
    out.append(text[at:])
    return "".join(out)


def _by_curl(text: str, at: int, lines: dict[int, int]) -> bool:
    """Whether `curl` stands before a place in its line; every line is searched once."""
    start = text.rfind("\n", 0, at) + 1
    if start not in lines:
        found = re.compile(r"curl\s").search(text, start, at)
        if not found:
            return False
        lines[start] = found.start()
    return lines[start] < at


def credentials(texts: DataFrame, keys: list[str], column: str, with_text: bool = False) -> DataFrame:
    """A row per credential: the key columns, start_pos (from 1), end_pos (past its end), rule_name.

    With `with_text` a row per text that has any: the key columns, `places`, an array of those, and `redacted`.
    """
    index = TrigramIndex.scratch(texts.sparkSession)
    index.add(texts, keys, column, VOCABULARY)
    return search(index, keys, with_text)


def search(index: TrigramIndex, keys: list[str], with_text: bool = False) -> DataFrame:
    """`credentials` of all texts of an index."""

    def verify(text: str, rules: list[str]) -> list[tuple]:
        places = spans(text, rules)
        if with_text:
            return [([(a + 1, b + 1, rule) for a, b, rule in places], redact(text, places))] if places else []
        return [(a + 1, b + 1, rule) for a, b, rule in places]

    schema = "places array<struct<start_pos:int,end_pos:int,rule_name:string>>, redacted string" if with_text else "start_pos int, end_pos int, rule_name string"
    return index.search(FORMULAS, verify, keys, schema)


def candidates(texts: DataFrame, column: str) -> DataFrame:
    """Texts that some expression may match, with `rules`, the names of those expressions."""
    index = TrigramIndex.scratch(texts.sparkSession)
    index.add(texts, texts.columns, column, VOCABULARY)
    return index.search(FORMULAS, lambda text, rules: [(rules,)], texts.columns, "rules array<string>")


FORMULAS = {name: required(p) for name, p in RULES.items()}
VOCABULARY = set().union(*[leaves(f) for f in FORMULAS.values()])
