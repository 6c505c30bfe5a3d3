"""The rule engine: line rules as one expression over exploded lines, content rules by offsets of matches.

A file is tested for the expressions of a family before its lines are exploded, rules below a threshold are left out
while the plan is built, and all groups of all families are judged in one pass over each line. Everything but the mask
of PowerShell scripts stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re._constants import LITERAL
from re._parser import parse as parse_pattern

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import SEVERITIES, severity_ord, strip_inline_comment
from lintlake.operators.catalog_rules import CONTENT, FAMILIES, SQL_CONDITIONS, Family


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of (path, content); lines count from 1, a null content has none."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def _kept(rules, threshold: str):
    least = SEVERITIES.index(threshold)
    return [r for r in rules if SEVERITIES.index(r[2]) >= least]


def _quoted(text: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in_file(pattern: str, strip: bool) -> str:
    """The expression of a line as one of a whole text, which matches wherever some line of it does."""
    flags, body = re.match(r"(?:\(\?(\w+)\))?(.*)", pattern, re.S).groups()
    if strip:
        # A comment that is cut off ends a line, too.
        body = body.replace("|$", "|$|#").replace("\\s)", "\\s|#)")
    return f"(?m{flags or ''})(?:{body})"


@lru_cache(1000)
def needle(pattern: str) -> str:
    """The longest text in lower case that whatever a pattern matches holds, as far as its outermost level tells; or nothing."""
    best, run = "", ""
    for op, arg in parse_pattern(pattern):
        run = run + chr(arg).lower() if op is LITERAL and arg < 128 else ""
        best = max(best, run, key=len)
    return best


def findings_of(files: DataFrame, families: list[Family | str], threshold: str = "LOW") -> DataFrame:
    """(path, line, rule_id, issue_type, severity, confidence) of (path, content) by several families in one pass.

    Where files have a `language`, a family is judged on files of its languages only. A file is tested for each family's
    expressions as a whole, first for a text each of them needs; its lines are exploded once, if any family may match,
    and judged by all that may. The conditions are written as SQL, which is quicker to build than columns.
    """
    families = [FAMILIES[f] if isinstance(f, str) else f for f in families]
    flags, judged, rules = [], [], []
    for family in families:
        groups = [(name, mode, kind, kept) for name, mode, kind, every in family.groups if (kept := _kept(every, threshold))]
        tests = []
        for pattern in dict.fromkeys(r[1] for g in groups for r in g[3]):
            word = needle(pattern)
            tests.append((f"contains(low, {_quoted(word)}) and " if word else "") + f"content rlike {_quoted(_in_file(pattern, family.strip))}")
        hit = " or ".join(f"({t})" for t in tests) or "false"
        if "language" in files.columns:
            hit = f"language in ({', '.join(map(_quoted, family.languages))}) and ({hit})"
        flags.append(f"coalesce({hit}, false) as _{family.name}")
        for group, words, part in family.needs:
            met = " and ".join(f"contains(content, {_quoted(w)})" for w in words)
            flags.append(f"coalesce(({met}){f' or contains(path, {_quoted(part)})' if part else ''}, false) as _{family.name}_{group}")
        text = "bare" if family.strip else "text"
        when = f"_{family.name}" + (f" and not text rlike {_quoted(family.skip)}" if family.skip else "") + (f" and text rlike {_quoted(family.only)}" if family.only else "")
        contexts, own = {group for group, _, _ in family.needs}, []
        for name, mode, kind, kept in groups:
            context = f"_{family.name}_{name} and " if name in contexts else ""
            cases = []
            for rule in kept:
                cases.append(f"when {context}{text} rlike {_quoted(rule[1])} then {len(rules)}")
                rules.append((rule[0], kind, rule[2], float(rule[3])))
            own += [f"case {' '.join(cases)} end"] if mode == "first" else [f"case {c} end" for c in cases]
        judged.append(f"case when {when} then array({', '.join(own) or 'cast(null as int)'}) else array() end")
    if not rules:
        return files.selectExpr("path", "0 as line", "'' as rule_id", "'' as issue_type", "'' as severity", "0d as confidence").limit(0)
    low = files.withColumn("low", F.lower("content")).selectExpr("path", "content", *flags)
    names = " or ".join(f"_{family.name}" for family in families)
    carried = [c for c in low.columns if c.startswith("_")]
    # An outer explode of nothing where no family may match: a filter would be pushed down and test each file twice.
    rows = low.selectExpr("path", *carried, f"posexplode_outer(case when {names} then split(content, '\n') end) as (pos, text)").where("text is not null")
    cut = " or ".join(f"_{family.name}" for family in families if family.strip)
    if cut:
        rows = rows.withColumn("bare", F.when(F.expr(cut), strip_inline_comment(F.col("text"))))
    found = rows.selectExpr("path", "pos + 1 as line", f"explode(array_compact(concat({', '.join(judged)}))) as k")
    table = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), F.lit(c).alias("confidence")) for r, t, s, c in rules])
    return found.select("path", "line", F.get(table, F.col("k")).alias("f")).select("path", "line", "f.*")


def line_findings(files: DataFrame, family: Family | str, threshold: str = "LOW") -> DataFrame:
    """(path, line, rule_id, issue_type, severity, confidence) of (path, content) by one family."""
    return findings_of(files.select("path", "content"), [family], threshold)


def line_findings_sql(family: Family | str, files_sql: str, strip: bool = True) -> str:
    """The same as `line_findings` in DuckDB's SQL, over a query of (path, content)."""
    family = FAMILIES[family] if isinstance(family, str) else family
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    needs = {group: (words, part) for group, words, part in family.needs}
    text = "text"
    if family.strip:
        text = """regexp_extract(text, '^((?:[^#''"]|''[^'']*''|"[^"]*"|''[^'']*$|"[^"]*$)*)', 1)"""
    test = lambda r: SQL_CONDITIONS.get(r[0]) or f"regexp_matches(t, {quote(r[1])})"
    parts, contexts = [], []
    for group, (words, part) in needs.items():
        met = " AND ".join(f"contains(content, {quote(w)})" for w in words)
        contexts.append(f"({met}{f' OR contains(path, {quote(part)})' if part else ''}) AS in_{group}")
    for name, mode, kind, rules in family.groups:
        where = f" WHERE in_{name}" if name in needs else ""
        if mode == "first":
            chosen = lambda k: "CASE " + " ".join(f"WHEN {test(r)} THEN {quote(r[k]) if k != 3 else f'{r[3]}::DOUBLE'}" for r in rules) + " END"  # noqa: E731, B023
            parts.append(f"SELECT path, line, {chosen(0)} AS rule_id, {quote(kind)} AS issue_type, {chosen(2)} AS severity, {chosen(3)} AS confidence FROM l{where}")
        else:
            parts += [f"SELECT path, line, {quote(r[0])} AS rule_id, {quote(kind)} AS issue_type, {quote(r[2])} AS severity, {r[3]}::DOUBLE AS confidence FROM l WHERE {test(r)}{where.replace(' WHERE', ' AND')}" for r in rules]
    where = []
    if family.skip:
        where.append(f"NOT regexp_matches(text, {quote(family.skip)})")
    if family.only:
        where.append(f"regexp_matches(text, {quote(family.only)})")
    flags = "".join(f", {c}" for c in contexts)
    carried = "".join(f", in_{g}" for g in needs)
    return f"""
WITH s AS (SELECT path, string_split(content, chr(10)) AS p{flags} FROM ({files_sql}) WHERE content IS NOT NULL),
x AS (SELECT path, unnest(p) AS text, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS line{carried} FROM s),
l AS (SELECT path, line, {text} AS t{carried} FROM x {"WHERE " + " AND ".join(where) if where else ""})
SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE rule_id IS NOT NULL"""


#: comments and strings of PowerShell
POWERSHELL_TOKEN = re.compile(r"<#[\s\S]*?(?:#>|\Z)|#[^\n]*|'(?:[^']++|'')*+(?:'|\Z)|\"(?:[^\"`]++|`\"?)*+(?:\"|\Z)")


def powershell_mask(content: str) -> str:
    """A script with the letters of its comments and strings blanked, quotes, line breaks and length kept."""

    def blank(m: re.Match) -> str:
        token = m.group()
        quote = token[0] if token[0] in "'\"" else ""
        inner = token[1:-1] if quote and len(token) > 1 and token[-1] == quote else token[len(quote) :]
        ends = (quote, quote if quote and len(token) > 1 and token[-1] == quote else "")
        return ends[0] + re.sub(r"[^\n']" if quote == "'" else r"[^\n]", " ", inner) + ends[1]

    return POWERSHELL_TOKEN.sub(blank, content)


def masked_scripts(files: DataFrame) -> DataFrame:
    """(path, content) of PowerShell scripts as they are to be scanned."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["content"] = batch["content"].map(powershell_mask)
            yield batch

    return files.select("path", "content").where("content is not null").mapInPandas(look, "path string, content string")


def _breaks(text: Column) -> Column:
    """Line breaks in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def content_findings(files: DataFrame, family: str) -> DataFrame:
    """(path, line, rule_id, severity, confidence) of every match of the family's rules over whole contents.

    Contents are read once for all rules. A match's line is the sum of the line breaks before it, taken over the matches
    of its file and rule in order. PowerShell is scanned without its comments and strings.
    """
    files = (masked_scripts(files) if family == "powershell" else files).select("path", "content").withColumn("_file", F.monotonically_increasing_id())

    def spans(k: int, pattern: str) -> Column:
        between = F.transform(F.split("content", pattern), _breaks)
        within = F.transform(F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1)), _breaks)
        number = lambda pair, nth: F.struct(F.lit(k).alias("rule"), nth.alias("nth"), F.coalesce(pair["0"], F.lit(0)).alias("before"), pair["1"].alias("own"))
        return F.when(F.col("content").rlike(pattern), F.filter(F.transform(F.arrays_zip(between, within), number), lambda m: m["own"].isNotNull()))

    kind = "array<struct<rule:int,nth:int,before:int,own:int>>"
    found = files.select("path", "_file", F.explode(F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (spans(k, r[1]) for k, r in enumerate(CONTENT[family]))])).alias("m")).select("path", "_file", "m.*")
    upto = Window.partitionBy("_file", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("line", (F.sum(F.col("before") + F.col("own")).over(upto) - F.col("own") + 1).cast("int"))
    rules = F.array(*[F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[2]).alias("severity"), F.lit(r[3]).alias("confidence")) for r in CONTENT[family]])
    return placed.select("path", "line", F.get(rules, F.col("rule")).alias("r")).select("path", "line", "r.*")


def with_threshold(findings: DataFrame, threshold: str = "MEDIUM") -> DataFrame:
    """Findings at or above a severity; unknown severities are below all."""
    return findings.where(severity_ord(F.col("severity")) >= SEVERITIES.index(threshold))
