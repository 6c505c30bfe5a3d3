"""Python sources as rows: syntax-tree nodes, imports, assertions and facts, and the rules over them.

A file is parsed once; nodes carry their pre-order range, so containment needs no join, and facts carry the number of
functions that enclose them. A file that does not parse gives one node of type UNKNOWN and a quarantine row.
"""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import spread

NODES = "path string, node_id int, parent_id int, pre int, post int, depth int, node_type string, raw_type string, name string, line_start int, line_end int, complexity int, nesting int, param_count int"
FACTS = "path string, fact string, name string, line int, detail string, enclosing int"
# The general type of a syntax-tree node.
TYPES = {
    "Module": "MODULE", "FunctionDef": "FUNCTION", "AsyncFunctionDef": "ASYNC_FUNCTION", "ClassDef": "CLASS", "If": "CONDITIONAL", "For": "LOOP", "AsyncFor": "LOOP", "While": "LOOP", "Try": "TRY", "Call": "CALL",
    "Import": "IMPORT", "ImportFrom": "IMPORT", "Assign": "ASSIGNMENT", "Return": "RETURN",
}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try)
# Methods that change a collection, makers and closers of sessions.
MUTATORS = "append add update extend insert pop setdefault clear".split()
SESSIONS = "Session ClientSession connect Connection Client create_engine socket open_connection".split()
CLOSERS = "close disconnect shutdown dispose".split()


def _plain_children(node: ast.AST) -> list[ast.AST]:
    return [c for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop))]


def tree_rows(path: str, text: str, kinds: tuple[str, ...] = ()) -> list[tuple]:
    """Nodes of one file in pre-order, with `kinds` those alone; the tree is walked with a stack, so its depth is no limit."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(path, 0, None, 0, 0, 0, "UNKNOWN", "UNKNOWN", None, 1, text.count("\n") + 1, None, None, None)]
    nodes: list[tuple] = []
    stack = [(tree, None, 0)]
    while stack:
        node, parent, depth = stack.pop()
        stack += [(c, len(nodes), depth + 1) for c in reversed(_plain_children(node))]
        nodes.append((node, parent, depth))
    # From the last node to the first every subtree is complete: its size, its branches, and how deep they are nested.
    size, branches, nested = [1] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for me in range(len(nodes) - 1, 0, -1):
        node, parent, _ = nodes[me]
        own = isinstance(node, BRANCHES)
        size[parent] += size[me]
        branches[parent] += branches[me] + own
        nested[parent] = max(nested[parent], nested[me] + own)
    last, rows = text.count("\n") + 1, []
    for me, (node, parent, depth) in enumerate(nodes):
        if kinds and TYPES.get(type(node).__name__, "OTHER") not in kinds:
            continue
        raw, fn, name = type(node).__name__, isinstance(node, FUNCTIONS), getattr(node, "name", None)
        a = node.args if fn else None
        rows.append((
            path, me, parent, me, me + size[me] - 1, depth, TYPES.get(raw, "OTHER"), raw, name if isinstance(name, str) else None, getattr(node, "lineno", 1), getattr(node, "end_lineno", None) or last,
            1 + branches[me] if fn else None, nested[me] if fn else None, len(a.posonlyargs + a.args + a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg) if fn else None,
        ))
    return rows


def _name(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "")
    return ".".join(reversed(parts))


def _text(node: ast.AST) -> str:
    """The source of a node; of one too deeply nested to be written, nothing."""
    try:
        return ast.unparse(node)
    except RecursionError:
        return ""


def _trivial(stmt: ast.stmt) -> bool:
    if isinstance(stmt, ast.Pass) or isinstance(stmt, ast.Expr) and isinstance(stmt.value, ast.Constant) and stmt.value.value is ...:
        return True
    if isinstance(stmt, ast.Return):
        v = stmt.value
        return v is None or isinstance(v, ast.Constant) and not v.value or isinstance(v, ast.List) and not v.elts or isinstance(v, ast.Dict) and not v.keys
    return False


def _guarded(node: ast.Try) -> bool:
    caught = [_name(x) for h in node.handlers for x in ([h.type] if not isinstance(h.type, ast.Tuple) else h.type.elts) if h.type is not None]
    return any(h.type is None for h in node.handlers) or any(c in ("ImportError", "ModuleNotFoundError") for c in caught) or all(isinstance(s, (ast.Import, ast.ImportFrom)) for s in node.body)


def fact_rows(path: str, text: str) -> list[tuple]:
    """Facts of one file: imports, calls to eval and pickle, asserts, handlers, resources, mutable globals, attributes."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list = []
    add = lambda fact, name, node, detail, within: out.append((path, fact, name, getattr(node, "lineno", 1), detail, within))
    mutable = {
        t.id: s
        for s in tree.body
        if isinstance(s, (ast.Assign, ast.AnnAssign))
        for t in (s.targets if isinstance(s, ast.Assign) else [s.target])
        if isinstance(t, ast.Name) and (isinstance(s.value, (ast.Dict, ast.List, ast.Set)) or isinstance(s.value, ast.Call) and _name(s.value.func).split(".")[-1] in ("dict", "list", "set", "defaultdict", "OrderedDict"))
    }
    has_threads = "threading" in text and any(isinstance(n, (ast.Import, ast.ImportFrom)) and "threading" in _text(n) for n in ast.walk(tree))
    closed_attrs = {_name(n.func.value) for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in CLOSERS}

    stack: list[tuple] = [(tree, 0, False, None)]
    while stack:
        node, within, guarded, fn = stack.pop()
        if isinstance(node, ast.Import) and not guarded:
            for a in node.names:
                add("import", a.name.split(".")[0], node, a.name, within)
        elif isinstance(node, ast.ImportFrom) and not guarded and not node.level and node.module:
            add("import", node.module.split(".")[0], node, node.module, within)
        elif isinstance(node, ast.Assert):
            add("assert", "", node, _text(node.test), within)
        elif isinstance(node, ast.ExceptHandler):
            if node.type is None and not (len(node.body) == 1 and isinstance(node.body[0], ast.Raise) and node.body[0].exc is None):
                add("bare_except", "", node, "", within)
            names = [_name(x) for x in (node.type.elts if isinstance(node.type, ast.Tuple) else [node.type])] if node.type is not None else []
            if any(x in ("Exception", "BaseException") for x in names) and len(node.body) == 1 and _trivial(node.body[0]):
                add("silent_except", ",".join(names), node, "", within)
        elif isinstance(node, ast.Call):
            full = _name(node.func)
            if isinstance(node.func, ast.Name) and full in ("eval", "exec"):
                add("eval", full, node, "", within)
            if within and full.endswith(".addHandler"):
                add("handler", full, node, "", within)
            if within and has_threads and full in ("Thread", "threading.Thread"):
                add("thread", full, node, "", within)
            if within and isinstance(node.func, ast.Attribute) and node.func.attr in MUTATORS and isinstance(node.func.value, ast.Name) and node.func.value.id in mutable:
                add("mutated", node.func.value.id, mutable[node.func.value.id], "", within)
        elif isinstance(node, ast.Subscript) and isinstance(node.ctx, ast.Store) and within and isinstance(node.value, ast.Name) and node.value.id in mutable:
            add("mutated", node.value.id, mutable[node.value.id], "", within)
        elif isinstance(node, ast.Assign) and within and isinstance(node.value, ast.Call) and _name(node.value.func).split(".")[-1] in SESSIONS:
            for t in node.targets:
                target = _name(t)
                body = _text(fn)
                held = target in closed_attrs if "." in target else any(f"{target}.{c}(" in body for c in CLOSERS) or f"with {target}" in body
                if target and not held:
                    add("unclosed", target, node, _name(node.value.func), within)
        elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod) and isinstance(node.left, ast.Constant) and isinstance(node.left.value, str) and any(f" {w} " in f" {node.left.value.upper()} " for w in ("SELECT", "INSERT", "UPDATE", "DELETE")):
            add("sql_percent", "", node, "", within)
        if isinstance(node, FUNCTIONS):
            for d in node.decorator_list:
                plain = _name(d.func if isinstance(d, ast.Call) else d).split(".")[-1]
                unlimited = plain == "cache" or plain == "lru_cache" and isinstance(d, ast.Call) and any(k.arg == "maxsize" and isinstance(k.value, ast.Constant) and k.value.value is None for k in d.keywords)
                if unlimited:
                    add("unbounded_cache", node.name, d, plain, within)
            within, fn = within + 1, node
        if isinstance(node, ast.ClassDef):
            _attributes(path, node, out)
        skip = guarded or isinstance(node, ast.Try) and _guarded(node) or isinstance(node, ast.With) and "suppress(ImportError" in _text(node.items[0])
        type_only = node.body if isinstance(node, ast.If) and "TYPE_CHECKING" in _text(node.test) else []
        stack += [(c, within, skip or any(c is x for x in type_only), fn) for c in reversed(list(ast.iter_child_nodes(node)))]
    return out


def _attributes(path: str, cls: ast.ClassDef, out: list) -> None:
    """Attributes read on self, never assigned, and close to one that __init__ assigns."""
    text = _text(cls)
    if any(x in text for x in ("__getattr__", "__getattribute__", "setattr(", "getattr(", "self.__dict__")):
        return
    mine = {m.name for m in cls.body if isinstance(m, FUNCTIONS)} | {t.id for s in cls.body if isinstance(s, (ast.Assign, ast.AnnAssign)) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)}
    attrs = [n for n in ast.walk(cls) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self"]
    stored = {a.attr for a in attrs if isinstance(a.ctx, ast.Store)}
    init = next((m for m in cls.body if isinstance(m, ast.FunctionDef) and m.name == "__init__"), None)
    known = sorted({a.attr for a in ast.walk(init) if isinstance(a, ast.Attribute) and isinstance(a.ctx, ast.Store)}) if init else []
    for a in attrs:
        if isinstance(a.ctx, ast.Load) and a.attr not in stored | mine and (close := difflib.get_close_matches(a.attr, known, 1, 0.8)):
            out.append((path, "attribute_mismatch", a.attr, a.lineno, close[0], 0))


def _table(files: DataFrame, rows_of, schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch["path"], batch["content"]) if t is not None for r in rows_of(p, t)]
            frame = pd.DataFrame(rows, columns=names)
            for c, kind in (x.strip().split(" ") for x in schema.split(",")):
                if kind == "int":
                    frame[c] = frame[c].astype("Int64")
            yield frame

    return spread(files.select("path", "content")).mapInPandas(look, schema)


def ast_nodes(files: DataFrame) -> DataFrame:
    """Syntax-tree nodes of (path, content)."""
    return _table(files, tree_rows, NODES)


def definitions(files: DataFrame) -> DataFrame:
    """The nodes of functions and classes alone: what most rules need of a tree, without its other nodes leaving Python."""
    kinds = ("FUNCTION", "ASYNC_FUNCTION", "CLASS")
    return _table(files, lambda path, text: [r for r in tree_rows(path, text, kinds) if r[6] in kinds], NODES)


BODIES = "path string, name string, line_start int, line_end int, text string"


def function_bodies(files: DataFrame, least: int = 3) -> DataFrame:
    """(path, name, line_start, line_end, text) of functions of at least `least` lines that are not blank."""

    def rows_of(path: str, text: str) -> list[tuple]:
        lines, out = text.split("\n"), []
        for r in tree_rows(path, text, ("FUNCTION", "ASYNC_FUNCTION")):
            if r[6] in ("FUNCTION", "ASYNC_FUNCTION") and r[10] - r[9] + 1 >= least:
                body = "\n".join(lines[r[9] - 1 : r[10]])
                if body.strip():
                    out.append((path, r[8], r[9], r[10], body))
        return out

    return _table(files, rows_of, BODIES)


def facts(files: DataFrame) -> DataFrame:
    """Facts of (path, content) that rules are made of."""
    return _table(files, fact_rows, FACTS)


def complexity_findings(nodes: DataFrame) -> DataFrame:
    """Functions of complexity 6 and more, with severity by tiers."""
    c = F.col("complexity")
    return nodes.where("complexity >= 6").select(
        "path", F.col("line_start").alias("line"), "name", "complexity", F.when(c >= 21, "VERY_HIGH_COMPLEXITY").otherwise("HIGH_COMPLEXITY").alias("issue_type"), F.when(c >= 21, "CRITICAL").when(c >= 11, "HIGH").otherwise("MEDIUM").alias("severity")
    )


def smell_findings(nodes: DataFrame, params_too: bool = False) -> DataFrame:
    """Long functions and classes, deep nesting, and with `params_too` long parameter lists."""
    span, fn = F.col("line_end") - F.col("line_start"), F.col("node_type").isin("FUNCTION", "ASYNC_FUNCTION")
    f = lambda test, kind, severity: F.when(test, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity")))
    tests = [f(fn & (span > 50), "LONG_FUNCTION", "MEDIUM"), f(fn & (F.col("nesting") > 4), "DEEP_NESTING", "HIGH"), f((F.col("node_type") == "CLASS") & (span > 500), "GOD_CLASS", "HIGH")]
    if params_too:
        tests.append(f(fn & (F.col("param_count") > 5), "LONG_PARAMETER_LIST", "MEDIUM"))
    return nodes.select("path", F.col("line_start").alias("line"), "name", F.explode(F.array_compact(F.array(*tests))).alias("f")).select("path", "line", "name", "f.*")


# Rule, severity and confidence of each fact.
FACT_RULES = {
    "eval": ("EVAL_USAGE", "CRITICAL", 0.95), "assert": ("ASSERT_IN_PRODUCTION", "MEDIUM", 0.9), "bare_except": ("BARE_EXCEPT", "MEDIUM", 0.9), "silent_except": ("SILENT_EXCEPTION_SWALLOW", "MEDIUM", 0.9), "handler": ("RELIABILITY_LOGGING_HANDLER_DUP", "MEDIUM", 0.8),
    "thread": ("RELIABILITY_THREAD_IN_REQUEST", "MEDIUM", 0.8), "mutated": ("RELIABILITY_UNBOUNDED_GLOBAL", "MEDIUM", 0.85), "unclosed": ("RELIABILITY_SESSION_LIFECYCLE", "MEDIUM", 0.85), "unbounded_cache": ("RELIABILITY_UNBOUNDED_CACHE", "MEDIUM", 0.9),
    "attribute_mismatch": ("ATTRIBUTE_NAME_MISMATCH", "MEDIUM", 0.8), "sql_percent": ("SQL_INJECTION_RISK", "HIGH", 0.9),
}


def fact_findings(found: DataFrame) -> DataFrame:
    """Findings of facts; pickle imports by module, asserts outside tests only."""
    table = F.create_map(*[x for k, (t, s, c) in FACT_RULES.items() for x in (F.lit(k), F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), F.lit(c).alias("confidence")))])
    pickle = (F.col("fact") == "import") & F.col("detail").isin("pickle", "cPickle")
    rule = F.when(pickle, F.struct(F.lit("PICKLE_USAGE").alias("issue_type"), F.lit("HIGH").alias("severity"), F.lit(0.9).alias("confidence"))).otherwise(table[F.col("fact")])
    rows = found.where(~((F.col("fact") == "assert") & F.lower("path").contains("test"))).withColumn("r", rule).where("r is not null")
    return rows.select("path", "line", "name", "r.*").distinct()


ASSERTIONS = "path string, test_function string, line int, function_called string, arguments string, expected string, kind string"


def assertion_rows(path: str, text: str) -> list[tuple]:
    """Assertions of one test file, as calls with an expected value."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list = []

    def add(fn: str, node: ast.AST, call: ast.AST, expected: str, kind: str) -> None:
        if isinstance(call, ast.Call):
            args = [_text(a) for a in call.args] + [_text(k) for k in call.keywords]
            out.append((path, fn, node.lineno, _text(call.func), ", ".join(args), expected, kind))

    for fn in (n for n in ast.walk(tree) if isinstance(n, FUNCTIONS) and n.name.startswith("test")):
        for n in ast.walk(fn):
            if isinstance(n, ast.Assert):
                t = n.test
                if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], (ast.Eq, ast.Is)):
                    add(fn.name, n, t.left, _text(t.comparators[0]), "assert")
                elif isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.Not):
                    add(fn.name, n, t.operand, "False", "assert")
                else:
                    add(fn.name, n, t, "True", "assert")
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("assertEqual", "assertTrue", "assertFalse") and n.args:
                if n.func.attr == "assertEqual" and len(n.args) > 1:
                    add(fn.name, n, n.args[0], _text(n.args[1]), "unittest")
                else:
                    add(fn.name, n, n.args[0], str(n.func.attr == "assertTrue"), "unittest")
    return out


def assertions(files: DataFrame) -> DataFrame:
    return _table(files, assertion_rows, ASSERTIONS)


def contradictions(rows: DataFrame) -> DataFrame:
    """Calls with more than one expected value: a row per further value beside the call's first, so a call with n values has n - 1.

    All pairs of a call's values follow from its rows; they are not written out, a call may be asserted very often.
    """
    one = rows.groupBy("function_called", "arguments", "expected").agg(F.min(F.struct("path", "line", "test_function")).alias("first"))
    call = Window.partitionBy("function_called", "arguments").orderBy("expected")
    seen = one.withColumns({"expected_1": F.first("expected").over(call), "first_1": F.first("first").over(call)})
    return seen.where(F.col("expected") != F.col("expected_1")).select("function_called", "arguments", "expected_1", F.col("expected").alias("expected_2"), F.col("first_1.path").alias("path_1"), F.col("first.path").alias("path_2"))


def quarantine(files: DataFrame) -> DataFrame:
    """(path, language, category) of Python files that do not parse."""
    bad = ast_nodes(files).where("node_type = 'UNKNOWN'").select("path")
    return bad.select("path", F.lit("python").alias("language"), F.lit("parse_error").alias("category"))
