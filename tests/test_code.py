from lintlake.operators import cobol, python_code, security_lines

CODE = '''import os, pickle
from a.b import c
try:
    import opt
except ImportError:
    opt = None
CACHE = {}


def f(a, b, c, d, e, g):
    if a:
        for x in b:
            while c:
                if d:
                    try:
                        pass
                    except Exception:
                        pass
    CACHE[a] = 1
    eval(a)
    s = Session()
    return "SELECT * FROM t WHERE x = %s" % a


class K:
    def __init__(self):
        self.value = 1

    def g(self):
        assert self.vlaue
        try:
            return self.value
        except:
            return None
'''


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_nodes(spark):
    nodes = python_code.ast_nodes(files(spark, ("a.py", CODE), ("b.py", "def ("), ("n.py", None), ("e.py", ""))).collect()
    by = {(r.path, r.name): r for r in nodes if r.node_type == "FUNCTION"}
    assert (by["a.py", "f"].complexity, by["a.py", "f"].nesting, by["a.py", "f"].param_count) == (6, 5, 6)
    assert [r.node_type for r in nodes if r.path == "b.py"] == ["UNKNOWN"]
    mine = {r.node_id: r for r in nodes if r.path == "a.py"}
    assert all(r.parent_id is None or mine[r.parent_id].pre < r.pre <= r.post <= mine[r.parent_id].post for r in mine.values())


def test_rules(spark):
    src = files(spark, ("a.py", CODE), ("test_a.py", CODE))
    nodes = python_code.ast_nodes(src)
    assert {(r.name, r.severity) for r in python_code.complexity_findings(nodes).collect()} == {("f", "MEDIUM")}
    assert {r.issue_type for r in python_code.smell_findings(nodes, params_too=True).collect()} == {"DEEP_NESTING", "LONG_PARAMETER_LIST"}
    found = {(r.path, r.issue_type) for r in python_code.fact_findings(python_code.facts(src)).collect()}
    kinds = {t for p, t in found if p == "a.py"}
    assert kinds == {"EVAL_USAGE", "PICKLE_USAGE", "ASSERT_IN_PRODUCTION", "BARE_EXCEPT", "SILENT_EXCEPTION_SWALLOW", "RELIABILITY_UNBOUNDED_GLOBAL", "RELIABILITY_SESSION_LIFECYCLE", "ATTRIBUTE_NAME_MISMATCH", "SQL_INJECTION_RISK"}
    assert ("test_a.py", "ASSERT_IN_PRODUCTION") not in found
    imports = {r.name for r in python_code.facts(src).where("fact = 'import'").collect()}
    assert imports == {"os", "pickle", "a"}


def test_assertions(spark):
    body = "def test_a():\n    assert f(1) == 2\n    assert not g()\n\ndef test_b(self):\n    self.assertEqual(f(1), 3)\n    assert f(1) == 2\n    assert x\n"
    rows = python_code.assertions(files(spark, ("t.py", body), ("u.py", "(")))
    assert rows.count() == 4
    assert [(r.function_called, r.arguments, r.expected_1, r.expected_2) for r in python_code.contradictions(rows).collect()] == [("f", "1", "2", "3")]


def test_quarantine(spark):
    assert [(r.path, r.category) for r in python_code.quarantine(files(spark, ("b.py", "x ="), ("a.py", "x = 1"))).collect()] == [("b.py", "parse_error")]


COBOL = """      * comment MOVE 'X' TO WS-PASSWORD.
       IDENTIFICATION DIVISION.
       PARA-A.
           MOVE 'SECRET1' TO WS-DB-
      -    PASSWORD.
           MOVE 'SECRET2' TO WS-PASSWORD.
           ACCEPT WS-X.
           ACCEPT WS-D FROM DATE.
       01  A REDEFINES B.
       01  T OCCURS 1 TO 9 DEPENDING ON N.
           COPY CUSTCOMMON.
           COPY 'OTHER'.
           PERFORM PARA-A THRU PARA-Z.
"""


def test_cobol(spark):
    jumps = COBOL + "".join("           GO TO PARA-A.\n" for _ in range(11))
    rows = cobol.logical_lines(files(spark, ("p.cbl", jumps), ("c.cpy", COBOL), ("n.cbl", None)))
    got = {(r.rule_id, r.line, r.severity) for r in cobol.findings(rows).collect()}
    assert got == {("COB002", 6, "CRITICAL"), ("COB003", 7, "MEDIUM"), ("COB004", 9, "HIGH"), ("COB005", 10, "MEDIUM"), ("COB007", 11, "CRITICAL"), ("COB007", 12, "HIGH"), ("COB006", 13, "HIGH"), ("COB001", 14, "HIGH")} | {g for g in got if g[0] == "COB002" and g[1] == 4}
    assert not [r for r in rows.collect() if "comment" in r.text]
    assert {(r.copybook, r.programs) for r in cobol.blast_radius(rows).collect()} == {("CUSTCOMMON", 1), ("OTHER", 1)}


def test_security_lines(spark):
    code = "\n".join([
        "def f(c, x):", '    q = f"SELECT a FROM t WHERE x = {x}"', '    c.execute("SELECT a FROM t WHERE x = %s", (x,))', '    # f"SELECT {x}"', '    r = "DELETE FROM t WHERE x = {}".format(x)', "",
        "def k(x):", '    log(f"SELECT {x}")', "def g(x):", '    subprocess.run("rm " + x, shell=True)', '    subprocess.run(["rm", "a" + x])', '    subprocess.Popen(f"rm {x}", shell=True)', '    os.system("ls")', "    eval(x)",
        'h = f"SELECT {x}"',
    ])
    rows = [("a.py", code, "python"), ("b.js", "eval(x); exec (y)\nretrieval(x)\n", "javascript"), ("n", None, "go")]
    got = {(r.path, r.line, r.rule_id, r.name) for r in security_lines.security_findings(spark.createDataFrame(rows, "path string, content string, language string")).collect()}
    assert got == {("a.py", 2, "SEC02", ""), ("a.py", 5, "SEC02", ""), ("a.py", 10, "SEC04", "subprocess.run"), ("a.py", 12, "SEC04", "subprocess.Popen"), ("b.js", 1, "SEC05", "eval"), ("b.js", 1, "SEC05", "exec")}


def test_deep_and_long_expressions(spark):
    deep = "def f(a):\n    x = " + " + ".join(["a"] * 5000) + "\n    return x\n"
    chain = "y = a" + ".b" * 900 + "\nassert " + " + ".join(["y"] * 1500) + "\n"
    src = files(spark, ("a.py", deep), ("b.py", chain), ("c.py", "if a:\n" + "".join("    " * k + "if a:\n" for k in range(1, 90)) + "    " * 90 + "pass\n"))
    assert {r.path for r in python_code.ast_nodes(src).collect()} == {"a.py", "b.py", "c.py"}
    assert ("b.py", "ASSERT_IN_PRODUCTION") in {(r.path, r.issue_type) for r in python_code.fact_findings(python_code.facts(src)).collect()}
