import pytest

from lintlake.llm.syntax import language_of, parses, rates, unparsable
from lintlake.llm.syntax_grammar import Grammar
from lintlake.llm.syntax_statements import legal_docker, legal_sql, docker_statements, sql_statements

GOOD = {
    "a.py": "import os\n\n\nclass A:\n    def f(self, x: int = 1, *args, **kw) -> int:\n        try:\n            return [y for y in x if y][0] if x else {**kw}\n        except (ValueError, KeyError) as e:\n            raise\n        finally:\n            pass\n    x = lambda a, b=2: a @ b\n\n\nif True: pass\n",
    "b.js": "#!/usr/bin/env node\nimport a, { b as c } from './x';\nexport default class A extends B { static x = 1; #y; get z() { return this.#y; } async *g() { yield* f(); } }\nconst r = /[/\"]+/g.test(`a ${x ? `b${y}` : '}'}`) ? { 'k-1': 1, [k]: 2, ...o } : a?.b ?? c\nfor (const [k, v] of m) if (k) continue; else break\nlabel: while (1) { do x++; while (x < 3) }\nlet f = async (x) => ({ x }), g = x => { return x }\nswitch (x) { case 1: default: y() }\n",
    "c.ts": "import type { T } from './t';\nexport interface A<T extends B = C> extends D { x?: number; readonly y: string[]; f(a: string, b?: T): void; [k: string]: any }\nenum E { A = 1, B }\nexport abstract class C<T> implements A { private x: Map<string, number[]> = new Map(); constructor(public a: string, b = 2) { super(a) } m<K>(k: K): k is T { return (x as any)!.y } }\ntype U = { a: 1 } | ((x: string) => void);\nexport const f = <T,>(x: T): T => x;\ndeclare module 'm' { export const z: number; }\n",
    "d.go": "package main\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*T\n}\n\ntype I interface {\n\tF(x int) (string, error)\n}\n\nfunc (s *S) F(xs ...int) (n int, err error) {\n\tfor i, x := range xs {\n\t\tif y, ok := m[x]; ok && y > 1 {\n\t\t\tdefer func() { fmt.Println(i) }()\n\t\t}\n\t}\n\tswitch v := z.(type) {\n\tcase int, string:\n\t\tch <- v\n\tdefault:\n\t}\n\treturn S{A: 1, B: xs[1:2][0]}.A, nil\n}\n",
    "e.java": "package a.b;\n\nimport static java.util.Map.*;\n\n@Deprecated(since = \"1\")\npublic final class A<T extends Comparable<T>> extends B implements C, D {\n    private static final int[] X = {1, 2};\n    @Override public <K> Map<K, List<? super T>> f(final int x, String... ys) throws E {\n        for (String y : ys) { if (x > 1 && y instanceof String s) continue; }\n        Runnable r = () -> { int z = x << 2; };\n        try (var q = new Q<>(x)) { r.run(); } catch (E | F e) { throw new G(\"x\", e) { int k; }; } finally { }\n        return x == 1 ? null : switch (x) { case 1, 2 -> A::new; default -> { yield (Map) y; } };\n    }\n    enum K { A(1) { }, B; K(int... x) { } }\n    record P(int x, int y) { }\n}\n",
    "f.tf": "variable \"x\" {\n  type    = list(object({ a = string }))\n  default = [for k, v in var.m : \"${k}-${lookup(v, \"a\")}\" if v != null]\n}\nresource \"a\" \"b\" {\n  y = <<-EOT\n    <<<<<<< HEAD\n  EOT\n  z = cond ? { a : 1, \"b\" = 2 } : local.c[0].d\n  inner { q = 1 }\n}\n",
    "g.sh": "#!/bin/bash\nset -eu\nf() {\n  local x=\"$(cat \"$1\" | grep 'a)')\"\n  case \"$x\" in\n    a|b) echo hi ;;\n    *) : ;;\n  esac\n  for i in 1 2; do [[ $i == 1 ]] && echo $((i + 1)); done\n  cat <<EOF\n<<<<<<< HEAD ( ' \"\nEOF\n}\nif f; then arr=(a b); elif g; then :; else h & fi\nwhile read -r l; do echo \"${l%%x}\"; done < file\n",
    "h.sql": "-- x\nCREATE TABLE t (id INT NOT NULL, n VARCHAR(10) DEFAULT 'a;b', PRIMARY KEY (id));\nINSERT INTO t (id, n) VALUES (1, 'it''s'), (2, 'x');\nINSERT INTO t SELECT s.id FROM (SELECT 1 AS id) s;\nUPDATE t SET n = 'y' WHERE id = 1;\nWITH c AS (SELECT 1) SELECT * FROM c\n",
    "i.json": "{\"a\": [1, -2.5e3, null, {\"b\": \"\\u00e9\"}]}\n",
    "j.toml": "[a.b]\nx = 1\ny = [\n  'z', # c\n]\n[[t]]\nd = 2020-01-01T00:00:00Z\n",
    "k.yaml": "a: 1\nb:\n  - x: \"y\"\n    z: [1, {c: d}]\n  - |\n    <<<<<<< HEAD\ne: >-\n  text: more\n",
    "Dockerfile": "# c\nARG V=1\nFROM a:${V} AS b\nENV X=1 Y=\"a b\"\nRUN a \\\n  # c\n  && b\nRUN <<EOF\n<<<<<<< HEAD\nEOF\nCMD [\"x\"]\n",
}
BAD = {
    "a1.py": "def f(x):\n    if x\n        return 1\n",
    "a2.py": "def f(x):\n    return (1\n",
    "a3.py": "x = 1\n<<<<<<< HEAD\ny = 2\n=======\ny = 3\n>>>>>>> b\n",
    "a4.py": "try:\n    x = 1\n",
    "a5.py": "package a;\npublic class B { }\n",
    "b1.js": "export function f(a) {\n  return a;\n",
    "b2.js": "interface X { a: string }\nexport interface Y { b?: number; }\n",
    "b3.js": "name: \"a\"\non: [\"push\"]\nlist:\n  - a: 1\n",
    "b4.js": "const a = 1;\n=======\nconst b = 2;\n",
    "b5.js": "export const a\n",
    "c1.ts": "import os\nfrom a import b\n",
    "c2.ts": "CREATE TABLE a b (\n id INT\n);\n",
    "d1.go": "import json\n",
    "d2.go": "package a\n\nfunc f(",
    "d3.go": "package a\n\nfunc F",
    "e1.java": "public class A {\n  int x\n}\n",
    "e2.java": "{\"a\": 1}",
    "f1.tf": "resource \"a\" \"b\" {\n  x = \n}\n",
    "f2.tf": "resource \"a\" \"b\"\n",
    "g1.sh": "if true; then\n  echo\n",
    "g2.sh": "echo 'abc\n",
    "g3.sh": "for x in a; do\n  :\nfi\n",
    "h1.sql": "INSERT INTO t (id, n)",
    "h2.sql": "import a from 'b';\n",
    "h3.sql": "CREATE TABLE t (id INT,);",
    "i1.json": "{\"a\": 1,}",
    "i2.json": "",
    "j1.toml": "x = \n",
    "k1.yaml": "a: 1\n<<<<<<< HEAD\nb: 2\n",
    "k2.yaml": "a: b: c\n",
    "k3.yaml": "a: \"open\nb: 1\n",
    "Dockerfile.dev": "FROM a\n>>>>>>> b\n",
    "l.dockerfile": "FROM a\nCOPY x\n",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, "r", p, t) for i, (p, t) in enumerate([*GOOD.items(), *BAD.items()])]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, content string")
    ids = {r.file_id for r in unparsable(files).collect()}
    return {p for i, _, p, _ in rows if i in ids}


@pytest.mark.parametrize("path", list(GOOD))
def test_legal(found, path):
    assert path not in found


@pytest.mark.parametrize("path", list(BAD))
def test_illegal(found, path):
    assert path in found


def test_edges(spark):
    long = "x = [\n" + "  1,\n" * 60_000 + "]\n"
    rows = [(1, None, "a.py", None, 0), (2, "r", None, "x", 0), (3, "r", "a.py", "", 0), (4, "r", "a.txt", "(", 0), (5, "r", "a.py", long, 0), (5, "r", "a.py", long, 0), (6, "r", "b.go", "", 0), (7, "r", "c.js", "(" * 5000, 0)]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, content string, language int")
    assert {r.file_id for r in unparsable(files).collect()} == {6, 7}
    assert unparsable(files.limit(0)).count() == 0
    assert {(r.repo, r.language): (r.files, r.unparsable) for r in rates(files).collect()}[("r", "go")] == (1, 1)


def test_grammar_pairs():
    g = Grammar("s = A b* C\nb = X Y? | Z")
    assert g.pairs == {("A", "X"), ("A", "Z"), ("A", "C"), ("X", "Y"), ("X", "X"), ("X", "Z"), ("X", "C"), ("Y", "X"), ("Y", "Z"), ("Y", "C"), ("Z", "X"), ("Z", "Z"), ("Z", "C")}


def test_languages_and_parsers():
    assert [language_of(p) for p in ("x/Dockerfile", "a.dockerfile", "Dockerfile.dev", "a.yml", "noext", None)] == ["dockerfile", "dockerfile", "dockerfile", "yaml", None, None]
    assert parses("{}", "json") and not parses("{", "json") and not parses("x", "go")
    assert legal_sql(*sql_statements("SELECT 1")[1][0][2:]) and not legal_sql(*sql_statements("SELECT FROM")[1][0][2:])
    assert not legal_docker(*docker_statements("HELLO x")[0][2:])


ORPHANS = ["foo(); else { bar(); }", "if (a) { x(); } else { y(); } else { z(); }", "if (a) x(); else y(); else z();", "while (a) { b(); } else { c(); }", "if (a) b(); c(); else d();", "for (a; b) { c(); }", "{ case 1: b(); }"]
PAIRED = [
    "if (a) do x(); while (b); else c();", "if (a) do { x(); } while (b); else c();", "if (a) for (i = 0; i < 3; i++) { b(); } else c();", "if (a) switch (b) { case 1: d(); break; default: e(); } else c();",
    "if (a) try { b(); } finally { c(); } else d();", "if (a) if (b) c(); else d(); else if (e) f(); else g();", "if (a) while (b) { if (c) d(); } else e();", "for (;;) { if (a) ; else break; }",
]


@pytest.mark.parametrize("path", ["a.js", "a.ts", "a.java"])
def test_statements_of_brace_languages(spark, path):
    whole = (lambda t: f"class A {{ void f() {{ {t} }} }}") if path == "a.java" else (lambda t: t)
    rows = [(i, "r", path, whole(t)) for i, t in enumerate([*ORPHANS, *PAIRED])]
    if path != "a.java":
        rows += [(90 + i, "r", path, t) for i, t in enumerate(["if (a) b()\nelse c()", "if (a) x = () => { b() }\nelse c()", "x.else = { else: 1, case: 2, for: 3 }", "if (a) x = function () { b(); }; else c();"])]
    got = {r.file_id for r in unparsable(spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, content string")).collect()}
    assert got == set(range(len(ORPHANS)))
