import time

import numpy as np

from lintlake.llm.handwritten import measures, not_handwritten, notices, path_rules
from lintlake.llm.residue import residue

BODY = "\n".join(f"def f{c}(row, limit):\n    total = row.count('{c}') + limit\n    return max(total, {k}) if row else None\n" for k, c in enumerate("qwertzuiopasdfghjklyx"))


def test_notices_count_on_comment_lines_only():
    assert notices("// Code generated by x. DO NOT EDIT.\n") == {"generated"}
    assert notices("x = 1\n# Automatisch erzeugt mit y. Nicht von Hand bearbeiten!\n") == {"generated"}
    assert notices('HEADER = "# Code generated by this script. DO NOT EDIT."\n') == set()
    assert notices("# this script reads files and looks for lines that say do not edit\n") == set()
    assert notices("// SPDX-FileCopyrightText: 2015 foo developers\n// upstream: foo.invalid/1\n") == {"third_party"}
    assert notices("// Copyright the web team. Internal use.\n") == set()


def test_paths_and_measures():
    assert path_rules("a/package-lock.json") == {"lock"} and path_rules("a/vendor/x.py") == set() and path_rules("a/vendor/lib/x.py") == {"vendored"}
    assert path_rules("a/libs/3rd/z/x.py") == {"vendored"}
    assert measures("function a(b,c){return b?c+1:null};" * 40, "a.js") == {"minified"}
    assert measures("X = [\n" + "    1.5, 2.25, 3.125, 4.0,\n" * 30 + "]\n", "a.py") == {"data"}
    assert "accessors" in measures("".join(f"def get_x_{i}(m):\n    return m._fields[{i}]\n\n" for i in range(12)), "a.py")
    assert measures(BODY, "a.py") == set() and measures("", "a.py") == set()


def test_copies_of_vendored_files_are_found(spark):
    changed = BODY.replace("limit):", "limit):  # own", 1).replace("max(total, 3)", "max(total, 4)")
    rows = [
        (1, "x/vendor/lib/a.py", BODY, 1), (2, "own/b.py", "# our copy\n" + changed, 1), (3, "own/c.py", "\n".join(f"value_{c} = load('{c}')\nprint(value_{c}, sep='{c}')" for c in "abcdefghijklmno"), 1), (4, "own/b.py", "# our copy\n" + changed, 1),
        (5, None, None, None), (6, "a/package-lock.json", None, None), (7, "e.py", "", None), (8, "t.py", "word " * 100_000, 0),
    ]
    files = spark.createDataFrame(rows, "file_id bigint, file_path string, content string, reasons int")
    assert {r.file_id: list(r.reasons) for r in not_handwritten(files).collect()} == {1: ["vendored"], 2: ["vendored"], 4: ["vendored"], 6: ["lock file"]}
    assert not_handwritten(files.limit(0)).count() == 0


REAL = "The rule SEC001 reports quiet entries when the table is missing from the report."


def test_residue(spark):
    texts = {
        1: "404 Not Found\n\nThe requested address /a/b was not found on this server.",
        2: "# Title\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit.",
        3: "TBD\nTBD\nSteps: tbd",
        4: "Please enable JavaScript to view this page.",
        5: f"{REAL} Dear {{{{ name }}}}, welcome.",
        6: f"# [TABLE HERE]\n\n{REAL}",
        7: f"{REAL} The value `{{{{ name }}}}` is safe.",
        8: f"{REAL}\n\n```sh\nexport A=${{A}}\n./run <insert x>\n```",
        9: 'Users saw "Access denied" for 50 minutes because the role lost its grant.',
        10: "JavaScript files are analysed only when the tree grammar is present; enable JavaScript support in the profile.",
        11: None,
        12: "",
        13: "# Only a heading",
        14: REAL,
        15: "foo bar baz foo bar baz foo bar baz foo bar baz foo bar baz",
        16: (REAL + " ") * 3000,
        17: "Zugriff verweigert\r\n\r\nSie haben keine Berechtigung.",
        18: f"{REAL} The word undefined in a log line means nothing.",
        19: "Dear undefined,\n\nyour scan of %BATCH% finished with XXXX findings.",
    }
    docs = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()] + [(1001, texts[1], "clash")], "doc_id bigint, text string, plain string")
    got = {r.doc_id: r.kind for r in residue(docs).collect()}
    assert got == {1: "no_text", 2: "no_text", 3: "no_text", 4: "no_text", 5: "slot", 6: "slot", 15: "no_text", 17: "no_text", 19: "slot", 1001: "no_text"}
    assert residue(docs.limit(0)).count() == 0


def test_minified_suffix_counts_with_dense_text(spark):
    packed = "!function(a){var b={x:1,y:2};a.q(b);c(a)}(window);"
    strings = "".join(f'if({c}){{throw E("the value that was given here is not allowed",{c})}}' for c in "abcdefgh")
    css = "a{color:red}b{margin:0;padding:0}.c{top:1px}" * 5
    hand = "// entry of the bundle\nimport { start } from './start';\n\nexport function run(a, b) {\n  const c = start(a, b);\n  return c;\n}\n"
    rows = [(1, "a/x.min.js", packed), (2, "a/y.bundle.js", strings), (3, "a/z.min.css", css), (4, "a/w.min.mts", packed), (5, "a/h.min.js", hand), (6, "a/i.bundle.js", "start();\nrun();\n"), (7, "a/x.js", packed), (8, "a/n.min.js", None)]
    files = spark.createDataFrame(rows, "file_id bigint, file_path string, content string")
    assert {r.file_id: list(r.reasons) for r in not_handwritten(files).collect()} == {k: ["minified"] for k in (1, 2, 3, 4)}


def test_long_blocks_and_lines_are_read_whole(spark):
    block = "```\n" + "x = {{ y }}\n" * 100_000 + "```\n"
    texts = {1: block + REAL, 2: block + "Dear {{ name }}, welcome.", 3: "lorem ipsum dolor sit amet " * 20_000, 4: "```x\n" * 100_000, 5: "a" * 1_000_000, 6: '"“ <!-- ' * 100_000, 7: "the page you asked for " * 50_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.kind for r in residue(docs).collect()} == {2: "slot", 3: "no_text", 7: "no_text"}


def test_sentences_join_the_template_they_are_most_similar_to():
    from lintlake.llm.residue import Tree, masked, path_of

    assert masked("HTTP 404: /a/b of host7 was 12 ms late") == "http 404: * of * was * ms late"
    tree, ids = Tree(), []
    for k, s in enumerate(["the page you asked for is gone from hosting now", "the page you asked for is lost from hosting now", "the page you edited must be in the tree now", "the page you asked for is gone"]):
        words = masked(s).split()
        ids.append(tree.add(path_of(words), words, 1, (1, s), k)[3])
    assert ids == [0, 0, 2, 3]
    assert [" ".join(t[0]) for ts in tree.leaves.values() for t in ts if t[1] == 2] == ["the page you asked for is * from hosting now"]


def test_verdicts_pass_to_templates_in_the_company_of_residue(spark):
    foot = "Our crew has been told about it."
    rows = [(k, f"Error {500 + k % 5}\n\nThe requested page could not be found. {foot}") for k in range(20)] + [(100, f"{foot} Error 404"), (101, foot), (102, REAL)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in residue(docs).collect()} == {*range(20), 100}


def test_rows_of_long_numbers_and_headers():
    from lintlake.llm.handwritten import SQL_ROW, header_end

    start = time.perf_counter()
    assert not SQL_ROW.match(f"({'1' * 4000}, NOW());") and not SQL_ROW.match("(" + "'', " * 4000 + "x);")
    assert SQL_ROW.match("INSERT INTO t (a, b) VALUES (1.5, 'it''s', NULL),")
    assert time.perf_counter() - start < 2
    head = "/* a\n  b\n*/\npackage x;\n\n# c\n"
    assert header_end(head + "code()\n# later\n") == len(head)
    long_head = "# line\n" * 400 + "# Permission is hereby granted to all\n"
    assert notices(long_head + "x = 1\n") == {"third_party"} and notices("x = 1\n" + long_head) == set()


def test_a_generated_suffix_counts_with_a_weak_notice(spark):
    text = "# this file is the part of the client that was generated from the schema by our build\ndef run(a):\n    return a\n"
    rows = [(1, "a/x_pb2.py", text), (2, "a/x.py", text), (3, "a/y_pb2.py", "def run(a):\n    return a\n")]
    files = spark.createDataFrame(rows, "file_id bigint, file_path string, content string")
    assert {(r.file_id, *r.reasons, *r.evidence) for r in not_handwritten(files).collect()} == {(1, "generated", "path and notice")}


def test_minhash_finds_similar_sets():
    """Of pairs of similarity 0.8 at least 0.98 share a band; 0.998 are to be expected."""
    from lintlake.llm.handwritten import _bands

    rng, met = np.random.default_rng(1), 0
    for _ in range(200):
        a = rng.choice(2**31 - 1, 360, replace=False).astype(np.int32)
        b = np.concatenate([a[:320], rng.choice(2**31 - 1, 40, replace=False).astype(np.int32)])
        met += bool(set(_bands(np.unique(a))) & set(_bands(np.unique(b))))
    assert met >= 196
