import collections
import random
import time
from datetime import date

import numpy as np
import pytest

from lintlake.llm.incremental_dedup import PivotIndex, fingerprints, repeats, with_pivot_distances
from lintlake.llm.mixing import fit, mix, shares
from lintlake.llm.packing import containers, report, windows
from lintlake.llm.percentiles import combine, from_counts, value_counts
from lintlake.llm.tokens import token_counts

ISSUE = "issue_id bigint, batch_id int, repo string, file_path string, line int, issue_type string, rule_id string, message string, k1 string"


def issue_rows(n=1500, seed=3):
    rng = random.Random(seed)
    spell = [lambda p: p, lambda p: "./" + p, lambda p: p.replace("/", "//", 1), lambda p: "C:\\agent\\_work\\3\\s\\" + p.replace("/", "\\"), lambda p: f"/home/runner/work/r/r/{p}", lambda p: f"file:///workspace/r/{p}", lambda p: "src/../" + p]
    rules = [None, "SEC001", "sec/SEC001", "SEC-1", " SEC002 ", "rule:SEC2"]
    rows = []
    for i in range(n):
        path = rng.choice(["src/a.py", "src/b/c.py"])
        name = rng.choice(["f", "G", "g"])
        rows.append((i + 1, 1 + i * 4 // n, "o/r", rng.choice(spell)(path), rng.randint(1, 60), "T", rng.choice(rules), f"x '{name}' y", "clash"))
    return rows + [(n + 1, 4, None, "src/a.py", 1, "T", None, "x 'f'", "c"), (n + 2, 4, "o/r", None, 1, "T", None, "x 'f'", "c"), (n + 3, 4, "o/r", "src/a.py", None, "T", None, "x 'f'", "c"), (n + 4, 4, "o/r", "src/a.py", 1, "T", None, None, "c")]


def test_repeats_equal_brute_force(spark):
    df = spark.createDataFrame(issue_rows(), ISSUE)
    got = {(r.issue_id_a, r.issue_id_b) for r in repeats(df).collect()}
    kept, want = collections.defaultdict(list), set()
    for r in sorted(fingerprints(df).collect(), key=lambda r: (r.batch_id, r.issue_id)):
        if r.k1 is None:
            continue
        hit = next((i for d, rule, i in kept[r.k1] if abs(d - r.dist) <= 3 and (rule is None or r.rule is None or rule == r.rule)), None)
        if hit is None:
            kept[r.k1].append((r.dist, r.rule, r.issue_id))
        else:
            want.add((hit, r.issue_id))
    assert got == want and len(want) > 500
    assert repeats(df.limit(0)).count() == 0


def test_copies_of_one_row(spark):
    df = spark.createDataFrame([(i, 1 + i // 500, "r/r", "a.py", 5, "T", None, "x 'f'", "c") for i in range(1000)], ISSUE)
    assert {(r.issue_id_a, r.issue_id_b) for r in repeats(df).collect()} == {(0, i) for i in range(1, 1000)}


def test_index_is_kept_between_batches(spark, tmp_path):
    index = PivotIndex(spark, str(tmp_path / "i"))
    first = fingerprints(spark.createDataFrame([(1, 1, "r", "a.py", 5, "T", "S1", "'f'", "")], ISSUE)).drop("batch_id")
    again = fingerprints(spark.createDataFrame([(2, 2, "r", "./a.py", 7, "T", None, "'F'", ""), (3, 2, "r", "a.py", 9, "T", None, "'F'", "")], ISSUE)).drop("batch_id")
    index.add_batch(first, "1")
    index.add_batch(again, "2")
    assert {(r.first_id, r.a) for r in index.resolved().collect()} == {(1, None), (2, 1), (3, None)}


def test_percentiles_equal_numpy(spark):
    rng = random.Random(1)
    rows = [(g, date(2025, 1, 1 + i % 3), rng.choice([None, -5, 7, 7, rng.randint(0, 10**6)])) for g in ("a", "b", None) for i in range(rng.choice([1, 2, 500]))] + [("hot", date(2025, 1, 1), 3)] * 3000 + [("none", None, None)]
    df = spark.createDataFrame(rows, "g string, day date, v bigint")
    ps = (0.0, 0.25, 0.5, 0.99, 1.0)
    days = value_counts(df, ["g", "day"], "v")
    halves = [days.where("day = date'2025-01-01'").drop("day"), days.where("day <> date'2025-01-01'").drop("day")]
    for out in (from_counts(value_counts(df, ["g"], "v"), ["g"], ps), from_counts(combine(halves, ["g"]), ["g"], ps)):
        got = {(r.g, r.percentile): r.estimate for r in out.collect()}
        want = {(g, p): float(np.quantile([v for x, _, v in rows if x == g and v is not None], p)) for g in ("a", "b", None, "hot") for p in ps if any(x == g and v is not None for x, _, v in rows)}
        assert got == pytest.approx(want)
    assert from_counts(value_counts(df.limit(0), ["g"], "v"), ["g"], ps).count() == 0


def test_windows_never_exceed_the_capacity():
    rng = np.random.default_rng(2)
    for sizes in ([], [0, 0], [2048], [1500] * 40, [2047, 1] * 30, rng.integers(1, 2048, 700), rng.integers(1, 300, 3000)):
        s = np.array(sizes, np.int64)
        w = windows(s)
        held = np.bincount(w, weights=s) if len(s) else np.zeros(1)
        assert len(w) == len(s) and held.max() <= 2048
    s = rng.integers(1, 600, 4000)
    assert windows(s).max() + 1 <= 1.02 * -(-s.sum() // 2048)


def test_containers(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.choice([0, 3, 40, 400, 5000]), "clash") for i in range(300)] + [(900, None, "clash"), (901, "", "clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    sized = token_counts(docs, ["doc_id"])
    got = containers(sized, block=100).collect()
    sizes = {r.doc_id: r.n_tokens for r in sized.collect()}
    held, parts = collections.Counter(), collections.defaultdict(list)
    for r in got:
        held[r.container_id] += r.n_tokens
        parts[r.doc_id].append(r)
    assert max(held.values()) <= 2048 and set(parts) == set(sizes)
    for d, ps in parts.items():
        assert sum(p.n_tokens for p in ps) == sizes[d]
        assert len(ps) == 1 if sizes[d] <= 2048 else sorted(p.start_token for p in ps) == list(range(0, sizes[d], 2048))
    assert report(containers(sized, block=100)).collect()[0].fullest <= 2048
    assert containers(sized.limit(0)).count() == 0


def test_fit_reaches_budgets():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 3000, 200))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(1, (lengths * counts).sum()))
        take = fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert budget - (lengths * take).sum() <= (0 if budget > 20_000 else lengths.min())
    assert fit(np.array([10]), np.array([5]), 35).tolist() == [3]


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("aab"), rng.choice([0, 5, 7, 7, 100])) for i in range(600)] + [(900, None, 5), (901, "z", 5)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 3), ("gone", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    selection, planned = mix(sized, targets)
    rows = selection.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b"}
    assert max(r.copies for r in rows if r.source == "a") <= 1 and max(r.copies for r in rows) <= 3
    got = {r.source: r for r in shares(selection, planned).collect()}
    assert abs(got["a"].reached_share - 0.3) < 1e-3 and got["gone"].tokens == 0
    again, _ = mix(sized, targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert mix(sized.limit(0), targets)[0].count() == 0 and mix(sized, targets.limit(0))[0].count() == 0


@pytest.mark.parametrize("size,fit_in_one", [(1100, 1), (700, 2), (520, 3), (2047, 1), (1, 2048)])
def test_a_whole_block_of_equal_items(size, fit_in_one):
    start = time.perf_counter()
    w = windows(np.full(4096, size))
    assert time.perf_counter() - start < 20
    assert np.bincount(w).max() * size <= 2048 and w.max() + 1 <= 1.02 * -(-4096 // fit_in_one) + 1


def test_an_index_outlives_its_session_and_reads_touched_ranges(spark, tmp_path):
    at = str(tmp_path / "i")
    old = [(i, 1, f"o/r{i % 40}", f"a{i}.py", 5, "T", "S1", "x 'f'", "c") for i in range(400)]
    assert repeats(spark.createDataFrame(old, ISSUE), index=at).count() == 0
    new = spark.createDataFrame([(1000 + i, 2, f"o/r{i}", f"./a{i}.py", 7, "T", None, "x 'F'", "c") for i in range(2)], ISSUE)
    assert {(r.issue_id_a, r.issue_id_b) for r in repeats(new, index=at).collect()} == {(0, 1000), (1, 1001)}
    index = PivotIndex(spark.newSession(), at)
    read = index.history(fingerprints(new), "2")
    assert "f" not in read.columns and "message" not in read.columns
    assert 2 <= read.count() < 200 and index.resolved().count() == 402
    index.add_batch(fingerprints(new).drop("batch_id"), "2")
    assert index.resolved().count() == 402


def test_pivots_prune_more_than_they_decide(spark):
    """Points that both pivots take for near need not be near: the true distance is what verifies."""
    rows = [(0, 10**6, 5), (0, 10**6 + 2, 3)]
    a, b = with_pivot_distances(spark.createDataFrame(rows, "k1 bigint, k2 bigint, dist int")).collect()
    assert a.d1 == b.d1 and a.d2 == b.d2 and abs(a.k2 - b.k2) + abs(a.dist - b.dist) == 4


def test_long_chains_of_lines_are_walked_once(spark):
    df = spark.createDataFrame([(i, 1, "r", "a.py", i, "T", None, "'f'", "c") for i in range(30_000)], ISSUE)
    start = time.perf_counter()
    assert repeats(df).count() == 30_000 - 7500
    assert time.perf_counter() - start < 60


def found(spark, *groups):
    """Repeats in each group of findings (repo, file, line, type, rule, message), numbered from 1: the first comes in batch 1, the rest in batch 2."""
    rows = [(100 * g + i, min(i, 2), *finding, "c") for g, group in enumerate(groups) for i, finding in enumerate(group, 1)]
    pairs = [(r.issue_id_a, r.issue_id_b) for r in repeats(spark.createDataFrame(rows, ISSUE)).collect()]
    assert all(a // 100 == b // 100 for a, b in pairs)
    return [{(a % 100, b % 100) for a, b in pairs if a // 100 == g} for g in range(len(groups))]


def test_findings_that_miss_a_part_are_repeated_by_such_findings(spark):
    whole, groups = ("r", "a.py", 5, "T", "S1", "x 'f'"), []
    for part, missing in [(0, (None, " ")), (1, (None, "")), (2, (None,)), (3, (None, "--")), (5, (None, "", "too long: 7"))]:
        own = (*whole[:4], f"S{part}", whole[5])
        groups.append([own, *[(*own[:part], m, *own[part + 1 :]) for m in missing] * 2])
    assert found(spark, *groups) == [{(2, i) for i in range(3, len(group) + 1)} for group in groups]
    lines = [("r", "a.py", n, "T", "S1", "line too long") for n in (5, 8, 9)]
    no_line = [("q", "a.py", n, "T", None, None) for n in (None, 0, 2, None, None)]
    assert found(spark, lines, no_line) == [{(1, 2)}, {(1, 4), (1, 5), (2, 3)}]


def test_names_however_they_are_written(spark):
    """A message, one that names another thing, and one that names the same as the first."""
    messages = [
        ("'größe' is long", "'grüße' is long", "found in «GRÖßE»"),
        ("'3' hits in 'load'", "'3' hits in 'save'", "'5' hits in 'Load'"),
        ("'load()' is long", "'save()' is long", 'long: "load(path, n)"'),
        ("`Job::run` is long", "`Job::stop` is long", "long: 'job::RUN'"),
        ("load_all is long", "save_all is long", "long: LOAD_ALL (7)"),
        ("long function loadAll", "long function saveAll", "in src/to_do/my_file.py: loadAll"),
        ("HARDCODED_SECRET in api_key", "HARDCODED_SECRET in db_pass", "hardcoded secret in API_KEY"),
        ("load() is long", "save() is long", "long, 3 file(s): load(path)"),
    ]
    groups = [[(f"r{g}", "a.py", 5, "HARDCODED_SECRET", "S1", m) for m in group] for g, group in enumerate(messages)]
    assert found(spark, *groups) == [{(1, 3)}] * len(messages)


def test_paths_types_and_rules_however_they_are_written(spark):
    written = ["src/a.py", "src/x/y/z/../../../a.py", "C:\\\\agent\\\\_work\\\\3\\\\s\\\\src\\\\a.py", "/home/runner//work/r/r/./src/a.py", "file:///home/runner/work/r/r/src/a.py", "file:///C:/agent/_work/3/s/src/a.py", "FILE:///workspace/r/src/a.py", "\tsrc/a.py\n"]
    paths, out = [("p", p, 5, "T", "S1", "'f'") for p in written], [("o", p, 5, "T", "S1", "'f'") for p in ["../a.py", "a.py", "x/../../a.py", "b/../../../a.py"]]
    types = [("t", "a.py", 5, t, "S1", "'f'") for t in ["Größe", "Grüße", "GRÖßE"]]
    rules = [("u", "a.py", 5, "T", r, "'f'") for r in ["SEC-003", "rule:sec/SEC003", "SEC\u00a03", "SEC004"]]
    assert found(spark, paths, out, types, rules) == [{(1, i) for i in range(2, len(written) + 1)}, {(1, 3)}, {(1, 3)}, {(1, 2), (1, 3)}]
