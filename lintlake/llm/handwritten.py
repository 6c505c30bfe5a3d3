"""Problem 7: tell generated, minified, vendored and data files from hand-written source.

One pass over the files looks for generation and third-party notices with a multi-pattern automaton, on comment lines
only, so code and texts about such files don't count; and for lock files, minified, bundled and generated suffixes and
vendored directories with path rules. A name alone never decides but for lock files and vendored directories: a
minified suffix counts with dense text, a generated one with a notice too weak to count alone. Files neither decides
are measured (line lengths, share of literals, numbered accessors), since a file counts by what it is.

Copies of third-party files that lost their notice, changed a little, are found by near-duplication with files known
as vendored: exact copies are put into classes, classes meet in MinHash bands over five-word shingles, and a class
joins when its shingle similarity to a vendored class is 0.8 or more. Bands are joined as ids and sizes, pairs whose
sizes differ too much for that similarity never meet, and shingles are fetched for classes that met. A class is first
compared with one vendored representative of each band it is in; only classes still open are then compared with all
others of their bands. Sixteen bands of five rows miss a pair of similarity 0.8 with probability 0.002.

Null content: judged by path only. Null path: by content only. Empty files, nulls in other columns and unknown
languages are hand-written unless a rule says otherwise. Scans of a file again: each row its own result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import spread, stored

# Notices of tools that wrote a file, by language.
GENERATED_NOTICES = [
    "@generated", "auto-generated", "autogenerated", "auto generated", "automatically generated", "code generated", "generated by", "generated from", "generated on", "generated file",
    "generated code", "generated using", "generated with", "machine generated", "machine-generated", "machine written", "machine-written", "was produced by", "do not edit", "do not modify",
    "don't edit", "changes are overwritten", "changes will be overwritten", "changes will be lost", "edits will be lost", "will be regenerated", "<auto-generated", "automatisch erzeugt",
    "automatisch generiert", "nicht von hand", "nicht bearbeiten", "nicht editieren", "fichier produit par", "fichier généré", "généré par", "généré automatiquement", "ne pas modifier",
    "ne pas éditer", "archivo creado por", "archivo generado", "generado por", "generado automáticamente", "no editar", "no modificar", "gerado por", "gerado automaticamente",
    "arquivo gerado", "arquivo criado por", "não editar", "não edite", "não modificar", "file generato", "generato da", "non modificare",
]
# Notices of third-party projects.
THIRD_PARTY_NOTICES = [
    "spdx-filecopyrighttext:", "spdx-license-identifier:", "upstream:", "part of the", "released under the", "licensed under the", "free to copy with this notice", "all rights reserved",
    "permission is hereby granted", "redistribution and use", "apache license", "mit license", "bsd license", "mozilla public license", "gnu general public", "contributors", "authors", "developers",
]
VENDOR_DIRS = "vendor _vendor vendored third_party thirdparty 3rdparty third-party external externals extern deps node_modules bower_components jspm_packages site-packages pods carthage godeps".split()
VENDOR_PAIRS = [("libs", "3rd"), ("contrib", "upstream"), ("lib", "vendor"), ("3rd", "party")]
LOCK_FILES = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock pdm.lock uv.lock pipfile.lock cargo.lock composer.lock gemfile.lock go.sum packages.lock.json .terraform.lock.hcl gradle.lockfile bun.lock deno.lock flake.lock mix.lock podfile.lock".split()

COMMENT = re.compile(r"[^\S\n]*(?://|#|/\*|\*|--|;|<!--|\"\"\"|''')")
SUFFIX_MINIFIED = re.compile(r"(?:[.\-]min|[.\-]bundle|\.chunk|\.[0-9a-f]{8,})\.(?:js|mjs|cjs|css|ts|mts|cts|py)$|(?:^|/)min\.js$")
SUFFIX_GENERATED = re.compile(r"(?:\.g|\.gen|\.generated|_generated|\.pb|_pb2|_pb2_grpc|\.designer|_gen|Stub|\.auto)\.\w+$")
THIRD_PARTY_LINE = re.compile(
    r"(?i)copyright\s+(?:\(c\)|©)?\s*\d{4}.*\b(?:authors|contributors|developers|project|foundation|inc)\b|\(c\)\s+(?:\d{4}\s+)?\S+\s+(?:authors|contributors|developers|project)\b"
    r"|spdx-filecopyrighttext:\s*\d{4}.*\b(?:authors|contributors|developers|project)\b|^\W*upstream:\s*\S+|part of the \S+ (?:library|project|framework|package)"
    r"|released under the terms in license|permission is hereby granted|redistribution and use in source|licensed under the (?:apache|mit|bsd|mozilla|gnu)"
)
OWN_LINE = re.compile(r"(?i)internal use|our team|\bour own\b|proprietary")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`")
_LITERAL = re.compile(r"\b0[xX][0-9a-fA-F]+\b|(?<![A-Za-z_])[-+]?\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?[fFlLu]?\b|\b(?:true|false|null|None|True|False|nil)\b")
_NUMBERED = re.compile(r"\d(?<=[A-Za-z_]\d)\d{0,3}(?![\d.])")
_KEYS = re.compile(r"\"\"|\w+[^\S\n]*:")
_MAY_BE_DATA = re.compile(r"[0-9\"]|true|false|null|None|True|False|nil")
_LETTER = re.compile(r"[A-Za-z_]")
_COMMENT_LINES = re.compile(r"(?m)^[^\S\n]*(?://|#|/\*|\*|--|;|<!--|\"\"\"|''').*")
PREAMBLE = re.compile(r"^\s*(?:package\b|module\b|namespace\b|['\"]use strict['\"]|<\?|@charset\b)")
_SQL_VALUE = r"(?:'(?:[^']++|'')*+'|[-+]?[\d.]++|null|true|false)"
SQL_ROW = re.compile(rf"(?i)^\s*(?:insert\s+into\s+\S+\s*(?:\([^()]*\))?\s*values\s*)?\(\s*{_SQL_VALUE}\s*(?:,\s*{_SQL_VALUE}\s*)*+,?\s*\)\s*[,;]?\s*$")
DATA_LANGUAGES = re.compile(r"(?i)\.(?:py|js|mjs|cjs|ts|tsx|jsx|go|java|rb|rs|c|cc|cpp|h|cs|php|sh)$")

PERMUTATIONS, BANDS, ROWS = 80, 16, 5
SIMILARITY = 0.8
#: ids of classes that are sent to every executor, at most 8 MB of them; beyond that they are shuffled
BROADCAST_IDS = 1_000_000
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for words, kind in ((GENERATED_NOTICES, "g"), (THIRD_PARTY_NOTICES, "t")):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def header_end(text: str) -> int:
    """Where the leading comments of a text end: blank lines, comments and declarations of package or mode before code."""
    at, closing = 0, ""
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        bare = line.strip()
        if closing:
            if closing in line:
                closing = ""
        elif not bare or COMMENT.match(line) or PREAMBLE.match(line):
            for opening, close in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''")):
                if bare.startswith(opening) and close not in bare[len(opening) :]:
                    closing = close
        else:
            break
        at = end + 1
    return at


def notices(text: str) -> set[str]:
    """The notices of a text that count alone."""
    return all_notices(text) - {"mention"}


def all_notices(text: str) -> set[str]:
    """`generated` and `third_party`, for notices that stand on comment lines, and `mention` for weaker generation notices.

    A generation notice counts anywhere in a file, some tools sign at its end; a third-party notice in the leading comments.
    """
    found = set()
    low, header = text.lower(), -1
    for end, (kind, size) in _automaton().iter(low):
        at = end - size + 1
        start = low.rfind("\n", 0, at) + 1
        if start < end and low.count("\n", start, end):
            continue
        mark = COMMENT.match(low, start, end)
        if not mark:
            continue
        if kind == "g":
            if "generated" in found:
                continue
            found.add("mention")
            lead = low[mark.end() : at]
            if at - mark.end() < 400 and len(re.findall(r"\w+", lead)) <= 4 and not re.search(r"[\"'`]", lead):
                found.add("generated")
        elif "third_party" not in found:
            if header < 0:
                header = header_end(text)
            if start < header:
                stop = low.find("\n", end)
                line = low[start : stop if stop >= 0 else len(low)]
                if THIRD_PARTY_LINE.search(line) and not OWN_LINE.search(line):
                    found.add("third_party")
    return found - {"mention"} if "generated" in found else found


def path_rules(path: str) -> set[str]:
    """`lock`, `minified`, `generated` and `vendored` as far as a path suggests them.

    `vendored` needs a package directory below the vendored one: files right in `vendor/` may be anybody's.
    """
    parts = path.replace("\\", "/").split("/")
    low = [p.lower() for p in parts]
    out = set()
    if low[-1] in LOCK_FILES:
        out.add("lock")
    if SUFFIX_MINIFIED.search(path):
        out.add("minified")
    if SUFFIX_GENERATED.search(parts[-1]):
        out.add("generated")
    for i, p in enumerate(low[:-2]):
        if p in VENDOR_DIRS:
            out.add("vendored")
        if (p, low[i + 1]) in VENDOR_PAIRS and i + 2 < len(low) - 1:
            out.add("vendored")
    return out


def measures(text: str, path: str) -> set[str]:
    """`minified`, `data` and `accessors`, from the text itself; a bare object is a configuration, whatever its extension."""
    out = set()
    every = text.split("\n")
    lines = [x for x in every if x.strip()]
    if not lines:
        return out
    size = sum(map(len, lines))
    held = _STRING.sub('""', text)
    literal = held.replace('""', "")
    code = bool(DATA_LANGUAGES.search(path)) or not path
    if code:
        long_part = sum(len(x) for x in lines if len(x) > 250)
        blanks = sum(x.count(" ") + x.count("\t") for x in lines)
        packed = blanks < 0.12 * size if long_part > 0.5 * size else blanks < 0.09 * size and size > 300
        marks = literal.count(",") + literal.count("=")
        airy = literal.count(", ") + literal.count(" = ") + literal.count(" == ") + literal.count(",\n") > 0.2 * max(marks, 1)
        if packed and not airy and len(literal) > 0.4 * size:
            out.add("minified")
        likely = sum(len(x) for x, h in zip(every, held.split("\n")) if _MAY_BE_DATA.search(h))
        if likely > 0.7 * size and size > 300 and not text.lstrip().startswith("{"):
            bare = _LITERAL.sub("0", held)
            data = 0
            for x, h, b, k in zip(every, held.split("\n"), bare.split("\n"), _KEYS.sub("", bare).split("\n")):
                if ("0" in b or '""' in b) and not _LETTER.search(k) or len(x) > 200 and len(x) - len(h) > 0.8 * len(x):
                    if x.strip() and not COMMENT.match(x):
                        data += len(x)
            if data > 0.7 * size:
                out.add("data")
    if path.lower().endswith(".sql"):
        rows = [x for x in lines if SQL_ROW.match(x)]
        if len(rows) >= 20 and sum(map(len, rows)) > 0.8 * size:
            out.add("data")
    numbered, top, line_end = 0, set(), -1
    for m in _NUMBERED.finditer(literal):
        top.add(int(m.group()))
        if m.start() > line_end:
            numbered += 1
            line_end = literal.find("\n", m.end())
            if line_end < 0:
                line_end = len(literal)
    run = 0
    while run in top or run + 1 in top and run == 0:
        run += 1
    if numbered > 0.4 * len(lines) and run >= 6:
        out.add("accessors")
    return out


def dense(text: str) -> bool:
    """Whether a text, its strings and block comments aside, has many statements a line and hardly a blank.

    It flags short and string-heavy files as well, so it counts only where a minified suffix is the other evidence.
    """
    bare = re.sub(r"/\*[\s\S]*?\*/", "", _STRING.sub('""', text))
    lines = [x for x in bare.split("\n") if x.strip() and not x.lstrip().startswith("//")]
    size = sum(map(len, lines))
    blanks = sum(x.count(" ") + x.count("\t") for x in lines)
    marks = sum(x.count(c) for x in lines for c in ";{},")
    airy = sum(x.count(", ") + x.count(" = ") + x.count(": ") + x.count(" {") for x in lines)
    return bool(lines) and blanks < 0.12 * size and marks >= 4 * len(lines) and airy <= 0.2 * marks


class _Codes(dict):
    """Hashes of words, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return code


_codes = _Codes()


def _shingles(text: str) -> np.ndarray:
    """Hashes of the five-word shingles of a text without its comments."""
    words = re.findall(r"\w+|[^\w\s]", _COMMENT_LINES.sub("", text))
    if len(words) < 5:
        return np.zeros(0, np.int32)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    h = codes[:-4].copy()
    for k in range(1, 5):
        h = h * np.uint64(6364136223846793005) + codes[k : len(codes) - 4 + k]
    return np.unique(h >> np.uint64(33)).astype(np.int32)


def _bands(shingles: np.ndarray) -> list[int]:
    """The MinHash bands of a set of shingles; long sets in pieces, so memory doesn't grow with a file."""
    values = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096].astype(np.uint64)
        values = np.minimum(values, ((part[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(24)).min(axis=1))
    rows = values.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h = (h ^ rows[:, k]) * np.uint64(0x100000001B3)
    return h.astype(np.int64).tolist()


PROFILE = "file_id bigint, reasons array<string>, evidence array<string>, class_id bigint, n int, shingles array<int>, bands array<bigint>"


def judged_alone(path: str, text: str) -> tuple[list[str], list[str]]:
    """(reasons, what shows them) of one file; the text is measured only where notices and path don't decide."""
    by_path, by_notice = path_rules(path), all_notices(text)
    found = []
    if "lock" in by_path:
        found.append(("lock file", "path"))
    if "generated" in by_notice:
        found.append(("generated", "notice"))
    elif "mention" in by_notice and "generated" in by_path:
        found.append(("generated", "path and notice"))
    if "third_party" in by_notice:
        found.append(("vendored", "notice"))
    elif "vendored" in by_path:
        found.append(("vendored", "path"))
    if "minified" in by_path and dense(text):
        found.append(("minified", "path and text"))
    if not found:
        by_text = measures(text, path)
        found = [(reason, "text") for reason, measure in (("generated", "accessors"), ("minified", "minified"), ("data", "data")) if measure in by_text]
    return [r for r, _ in found], [e for _, e in found]


def profiles(files: DataFrame) -> DataFrame:
    """A row per file: the reasons found in it alone, and its class of exact copies, shingles and bands.

    Files that are settled and vendored by nobody's account need none of the latter.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, path, text in zip(batch["file_id"], batch["file_path"], batch["content"]):
                path, text = path or "", text or ""
                reasons, evidence = judged_alone(path, text)
                s = _shingles(text) if not reasons or "vendored" in reasons else np.zeros(0, np.int32)
                class_id = int(np.bitwise_xor.reduce(s.astype(np.int64) * np.int64(0x5851F42D4C957F2D))) ^ len(s) if len(s) else None
                rows.append((file_id, reasons, evidence, class_id, len(s), s.tolist(), _bands(s) if len(s) else []))
            yield pd.DataFrame(rows, columns=["file_id", "reasons", "evidence", "class_id", "n", "shingles", "bands"]).astype({"class_id": "Int64"})

    return spread(files.select("file_id", "file_path", "content")).mapInPandas(look, PROFILE)


def _similar(a: str, b: str):
    both = F.size(F.array_intersect(f"{a}.shingles", f"{b}.shingles"))
    return both >= SIMILARITY * (F.size(f"{a}.shingles") + F.size(f"{b}.shingles") - both)


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, reasons, evidence) of files that no team member wrote by hand."""
    seen = stored(profiles(files), "profiles")
    marked = seen.where(F.size("reasons") > 0).select("file_id", "reasons", "evidence")
    members = seen.where("class_id is not null").select("file_id", "class_id", "n", F.array_contains("reasons", "vendored").alias("known"))
    classes = members.groupBy("class_id").agg(F.max("known").alias("known"), F.max(~F.col("known")).alias("open"))
    known = classes.where("known").select("class_id")
    # Bands go without their shingles: a class is a band, an id and a size in every shuffle.
    banded = seen.where("class_id is not null").select(F.explode("bands").alias("band"), "class_id", "n", F.array_contains("reasons", "vendored").alias("known")).distinct()
    of_known = stored(banded.where("known").select("band", F.col("class_id").alias("known_id"), F.col("n").alias("known_n")), "known")
    open_ = stored(banded.where("not known").join(of_known.select("band").distinct(), "band", "left_semi").join(known, "class_id", "left_anti").select("band", F.col("class_id").alias("open_id"), "n"), "open")
    near_size = (F.col("n") >= SIMILARITY * F.col("known_n")) & (F.col("known_n") >= SIMILARITY * F.col("n"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The open classes of those pairs that are similar; shingles are fetched for the classes that met alone."""
        pairs = stored(pairs.distinct(), "pairs")
        met = stored(pairs.select(F.col("open_id").alias("class_id")).unionByName(pairs.select(F.col("known_id").alias("class_id"))).distinct(), "met")
        few = met.count() <= BROADCAST_IDS
        body = seen.select("class_id", "shingles").join(F.broadcast(met) if few else met, "class_id", "left_semi").dropDuplicates(["class_id"])
        a, b = body.alias("a"), body.alias("b")
        return (
            pairs.join(a, F.col("open_id") == F.col("a.class_id"))
            .join(b, F.col("known_id") == F.col("b.class_id"))
            .where(_similar("a", "b"))
            .select(F.col("open_id").alias("class_id"))
            .distinct()
        )

    one = of_known.groupBy("band").agg(F.min(F.struct("known_id", "known_n")).alias("k"), F.count(F.lit(1)).alias("others")).select("band", "k.*", "others")
    first = stored(verified(open_.join(one, "band").where(near_size).select("open_id", "known_id")), "first")
    rest = open_.join(first.select(F.col("class_id").alias("open_id")), "open_id", "left_anti").join(one.where("others > 1").select("band"), "band", "left_semi")
    second = verified(rest.join(of_known, "band").where(near_size).select("open_id", "known_id"))
    copies = first.unionByName(second).unionByName(classes.where("known and open").select("class_id")).distinct()
    joined = members.where("not known").select("file_id", "class_id").join(copies, "class_id", "left_semi")
    return marked.unionByName(joined.select("file_id", F.array(F.lit("vendored")).alias("reasons"), F.array(F.lit("copy")).alias("evidence")))
