"""Problem 1: source files that do not parse.

Files are lexed into token rows. The pairs of adjacent tokens are anti-joined with the pairs that a grammar of the
language permits (`syntax_languages`, derived, not listed). What pairs can't see is validated by windowed reductions:
brackets are matched by a running depth and the preceding bracket of that depth, statements by productions on their
shapes, each shape judged once, and by windows over a file's statements for blocks, handlers and mappings. Where this
Python has a parser of the language (Python, JSON, TOML, YAML), it has the last word on the files so flagged.

The extension or the Dockerfile name decides the language. Files of other languages, null paths and null contents
have no row. Empty files are legal where the language has empty programs. Every row of a file scanned again counts.
A file's tokens never leave its row but for brackets and statements, so a hot repository is like any other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.syntax_languages import pairs, yaml_tokens
from lintlake.llm.syntax_lex import lex
from lintlake.llm.syntax_statements import PYTHON_BLOCKS, legal, sql_statements, statements
from lintlake.session import spread, stored

# The language of a file extension.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "yaml": "yaml",
    "yml": "yaml", "json": "json", "toml": "toml", "tf": "terraform", "tfvars": "terraform", "hcl": "terraform", "sh": "shell", "bash": "shell", "sql": "sql", "dockerfile": "dockerfile",
}
LANGUAGES = sorted(set(EXTENSIONS.values()))
BRACKETS = {
    "LP": ("r", 1), "RP": ("r", -1), "RPH": ("r", -1), "LB": ("s", 1), "RB": ("s", -1), "LC": ("c", 1), "RC": ("c", -1), "LCB": ("c", 1), "LCO": ("c", 1), "LCC": ("c", 1), "LCE": ("c", 1),
    "RCB": ("c", -1), "RCO": ("c", -1), "RCC": ("c", -1), "RCT": ("c", -1), "RCD": ("c", -1), "RCI": ("c", -1), "RCE": ("c", -1),
}


def language_of(path: str | None) -> str | None:
    """The language a path decides on."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    if name == "dockerfile" or name.startswith("dockerfile."):
        return "dockerfile"
    return EXTENSIONS.get(name.rsplit(".", 1)[-1]) if "." in name else None


def _codes() -> dict[str, int]:
    """A number for every token class of any grammar; what no grammar knows is 0."""
    known = {t.lstrip("^") for language in LANGUAGES if language != "dockerfile" for p in pairs(language) for t in p}
    return {t: i + 1 for i, t in enumerate(sorted(known))}


BROKE = 1024
KINDS = "rsc"


def lexed(files: DataFrame) -> DataFrame:
    """(file_id, language, pairs, brackets, statements) of files with a known language.

    A token is its class's number, plus BROKE after a line break that counts; `pairs` are a file's distinct pairs of
    adjacent tokens, `brackets` its brackets in order, each with its place, kind and direction in one number.
    """
    codes = _codes()
    numbers_of = codes | {f"^{t}": c + BROKE for t, c in codes.items()}
    kinds = {t: KINDS.index(k) << 1 | (step > 0) for t, (k, step) in BRACKETS.items() if t in codes}
    kinds |= {f"^{t}": k for t, k in kinds.items()}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, path, text in zip(batch["file_id"], batch["file_path"], batch["content"]):
                language = language_of(path)
                if language is None or text is None:
                    continue
                if language == "sql":
                    tokens, parts = sql_statements(text)
                elif language == "yaml":
                    parts = statements(text, language, [])
                    tokens = [(t, 0) for t in yaml_tokens(parts)]
                elif language == "dockerfile":
                    tokens, parts = [], statements(text, language, [])
                else:
                    tokens = lex(text, language)
                    parts = statements(text, language, tokens)
                numbers = [numbers_of.get(t, BROKE if t[0] == "^" else 0) for t, _ in tokens]
                met = [a % BROKE * (2 * BROKE) + b for a, b in set(zip(numbers, numbers[1:]))]
                brackets = [place << 3 | kinds[t] for place, (t, _) in enumerate(tokens) if t in kinds]
                rows.append((file_id, language, met, brackets, parts))
            yield pd.DataFrame(rows, columns=["file_id", "language", "pairs", "brackets", "statements"])

    schema = "file_id bigint, language string, pairs array<int>, brackets array<bigint>, statements array<struct<seq:int,indent:int,head:string,shape:string>>"
    return spread(files.select("file_id", "file_path", "content")).mapInPandas(look, schema)


def permissible(spark) -> DataFrame:
    """(language, pair): as many rows as the grammars have pairs, whatever the input."""
    codes = _codes()
    number = lambda t: codes[t[1:]] + BROKE if t[0] == "^" else codes[t]
    rows = [(language, codes[a.lstrip("^")] * 2 * BROKE + number(b)) for language in LANGUAGES if language != "dockerfile" for a, b in pairs(language)]
    return spark.createDataFrame(rows, "language string, pair int")


def _bad_pairs(read: DataFrame) -> DataFrame:
    rows = read.select("file_id", "language", F.explode("pairs").alias("pair"))
    return rows.join(F.broadcast(permissible(read.sparkSession)), ["language", "pair"], "left_anti").select("file_id")


def _bad_nesting(read: DataFrame) -> DataFrame:
    b = F.col("b")
    rows = read.select("file_id", F.explode("brackets").alias("b"))
    rows = rows.select("file_id", F.shiftright(b, 3).alias("pos"), F.shiftright(b, 1).bitwiseAND(F.lit(3)).alias("kind"), (b.bitwiseAND(F.lit(1)) * 2 - 1).alias("step"))
    order = Window.partitionBy("file_id").orderBy("pos")
    rows = rows.withColumn("after", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("level", F.when(F.col("step") == 1, F.col("after")).otherwise(F.col("after") + 1))
    rows = rows.withColumn("partner", F.lag("kind").over(Window.partitionBy("file_id", "level").orderBy("pos")))
    bad = (F.col("after") < 0) | ((F.col("step") == -1) & (F.col("partner").isNull() | (F.col("partner") != F.col("kind"))))
    return rows.groupBy("file_id").agg(F.max(bad.cast("int")).alias("bad"), F.sum("step").alias("left")).where("bad = 1 or left <> 0").select("file_id")


def _bad_statements(read: DataFrame) -> DataFrame:
    rows = read.where(F.size("statements") > 0).select("file_id", "language", F.explode("statements").alias("s")).select("file_id", "language", "s.*")
    shapes = rows.groupBy("language", "head", "shape").agg(F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("boolean")
    def judged(language: pd.Series, head: pd.Series, shape: pd.Series) -> pd.Series:
        return pd.Series([legal(a, b, c) for a, b, c in zip(language, head, shape)], dtype=bool)

    illegal = shapes.where(~judged("language", "head", "shape")).select("language", "head", "shape")
    by_shape = rows.join(illegal, ["language", "head", "shape"], "left_semi").select("file_id")
    python, yaml = rows.where("language = 'python'"), rows.where("language = 'yaml'")
    order = Window.partitionBy("file_id").orderBy("seq")
    level = Window.partitionBy("file_id", "indent").orderBy("seq")
    p = python.withColumns({"next_indent": F.lead("indent").over(order), "before": F.lag("head").over(level), "after": F.lead("head").over(level)})
    blocks = F.col("head").isin(*PYTHON_BLOCKS)
    bad = (
        (F.col("shape") == "block") & (F.col("next_indent").isNull() | (F.col("next_indent") <= F.col("indent")))
        | (F.col("shape") != "block") & (F.col("next_indent") > F.col("indent"))
        | (F.col("head") == "try") & (F.col("after").isNull() | ~F.col("after").isin("except", "finally"))
        | F.col("head").isin("except", "finally") & (F.col("before").isNull() | ~F.col("before").isin("try", "except", "else"))
        | (F.col("head") == "elif") & (F.col("before").isNull() | ~F.col("before").isin("if", "elif"))
        | (F.col("head") == "else") & (F.col("before").isNull() | ~F.col("before").isin("if", "elif", "for", "while", "except", "async"))
        | ~blocks & (F.col("shape") == "cut")
    )
    y = yaml.withColumns({"prev_indent": F.lag("indent").over(order), "sibling": F.lag("head").over(level)})
    odd = (F.col("indent") < F.col("prev_indent")) & F.col("sibling").isNull()
    return by_shape.unionByName(p.where(bad).select("file_id")).unionByName(y.where(odd).select("file_id"))


def parses(text: str, language: str) -> bool:
    """Whether a parser of this Python accepts a text; False where it has none, so that the flag stands."""
    try:
        if language == "python":
            import ast

            ast.parse(text)
            return True
        if language == "json":
            json.loads(text.removeprefix("\ufeff"), parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
            return True
        if language == "toml":
            import tomllib

            tomllib.loads(text)
            return True
        if language == "yaml":
            try:
                import yaml
            except ImportError:
                return False
            loader = getattr(yaml, "CParser", None)
            for _ in yaml.parse(text, Loader=getattr(yaml, "CLoader", yaml.Loader) if loader else yaml.Loader):
                pass
            return True
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return False
    except Exception as e:
        if type(e).__module__.startswith("yaml"):
            return False
        raise
    return False


EXACT = ("python", "json", "toml", "yaml")


def unparsable(files: DataFrame) -> DataFrame:
    """(file_id, language) of every file whose content its language's syntax rejects."""
    read = stored(lexed(files), "lexed")
    flagged = _bad_pairs(read).unionByName(_bad_nesting(read)).unionByName(_bad_statements(read)).distinct()
    flagged = stored(flagged.join(read.select("file_id", "language"), "file_id"), "flagged")
    sure = flagged.where(~F.col("language").isin(*EXACT))
    doubtful = files.select("file_id", "content").join(flagged.where(F.col("language").isin(*EXACT)), "file_id")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [not parses(t, g) for t, g in zip(batch["content"], batch["language"])]
            yield batch.loc[keep, ["file_id", "language"]]

    return sure.unionByName(doubtful.mapInPandas(check, "file_id bigint, language string"))


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, files, unparsable, rate) per repository and language of the path."""
    named = files.select("file_id", "repo", "file_path")
    low = F.lower(F.regexp_extract(F.regexp_replace("file_path", r"\\", "/"), r"([^/]*)$", 1))
    ext = F.when(low.rlike(r"^dockerfile(\.|$)"), F.lit("dockerfile")).otherwise(F.regexp_extract(low, r"\.([^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    bad = unparsable(files).select("file_id", F.lit(1).alias("bad"))
    return (
        named.withColumn("language", table[ext])
        .where("language is not null")
        .join(bad, "file_id", "left")
        .groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count("bad").alias("unparsable"), F.round(F.count("bad") / F.count(F.lit(1)), 6).alias("rate"))
    )
