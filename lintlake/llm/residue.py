"""Problem 10: find documents that hold no real text, or text a template left unfinished.

Sentences are mined for message templates with a prefix tree of fixed depth. The path of a sentence is its number of
words, its first `DEPTH` words and its last one, words with digits or marks being wildcards. A leaf holds templates; a
sentence joins the template of its leaf it is most similar to, if at least `SIMILAR` of the words are equal, and words
that differ become wildcards; otherwise it founds a template. Trees are grown over the distinct sentences of each
partition first, and their templates, which are few, are merged by a second tree after a shuffle by leaf, so a template
that a third of all sentences follow is a few rows when it is shuffled.

Every template is classified once, by its most frequent sentence; templates that hardly ever occur but in the company
of residue inherit its verdict; verdicts are joined back. A document is residue when at least one sentence is and none
is ordinary, headings aside. Separately every document is searched for unresolved slots in its running text and
headings, quotations and code left out.

Texts are read whole, line by line and with expressions that take time in proportion to a text; a sentence of more than
`LONGEST` words is judged in pieces of that many.

Null or empty texts, and texts of headings alone, are no cases unless a slot is unresolved. Copies are judged alike, a
repeated doc_id is one case. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import spread, stored

DEPTH = 3
SIMILAR = 0.7
COMPANY = 0.8
LONGEST = 200

# What pages of servers and browsers and filler texts say, by kind; letters with accents may be damaged,
# so they stand as `.{1,3}`.
RESIDUE = {
    "status": r"^\W*(?:http\s*/?\s*[\d.]*\s*)?(?:error|erreur|fehler|erro|http)?\s*[:#]?\s*\(?[45]\d\d\)?\s*[:\-–]?\s*(?:not found|bad gateway|gateway time-?out|service unavailable|internal server error|forbidden|unauthorized|too many requests|bad request|gone|method not allowed|request time-?out)?\W*$",
    "status_name": r"^\W*(?:error\s*)?(?:\d{3}\W+)?(?:not found|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|forbidden|access (?:is )?denied|unauthori[sz]ed|too many requests|page not found|bad request)(?:\W+\(?\d{0,3}\)?)?\W*$",
    "page_en": r"(?:requested (?:address|page|url|resource|path)\b.*\b(?:not found|does not exist|could not be found)|page you (?:asked|are looking|requested) for|this page has moved or no longer exists|address leads nowhere|you do not have permission|you have sent too many requests|request was (?:blocked|rejected|denied)|server did not (?:answer|respond)|upstream timed out|went wrong|session has (?:expired|timed out)|down for maintenance|(?:please )?try again (?:in|later)|if the problem persists|return to the home ?page|back to (?:start|the start|home)|sign in to continue|skip to content|temporarily unavailable|something broke|^\W*oops\W*$|checking your browser|are you a robot|verify you are human|ddos protection|connection (?:was )?(?:reset|refused)$)",
    "page_fr": r"(?:page (?:est )?(?:introuvable|inexistante)|adresse .*n.existe pas|pas les droits n.{1,3}cessaires|acc.{1,3}s (?:refus|interdit|non autoris)|session a expir|veuillez r.{1,3}essayer|retour .{1,3} l.accueil|erreur (?:interne|est survenue|s.est produite)|service (?:est )?(?:indisponible|momentan)|trop de requ.{1,3}tes|une erreur|site est en maintenance|si le probl.{1,3}me persiste|n.est pas disponible)",
    "page_de": r"(?:seite (?:wurde )?(?:nicht gefunden|existiert nicht|gibt es nicht)|adresse .*(?:gibt es nicht|existiert nicht|wurde nicht gefunden)|keine berechtigung|zugriff verweigert|sitzung ist abgelaufen|bitte versuchen sie es|zur startseite|wenden sie sich an|ein fehler aufgetreten|dienst ist (?:zurzeit|derzeit|momentan) nicht|zu viele anfragen|interner (?:server)?fehler|wartungsarbeiten|nicht verf.{1,3}gbar|wird gewartet|(?:wenn|falls) (?:der fehler|das problem) (?:weiter|bestehen|anh))",
    "page_es": r"(?:p.{1,3}gina no (?:encontrada|existe|se encuentra)|direcci.{1,3}n .*no existe|no tiene permiso|acceso denegado|sesi.{1,3}n ha (?:caducado|expirado)|int.{1,3}ntelo de nuevo|volver al inicio|ha ocurrido un error|se ha producido un error|algo (?:ha )?sali|servicio no (?:est.{1,3} )?disponible|demasiadas (?:peticiones|solicitudes)|error interno|en mantenimiento|no se ha encontrado|no encontramos|si el (?:fallo|error|problema) (?:contin|persist))",
    "page_pt": r"(?:p.{1,3}gina (?:n.{1,3}o|nao) (?:encontrada|existe|foi)|endere.{1,3}o .*(?:n.{1,3}o|nao) (?:existe|foi)|(?:n.{1,3}o|nao) tem permiss|acesso negado|sess.{1,3}o expirou|tente novamente|voltar ao in|ocorreu um erro|algo deu errado|servi.{1,3}o indispon|muitas (?:solicita|requisi)|erro interno|em manuten|p.{1,3}gina indispon|se o (?:erro|problema) (?:contin|persist))",
    "scripts_en": r"(?:(?:please |you need to |you must |turn on |switch on )(?:enable|allow|activate|turn on)? ?(?:javascript|scripts)|requires (?:javascript|scripts)|needs? (?:javascript|scripts) to|javascript (?:seems to be |is |appears to be |must be )?(?:disabled|switched off|turned off|required|needed|enabled|off)|does not support (?:javascript|scripts)|scripts? (?:must be allowed|support is switched off|are (?:blocked|disabled|switched off))|allow scripts|turn them on and reload|without javascript|enable javascript to|script support is)",
    "scripts_other": r"(?:activ(?:e|ez|ar|er|a|ieren sie)? (?:o |le |el )?javascript|activer (?:le )?javascript|ative o javascript|aktivieren sie (?:bitte )?javascript|habilit\w+ (?:el |o )?javascript|javascript (?:est |ist |est.{1,3} )?(?:d.{1,3}sactiv|deaktiviert|desactivad|desativad|requis|erforderlich|necesari|necess)|(?:requiert|n.{1,3}cessite|ben.{1,3}tigt|requiere|necesita|requer|precisa de) (?:de )?javascript|ohne javascript|sans javascript|sin javascript|sem javascript|permit\w+ (?:los |os )?scripts|autoris\w+ les scripts|skripte)",
    "latin_filler": r"^(?:\W*\b(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum)\b){4,}\W*$",
    "filler": r"(?:\blorem\b|\bipsum\b|dolor sit amet|consectetur|^\W*(?:\w[\w ]*:)?\s*(?:tbd|todo|tba|fixme|n/a|wip)\W*$|insert (?:content|text)(?: here)?\W*$|(?:your|sample|dummy|placeholder|example|some|add (?:your|a)?) ?(?:text|copy|paragraph|content|description)(?: goes)?(?: here|,|\W*$)|add a description here|description of item|blindtext|texte? (?:.{1,3} remplacer|de remplissage|d.exemple)|texto de (?:relleno|ejemplo|exemplo|preenchimento)|faux.texte|platzhalter|replace before release|final wording to follow|coming soon\W*$|content (?:goes|coming) (?:here|soon)|to be (?:written|added|completed|defined|done)\W*$|(\b\w+(?:\W+\w+){0,3}?)(?:\W+\1\b){3,})",
}
NEUTRAL = r"^\W*(?:\(?code \d+\)?|ref(?:erence)?\W+[0-9a-f\-]+|request id\W+[0-9a-f\-]+|[\w.\-]+/\d[\d.]*|menu|home|help|contact|back|help \| contact)\W*$"

# Spellings of unresolved slots.
SLOTS = [
    r"\{\{\s*[\w .]+?\s*\}\}", r"\{%\s*[\w .]+?\s*%\}", r"<%=?\s*[\w. ]+?\s*%>", r"\$\{[\w.]+\}", r"(?<![\w$])\$[A-Z][A-Z_]+\$(?!\w)", r"(?<![\w%])%[A-Z][A-Z_]+%(?![\w%])",
    r"#(?<![\w#]#)[A-Z][A-Z_]+#(?!\w)", r"@@[A-Z_]+@@", r"(?<!\w)__[A-Z][A-Z_]*__(?!\w)", r"\[\[\s*[\w ]+?\s*\]\]", r"\[(?:your|insert|enter|add)\s[^\]\n]{1,60}\]", r"\[[A-Z][A-Z _]*\sHERE\]",
    r"<(?:insert|your|enter|add)[ \-][^>\n]{1,60}>", r"\[object Object\]", r"(?<![\w{$])\{[a-z]+(?:[_ ][a-z]+)*\}(?!\})", r"(?<!\w)X{4,}(?!\w)", r"(?:Dear|Hello|Hi|Hallo|Bonjour) (?:null|None|NaN|undefined)(?=\s*,)",
    r"(?<![\w'-])(?<!word )(?<!value )(?<!literal )(?<!string )(?<!variable )(?<!is )(?<!are )(?<!an )(?<!term )(?<!palabra )(?<!mot )(?<!Wort )(?<!palavra )undefined(?![\w'-])",
]

SLOT = [re.compile(p, re.A) for p in SLOTS]
#: a text a slot matches in holds one of these, so most slots are never looked for
SLOT_MARKS = [*(("{{",), ("{%",), ("<%",), ("${",), ("$",), ("%",), ("#",), ("@@",), ("__",), ("[[",), ("[",), ("HERE]",), ("<",), ("[object Object]",), ("{",), ("XXXX",)), ("null", "None", "NaN", "undefined"), ("undefined",)]
VERDICT = [re.compile(p, re.A) for p in RESIDUE.values()]
IS_NEUTRAL = re.compile(NEUTRAL, re.A | re.I)
FENCE = re.compile(r"^[ \t]*(?:```|~~~)(.*)$")
QUOTED = {"\"": re.compile(r"\"[^\"\n]*\""), "“": re.compile(r"“[^“”\n]*”"), "„": re.compile(r"„[^„“”\n]*[“”]"), "«": re.compile(r"«[^«»\n]*»")}
BLANKS = re.compile("[ \\t\u00a0]{2,}|[\\t\u00a0]")
LEAD = re.compile(r"^[\s>*\u2022\-]+", re.A)
NO_SENTENCE = re.compile(r"#|$|\W+$", re.A)
VARIABLE = re.compile(r"[\d_/@#$%{}\[\]<>]")
STATUS = re.compile(r"^\W*[45]\d\d\W*$", re.A)


def _without(text: str, opening: str, closing: str, to_end: bool, instead: str) -> str:
    """The text without what stands between two marks; an unclosed one reaches to the end or is kept."""
    at = text.find(opening)
    if at < 0:
        return text
    out, done = [], 0
    while at >= 0:
        end = text.find(closing, at + len(opening))
        if end < 0 and not to_end:
            break
        out += [text[done:at], instead]
        done = end + len(closing) if end >= 0 else len(text)
        at = text.find(opening, done) if end >= 0 else -1
    return "".join(out) + text[done:]


def running_text(text: str) -> str:
    """A text without code blocks, inline code, comments and quotations, its line ends and blanks made equal."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        lines, kept, opened = text.split("\n"), [], -1
        for line in lines:
            mark = FENCE.match(line)
            if opened < 0:
                if mark:
                    opened = len(kept)
                kept.append(line)
            elif mark and not mark.group(1).strip():
                del kept[opened:]
                kept.append("")
                opened = -1
            else:
                kept.append(line)
        text = _without("\n".join(kept), "```", "```", True, "\n")
    if "`" in text:
        text = re.sub(r"``?[^`\n]*``?", " _ ", text)
    for mark, quoted in QUOTED.items():
        if mark in text:
            text = quoted.sub(" _ ", text)
    text = _without(text, "<!--", "-->", False, " ")
    return BLANKS.sub(" ", text)


def has_slot(plain: str) -> bool:
    """Whether a slot is unresolved in a running text or a heading."""
    return any(slot.search(plain) for slot, marks in zip(SLOT, SLOT_MARKS) if any(m in plain for m in marks))


def split_sentences(plain: str) -> list[str]:
    """The sentences of a running text, list marks and headings left out."""
    out = []
    for stop in ".!?":
        plain = plain.replace(f"{stop} ", f"{stop}\n")
    for part in plain.split("\n"):
        part = LEAD.sub("", part).strip()
        if part and not NO_SENTENCE.match(part):
            words = part.split(" ") if len(part) > 2 * LONGEST else ()
            out += [" ".join(words[k : k + LONGEST]) for k in range(0, len(words), LONGEST)] if len(words) > LONGEST else [part]
    return out


@lru_cache(200_000)
def _mask(word: str) -> str:
    """A word of a template: numbers, paths, marks and overlong words are wildcards, the status of an answer is not."""
    return "*" if len(word) > 64 or VARIABLE.search(word) and not STATUS.match(word) else word


@lru_cache(100_000)
def masked(sentence: str) -> str:
    return " ".join(map(_mask, sentence.lower().split()))


def path_of(words: list[str]) -> int:
    """The leaf of a sentence in the prefix tree."""
    return xxhash.xxh64_intdigest(f"{len(words)} {' '.join(words[:DEPTH])} {words[-1]}") - (1 << 63)


def is_residue(sentence: str) -> bool:
    return any(p.search(sentence) for p in VERDICT)


class Tree:
    """Leaves of templates: [words, members, (count, sentence) of the most frequent member, id]."""

    def __init__(self):
        self.leaves: dict[int, list[list]] = {}

    def add(self, leaf: int, words: list[str], n: int, best: tuple[int, str], ident: int) -> list:
        """The template a sentence, or a template of another tree, joins or founds."""
        held = self.leaves.setdefault(leaf, [])
        least, found = SIMILAR * len(words), None
        for t in held:
            same = sum(a == b for a, b in zip(t[0], words))
            if same >= least:
                least, found = same + 1, t
        if found is None:
            found = [words, n, best, ident]
            held.append(found)
            return found
        if found[0] != words:
            found[0] = [a if a == b else "*" for a, b in zip(found[0], words)]
        found[1] += n
        found[2] = max(found[2], best)
        return found


READ = "doc_id bigint, slot boolean, sentences array<struct<sid:bigint,words:string>>"
GROWN = "sid bigint, grown bigint, leaf bigint, words string, n bigint, best_n bigint, best string"


def read(documents: DataFrame) -> DataFrame:
    """A row per document: whether it has a slot, and its distinct masked sentences but neutral ones."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if text is None:
                    continue
                plain = running_text(text)
                words = {masked(s) for s in split_sentences(plain) if not IS_NEUTRAL.match(s)} - {""}
                rows.append((doc_id, has_slot(plain), [(xxhash.xxh64_intdigest(w) - (1 << 63), w) for w in sorted(words)]))
            yield pd.DataFrame(rows, columns=["doc_id", "slot", "sentences"])

    return spread(documents.select("doc_id", "text")).mapInPandas(look, READ)


def grow(counted: DataFrame) -> DataFrame:
    """Trees over the sentences (sid, words, n) of each partition: a row per sentence with the id of its template, and a row per template."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree()
        for batch in batches:
            grown = []
            for sid, text, n in zip(batch["sid"].tolist(), batch["words"], batch["n"].tolist()):
                words = text.split(" ")
                grown.append(tree.add(path_of(words), words, n, (n, text), sid)[3])
            yield pd.DataFrame({"sid": batch["sid"], "grown": grown, "leaf": None, "words": None, "n": None, "best_n": None, "best": None})
        rows = [(None, t[3], leaf, " ".join(t[0]), t[1], *t[2]) for leaf, ts in tree.leaves.items() for t in ts]
        for k in range(0, len(rows), 10_000):
            yield pd.DataFrame(rows[k : k + 10_000], columns=[c.split()[0] for c in GROWN.split(", ")])

    return counted.mapInPandas(look, GROWN)


def merge(templates: DataFrame) -> DataFrame:
    """(grown, template, residue): trees over the templates of all partitions, leaf by leaf, and the verdict on each."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, at, members = Tree(), None, []

        def judged() -> pd.DataFrame:
            verdicts = {t[3]: is_residue(t[2][1]) for ts in tree.leaves.values() for t in ts}
            return pd.DataFrame([(g, t[3], verdicts[t[3]]) for g, t in members], columns=["grown", "template", "residue"])

        for batch in batches:
            for grown, leaf, text, n, best_n, best in zip(batch["grown"].tolist(), batch["leaf"].tolist(), batch["words"], batch["n"].tolist(), batch["best_n"].tolist(), batch["best"]):
                if leaf != at and len(members) > 10_000:
                    yield judged()
                    tree, members = Tree(), []
                at = leaf
                members.append((grown, tree.add(leaf, text.split(" "), n, (best_n, best), grown)))
        if members:
            yield judged()

    by_leaf = templates.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "words", "grown")
    return by_leaf.mapInPandas(look, "grown bigint, template bigint, residue boolean")


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of documents to exclude; kind is `slot` or `no_text`."""
    docs = stored(read(documents), "sentences")
    parts = docs.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.sid", "s.words")
    counted = parts.groupBy("sid").agg(F.min("words").alias("words"), F.count(F.lit(1)).alias("n"))
    grown = stored(grow(counted), "trees")
    verdict = merge(grown.where("sid is null").drop("sid"))
    known = stored(grown.where("sid is not null").select("sid", "grown").join(verdict, "grown").select("sid", "template", "residue"), "templates")
    judged = stored(parts.select("doc_id", "sid").join(known, "sid").select("doc_id", "template", "residue"), "judged")
    whole = judged.groupBy("doc_id").agg(F.max("residue").alias("any_residue"))
    company = judged.where("not residue").select("doc_id", "template").distinct().join(whole, "doc_id").groupBy("template").agg(F.avg(F.col("any_residue").cast("double")).alias("company"))
    inherited = company.where(F.col("company") >= COMPANY).select("template", F.lit(True).alias("inherits"))
    final = judged.join(inherited, "template", "left").groupBy("doc_id").agg(F.max("residue").alias("any_residue"), F.max(~F.col("residue") & F.col("inherits").isNull()).alias("ordinary"))
    empty = final.where("any_residue and not ordinary").select("doc_id", F.lit("no_text").alias("kind"))
    slots = docs.where("slot").select("doc_id", F.lit("slot").alias("kind"))
    return slots.unionByName(empty).groupBy("doc_id").agg(F.min("kind").alias("kind"))
