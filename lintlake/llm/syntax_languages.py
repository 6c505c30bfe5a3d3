"""Grammars of the languages over token classes of `syntax_lex`, and their permissible pairs.

Classes: ID identifiers and constants, CK words that are keywords only in places, MOD modifiers, keywords by their own
name; AS assignments, BI binary operators, PM plus and minus, UN prefix operators, INC, AR arrows; brackets LP RP LB RB
and braces by what they hold: LCB block, LCO object or literal, LCC class body. RPH closes the head of a control
statement, RCT the block of a `try`, RCD that of a `do`. Colons: OC in an object, TC of a conditional, CC after a case,
LAB after a label, AC before a type. A class with `^` stands after a line break. NL is a line end that counts.
"""

from __future__ import annotations

from functools import lru_cache

from lintlake.llm.syntax_grammar import Grammar

_EXPRESSION = """
name = ID | CK
operand = name | NUM | STR | TPL | RE | LP args? RP | LB args? RB | LCO members? RCO | fnx | classx | arrow | new operand | new DOT name | SUPER | import LP args? RP | import DOT name
args = CM* arg (CM+ arg)* CM*
arg = EL? expr
postfix = DOT (name | KWN | HASHID) | LP args? RP | LB expr RB | TPL | DOT LP args? RP | DOT LB expr RB | INC | BANG
unary = (PM | UN | INC | typeof | void | delete | CK)+
simple = unary? operand postfix*
binary = BI | PM | LT | GT | GT GT | GT GT GT | instanceof | in | AS | CK
expr = simple (binary simple)* (QM expr TC expr)? | expr CM expr | yield STAR? expr? | HASHID in expr
arrow = CK? (name | LP params? RP) AR (expr | block)
params = param (CM param)* CM?
param = EL? (name | LB pattern RB | LCO members? RCO) (AS expr)?
pattern = CM* (element (CM+ element)*)? CM*
element = EL? (name | LB pattern RB | LCO members? RCO) (AS expr)?
members = CM* member (CM member)* CM*
member = EL expr | (CK | STAR)* key OC expr | name (AS expr)? | (CK | STAR)* key LP params? RP block | key CK name
key = name | STR | NUM | LB expr RB | KWN
block = LCB stmt* last? RCB
last = plain
fnx = CK? function STAR? (name | FID)? LP params? RP block
classx = class (name | CID)? (extends simple)? LCC body RCC
body = field* bare?
field = SM | (CK | STAR)* (key | HASHID) (AS expr)? SM | (CK | STAR)* (key | HASHID) LP params? RP block | CK LCB stmt* last? RCB
bare = (CK | STAR)* (key | HASHID) (AS expr)?
"""
_STATEMENT = """
program = BOF stmt* last? EOF
plain = expr | return expr? | throw expr | break name? | continue name? | vars | debugger
      | import STR | import (clause from) STR (CK LCO members? RCO)? | export CK? star | export import name AS expr | export LCO members? RCO (from STR)? | export default expr | export vars | do stmt while LP expr RPH
clause = name (CM (LCO members? RCI | STAR CK name))? | LCO members? RCI | STAR CK name | CK clause
star = STAR (CK (name | default))? from STR
vars = (var | let | const) binding (CM binding)* | const KID AS expr (CM binding)*
binding = (name | LB pattern RB | LCO members? RCO) (AS expr)?
stmt = SM | plain SM | block | if LP expr RPH stmt (else stmt)? | for CK? LP forhead RPH stmt | while LP expr RPH stmt | do LCB stmt* last? RCD while LP expr RPH
     | try LCB stmt* last? RCT (catch (LP param RPH)? block)? finally block | try LCB stmt* last? RCT catch (LP param RPH)? block
     | switch LP expr RPH LCB cases* RCB | name LAB stmt | fnx | classx | export (default)? (fnx | classx) | decorator stmt
cases = (case expr | default) CC stmt* last?
forhead = (vars | expr)? SM expr? SM expr? | (var | let | const)? (name | LB pattern RB | LCO members? RCO) (CK | in) expr
decorator = AT name (DOT name)* LP args? RP
"""
JAVASCRIPT = _EXPRESSION + _STATEMENT
TYPESCRIPT = (
    JAVASCRIPT
    + """
type = BI? (CK | MOD | typeof | new | UN | PM)* atom (LB type? RB)* ((BI | DOT | extends | CK | is) type)* (QM type TC type)?
atom = name | STR | NUM | TPL | void | null | LCO members? RCO | LCC body RCC | LB types? RB | LP params? RP AR type | LP type RP | name LT types GT | LT types GT LP params? RP AR type | import LP STR RP | typeof simple
types = (const | in | CK)* EL? (name (QM? AC))? type QM? (AS type)? (CM types)* CM?
param = (CK | MOD | decorator)* EL? (name | LB pattern RB | LCO members? RCO) QM? (AC type)? (AS expr)?
arrow = CK? (LT types GT)? LP params? RP AC type AR (expr | block)
binding = (name | KID | LB pattern RB | LCO members? RCO) BANG? AC type (AS expr)?
fnx = CK* function STAR? (name | FID)? (LT types GT)? LP params? RP (AC type)? (block | SM)
operand = LT type GT operand
postfix = LT types GT | BANG | CK type | CK const
field = (CK | MOD | STAR | decorator | PM)* (key | HASHID) (QM | BANG)? (AC type)? (AS expr)? (SM | CM) | (CK | MOD | STAR | decorator)* (key | HASHID)? QM? (LT types GT)? LP params? RP (AC type)? (block | SM | CM)
      | (CK | MOD | PM)* LB name (AC type | in type | CK type) RB (QM | PM)* AC type (SM | CM) | new LP params? RP AC type SM
body = enumber (CM enumber)* CM?
bare = (CK | MOD | STAR)* (key | HASHID) (QM | BANG)? (AC type)? (AS expr)? | (CK | MOD)* LB name (AC | in) type RB (QM | PM)* AC type | (CK | MOD)* (key)? QM? (LT types GT)? LP params? RP (AC type)?
enumber = (key) (AS expr)?
members = CM* member (CM member)* CM*
member = (MOD | CK | PM)* key QM? OC type | (CK | STAR)* key QM? (LT types GT)? LP params? RP (AC type)? block | (MOD | CK)* key QM? (LT types GT)? LP params? RP OC type | new? (LT types GT)? LP params? RP OC type
      | (MOD | PM)* LB name (AC | in | CK) type (CK type)? RB (QM | PM)* OC type
members = member ((SM | CM) member)* (SM | CM)?
heritage = (LT types GT)? (extends simple (LT types GT)? (CM type)*)? (CK type (CM type)*)?
classx = CK* class (name | CID)? heritage LCC body RCC
stmt = (CK | const)* CK (name | CID) heritage LCC body RCC | CK CK (name | STR) (DOT name)* block | export? CK* (CK name (LT types GT)? AS type) SM | export (CK | const)+ (name | CID) heritage LCC body RCC
     | export CK+ (name | STR) block | (export | CK)+ classx | CK* fnx | export CK* vars SM | CK vars SM | export AS expr SM | import name AS expr SM | (CK) block
plain = export? CK* CK name (LT types GT)? AS type | export CK* vars | CK vars
catchx = catch LP name AC type RPH block
"""
)
JAVA = """
program = BOF unit EOF
unit = (annotation* package qname SM)? (import CK? MOD? qname (DOT STAR)? SM | SM)* typedecl*
qname = name (DOT name)*
name = ID | CK
annotation = AT qname (LP anargs? RP)?
anargs = anvalue (CM anvalue)*
anvalue = (name AS)? (expr | LCO anitems? RCO | annotation)
anitems = (expr | annotation) (CM (expr | annotation))* CM?
mods = (MOD | CK | annotation)*
typedecl = mods (class | interface | CK | AT interface) name typeparams? (LP params? RP)? (extends types)? (implements types)? (CK types)? LCC member* RCC | SM | mods enum name (implements types)? LCE enumbody? (SM member*)? RCE
typeparams = LT tparam (CM tparam)* GT
tparam = annotation* name (extends type (BI type)*)?
types = type (CM type)*
type = annotation* name typeargs? (DOT name typeargs?)* (LB RB)*
typeargs = LT (targ (CM targ)*)? GT
targ = type | QM ((extends | SUPER) type)?
params = param (CM param)*
param = (MOD | annotation | CK)* type EL? name (LB RB)*
member = SM | typedecl | mods typeparams? type name LP params? RP (LB RB)* (throws types)? (block | SM | default expr SM) | mods typeparams? name LP params? RP (throws types)? block
       | mods name block | mods type vars SM | MOD? block
enumbody = annotation* name (LP args? RP)? (LCC member* RCC)? (CM annotation* name (LP args? RP)? (LCC member* RCC)?)* CM?
vars = var (CM var)*
var = name (LB RB)* (AS (expr | LCO items? RCO))?
items = item (CM item)* CM?
item = expr | LCO items? RCO
block = LCB stmt* RCB
stmt = SM | block | mods type vars SM | typedecl | expr SM | if LP expr RPH stmt (else stmt)? | for LP forhead RPH stmt | while LP expr RPH stmt | do stmt while LP expr RPH SM
     | do LCB stmt* RCD while LP expr RPH SM | try LP resources RPH LCB stmt* RCT (catch LP catchp RPH block)* (finally block)? | try LP resources RPH LCB stmt* RCT stmt
     | try LCB stmt* RCT (catch LP catchp RPH block | finally block) | catch LP catchp RPH block | finally block
     | switch LP expr RPH LCB cases* RCB | return expr? SM | throw expr SM | break name? SM | continue name? SM | synchronized LP expr RPH block | name LAB stmt | assert expr (TC expr)? SM | CK expr SM
cases = (case pats | default) (CC stmt* | AR (expr SM | block | throw expr SM))
pats = pat (CM pat)* (CK expr)?
pat = expr | type name | default | type LP params? RP
resources = resource (SM resource)* SM?
resource = mods type name AS expr | expr
catchp = (MOD | annotation)* type (BI type)* name
forhead = (mods type vars | exprs)? SM expr? SM exprs? | mods type name TC expr
exprs = expr (CM expr)*
args = expr (CM expr)*
operand = name | NUM | STR | LP expr RP | LP type (BI type)* RP operand | new creator | lambda | switch LP expr RPH LCB cases* RCB | type DOT class | DOT? SUPER
creator = annotation* name typeargs? (DOT name typeargs?)* (LP args? RP (LCC member* RCC)? | (LB expr? RB)+ (LCO items? RCO)?)
lambda = (name | LP lparams? RP) AR (expr | block)
lparams = name (CM name)* | params
postfix = DOT typeargs? (name | new creator | KWN) | LP args? RP | LB expr RB | INC | DCOL (name | new) | LB RB
simple = (PM | UN | INC)* operand postfix*
expr = simple ((BI | PM | LT | GT | GT GT | GT GT GT | AS) simple | instanceof MOD? type name? (LP params? RP)?)* (QM expr TC expr)?
"""
GO = """
program = BOF package PKG SM import_* top* EOF
import_ = import (IMP? STR | LP (imp? STR SM)* RP) SM
imp = name | DOT
name = ID
top = (func FID typeparams? sig block? | func LP params? RP FID sig block? | decl | LCB) SM
decl = var (vspec | LP (vspec SM)* RP) | const (vspec | LP (vspec SM)* RP) | type (tspec | LP (tspec SM)* RP)
vspec = names gtype? (AS exprs)?
names = name (CM name)*
tspec = (name | TID) typeparams? AS? gtype
typeparams = LB params RB
sig = LP params? RP (gtype | LP params? RP)?
params = param (CM param)* CM?
param = names? EL? gtype | gtype | EL gtype
gtype = name (DOT name)? (LB types RB)? | STAR gtype | LB (expr | EL)? RB gtype | map LB gtype RB gtype | chan gtype | ARROW chan gtype | chan ARROW gtype | func sig | struct LCC (fieldx SM)* fieldx? RCC | interface LCC (method SM)* method? RCC | LP gtype RP | CK gtype
types = gtype (CM gtype)*
fieldx = (names gtype | STAR? name (DOT name)?) STR?
method = name sig | UN? gtype (BI UN? gtype)*
block = LCB (stmt SM)* stmt? RCB
stmt = decl | exprs | exprs AS exprs | exprs INC | exprs ARROW expr | go expr | defer expr | return exprs? | break name? | continue name? | goto name | fallthrough | block | if_ | for forhead? block
     | switch (simplestmt? SM)? (simplestmt)? LCB cases* RCB | select LCB cases* RCB | name LAB stmt? | LAB
simplestmt = exprs | exprs AS exprs | exprs INC | exprs ARROW expr
if_ = if (simplestmt SM)? simplestmt block (else (if_ | block))?
forhead = simplestmt | simplestmt? SM expr? SM simplestmt? | exprs AS range expr | range expr
cases = (case (exprs | simplestmt | types) | default) CC (stmt SM)* stmt?
exprs = expr (CM expr)* 
operand = name | NUM | STR | LP expr RP | LP gtype RP | func sig block | literal | map LB gtype RB gtype | chan gtype | struct LCC (fieldx SM)* RCC | interface LCC RCC | LB (expr | EL)? RB gtype
literal = ltype LCO elements? RCO
ltype = name (DOT name)? (LB types RB)? | LB (expr | EL)? RB gtype | map LB gtype RB gtype | struct LCC (fieldx SM)* fieldx? RCC
elements = element (CM element)* CM?
element = (value OC)? value
value = expr | LCO elements? RCO
postfix = DOT (name | LP (gtype | type) RP) | LP (callarg (CM callarg)* EL? CM?)? RP | LB expr? (TC expr?)* RB
callarg = expr | gtype
simple = (PM | UN | STAR | BI | ARROW)* operand postfix*
expr = simple ((BI | PM | STAR | LT | GT | GT GT) simple)*
"""
PYTHON = """
program = BOF stmt* EOF
stmt = simple (SM simple)* SM? NL | compound
compound = (AT expr NL)* (async? def ID (LB params RB)? LP params? RP (AR expr)? | class ID (LB params RB)? (LP args? RP)?) suite | async? (if | elif | while) expr suite | else suite | try suite | finally suite
         | except STAR? exprs? (as ID)? suite | async? for targets in exprs suite | async? with items suite | match exprs suite | case exprs (if expr)? suite
suite = CO NL INDENT stmt+ DEDENT | CO simple (SM simple)* SM? NL
items = expr (as target)? (CM expr (as target)?)* CM? | LP expr (as target)? (CM expr (as target)?)* CM? RP
simple = exprs | (targets AS)+ exprs | target CO expr (AS exprs)? | return exprs? | raise (expr (from expr)?)? | pass | break | continue | del targets | assert expr (CM expr)? | global ID (CM ID)* | nonlocal ID (CM ID)*
       | import dotted (as ID)? (CM dotted (as ID)?)* | from (DOT | EL)* dotted? import (STAR | names | LP names CM? RP) | yieldx | type ID (LB params RB)? AS expr
dotted = ID (DOT ID)*
names = ID (as ID)? (CM ID (as ID)?)*
yieldx = yield from? exprs?
targets = STAR? target (CM STAR? target)* CM?
target = atom postfix* | STAR target
params = param (CM param)* CM?
param = (STAR | POW)? ID (CO STAR? expr)? (AS expr)? | STAR | SLASH
exprs = STAR? expr (CM STAR? expr)* CM?
args = arg (CM arg)* CM?
arg = expr (AS expr)? comp? | STAR expr | POW expr | ID AS expr
comp = (async? for targets in expr (if expr)*)+
expr = lambda params? CO expr | test (if test else expr)? | ID WALRUS expr
test = (not | UN | PM | await | STAR)* atom postfix* (op (not | UN | PM | await)* atom postfix*)*
op = BI | PM | STAR | POW | SLASH | AT | and | or | in | not in | is | is not
atom = ID | NUM | STR+ | EL | LP (exprs comp? | yieldx | arg | exprs)? RP | LB (exprs comp?)? RB | LC (entry (CM entry)* CM?)? RC | LC entry comp RC
entry = expr (CO expr)? | STAR expr | POW expr
postfix = DOT ID | LP args? RP | LB slices RB
slices = slice (CM slice)* CM?
slice = expr | expr? CO expr? (CO expr?)? | STAR expr
"""
JSON = """
program = BOF value EOF
value = STR | NUM | ID | LC (STR CO value (CM STR CO value)*)? RC | LB (value (CM value)*)? RB
"""
TOML = """
program = BOF NL* (line NL+)* line? EOF
line = LB key RB | LB LB key RB RB | key AS value
key = (ID | STR | NUM) (DOT (ID | STR | NUM))*
value = STR | NUM | ID | LB (NL* value NL* (CM NL* value NL*)* CM? NL*)? RB | LC (key AS value (CM key AS value)*)? RC
"""
HCL = """
program = BOF NL* (item NL+)* item? EOF
item = KEY AS expr | KEY LBL* LCB (NL+ (item NL+)* | KEY AS expr)? RCB
name = ID | CK
operand = ID | NUM | STR | LP NL* expr NL* RP | LB NL* (expr NL* (CM NL* expr NL*)* CM? NL*)? RB | LCO NL* (entry ((CM | NL)+ entry)* (CM | NL)*)? RCO | LB forx RB | LCO forx RCO
forx = NL* for ID (CM ID)? in expr OC NL* expr (AR NL* expr)? EL? NL* (if expr)? NL*
entry = key (AS | OC) expr
key = ID | STR | NUM | LP expr RP | ID (DOT ID)+
postfix = DOT (ID | NUM | STAR) | LB NL* (expr | STAR) NL* RB | LP NL* (expr NL* (CM NL* expr NL*)* EL? CM? NL*)? RP
simple = (PM | UN)* operand postfix*
expr = simple NL* ((BI | PM | STAR | LT | GT) NL* simple)* (NL* QM NL* expr NL* (OC | TC) NL* expr)?
"""
BASH = """
program = BOF sep* (list sep*)? EOF
sep = SM | NL | AMP
list = pipeline ((AND | OR) NL* pipeline | sep+ pipeline)* sep*
pipeline = (BANG | TIME)* command (PIPE NL* command)*
command = simple | compound REDIR* | FN NL* compound REDIR* | function WORD NL* compound REDIR* | function FN NL* compound REDIR*
simple = (ASG | REDIR)* WORD (WORD | REDIR | ASG | ARR)* | (ASG | REDIR | ARR)+
compound = LC sep* list RC | LP sep* list RP | if sep* list then sep* list (elif sep* list then sep* list)* (else sep* list)? fi | (while | until) sep* list do sep* list done
         | (for | select) WORD sep* (in (WORD)* sep+)? do sep* list done | for ARITH sep* do sep* list done | for WORD (in WORD* sep+)? LC sep* list RC | case WORD NL* in sep* clause* esac | TEST | ARITH
clause = PAT sep* list? (DSEMI sep*)?
"""
SQL = """
program = BOF SM* (items (SM+ items)*)? SM* EOF
items = list (CM list)*
list = part+ literal?
list = literal
part = ID | OP | DOT | group | literal (ID | OP | DOT | group)
group = LP items? RP
literal = STR | NUM
"""

CONTINUES = {"javascript": ("plain", "stmt"), "typescript": ("plain", "stmt")}


# The tokens of YAML are its logical lines: how a line is indented beside the one before (S the same, I more, D less), how
# it begins (key, item, item key, scalar, other), and whether it holds something (F) or leaves room for a block (E).
YAML_STEPS = {"S": "same", "I": "more", "D": "less"}
YAML_HEADS = {"K": "key", "N": "item", "M": "item key", "C": "scalar", "O": "other"}


def yaml_tokens(rows: list[tuple[int, int, str, str]]) -> list[str]:
    """The tokens of logical lines (seq, indent, head, shape)."""
    heads, out, before = {v: k for k, v in YAML_HEADS.items()}, ["BOF"], None
    for _, indent, head, shape in rows:
        step = "S" if before is None or indent == before else "I" if indent > before else "D"
        out.append(f"{step}{heads[head]}{'E' if shape == 'empty' else 'F'}")
        before = indent
    return out


def _yaml_pairs() -> frozenset[tuple[str, str]]:
    """A block may begin only behind a line that leaves room for it; a key doesn't follow an item or scalar of its own level."""
    tokens = [f"{step}{head}{full}" for step in YAML_STEPS for head in YAML_HEADS for full in "EF"]
    fits = lambda a, b: not (b[0] == "I" and a[2] == "F") and not (b[:2] == "SK" and a[1] in "NC")
    return frozenset({("BOF", t) for t in tokens} | {(a, b) for a in tokens for b in tokens if fits(a, b)})


@lru_cache(None)
def pairs(language: str) -> frozenset[tuple[str, str]]:
    """Permissible pairs of a language; after a line break where a statement may end by itself the second has `^`."""
    if language == "yaml":
        return _yaml_pairs()
    text = {"javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "java": JAVA, "go": GO, "python": PYTHON, "json": JSON, "toml": TOML, "terraform": HCL, "shell": BASH, "sql": SQL}[language]
    g = Grammar(text)
    out = set(g.pairs)
    if language in CONTINUES:
        out |= {(a, f"^{b}") for a, b in g.pairs}
        ends = g.last("members") | g.last("plain") | g.last("stmt") | g.last("field") | g.last("bare") | {"RCB", "RCC", "LCC", "BOF"}
        member_starts = g.first("members") if "members" in g.rules else frozenset()
        starts = member_starts | {"else", "while"} | g.first("stmt") | g.first("plain") | g.first("field") | {"RCB", "RCC", "EOF", "case", "default"}
        out |= {(a, f"^{b}") for a in ends for b in starts}
    return frozenset(out)
