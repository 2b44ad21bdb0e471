"""Bundled grammars of scripts (plain and typed, each with element syntax) and a generator of LALR(1) tables.

The grammars speak of terminals as ``granary.scripts.lexer`` delivers them: contextual words, brackets and line ends are told
apart there.  ``ASI`` is the statement end that stands for a line end, a closing brace or the end of the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_COMMON = """
program : items ;
items : | items item ;
item : stmt | import | export ;
stmts : | stmts stmt ;
block : LB stmts } ;
semi : ; | ASI ;
stmt : block | VAR decls semi | ; | expr semi | func | class
 | IF ( expr ) stmt | IF ( expr ) stmt ELSE stmt
 | DO stmt WHILE ( expr ) | DO stmt WHILE ( expr ) ; | WHILE ( expr ) stmt
 | FOR ( forinit ; opt ; opt ) stmt | FOR ( VAR target OF expr ) stmt | FOR ( E OF expr ) stmt
 | FOR AWAIT ( VAR target OF expr ) stmt | FOR AWAIT ( E OF expr ) stmt
 | SWITCH ( expr ) LB cases }
 | TRY block CATCH block | TRY block CATCH ( catchtarget ) block | TRY block FINALLY block
 | TRY block CATCH block FINALLY block | TRY block CATCH ( catchtarget ) block FINALLY block
 | RETURN semi | RETURN expr semi | THROW expr semi
 | BREAK semi | BREAK IDENT semi | CONTINUE semi | CONTINUE IDENT semi
 | IDENT : stmt | DEBUGGER semi ;
forinit : | VAR decls | expr ;
opt : | expr ;
cases : | cases CASE expr : stmts | cases DEFAULT : stmts ;
decls : decl | decls , decl ;
decl : target declannot init ;
init : | = asg ;
target : IDENT | obj | arr ;
func : FUNCTION star IDENT sig block | ASYNC FUNCTION star IDENT sig block ;
fexpr : FUNCTION star IDENT sig block | ASYNC FUNCTION star IDENT sig block | FUNCTION star sig block | ASYNC FUNCTION star sig block ;
star : | * ;
params : | plist | plist , ;
plist : param | plist , param ;
param : target annot init | ... target annot ;
class : CLASS IDENT tparams heritage classbody ;
cexpr : CLASS IDENT tparams heritage classbody | CLASS tparams heritage classbody ;
classbody : LB members } ;
members : | members member ;
member : ; | mods pname sig block | mods * pname sig block | mods pname fieldannot init semi | mods LB stmts } ;
mods : | mods MOD ;
pname : KEY | STR | LIT | [ asg ] ;
expr : asg | expr , asg ;
asg : E | E ? asg : asg | L = asg | L AOP asg | arrow | ASYNC arrow | YIELD | YIELD asg | YIELD * asg ;
arrow : AID => body | ALP params ) => body ;
body : asg | block ;
E : E ?? E | E || E | E && E | E BAR E | E ^ E | E & E | E EQ E | E < E | E > E | E REL E | E IN E | E SHIFT E
 | E + E | E - E | E * E | E MUL E | E ** E | U ;
U : P | UN U | TYPEOF U | VOID U | - U | + U | AWAIT U | INC U ;
P : L | L POST ;
L : prim | L . IDENT | L ?. IDENT | L ?. ( args ) | L ?. [ expr ] | L [ expr ] | L ( args ) | L tpl | NEW NM ( args ) | NEW NM ;
NM : prim | NM . IDENT | NM [ expr ] | NEW NM ( args ) ;
prim : IDENT | LIT | STR | tpl | ( expr ) | arr | obj | fexpr | cexpr | jsx ;
tpl : TPL | TPLH expr tplrest ;
tplrest : TPLT | TPLM expr tplrest ;
arr : [ elist ] ;
elist : | el | elist , | elist , el ;
el : asg | ... asg ;
args : | alist | alist , ;
alist : el | alist , el ;
obj : OB props } ;
props : | props1 | props1 , ;
props1 : prop | props1 , prop ;
prop : KEY | KEY KEQ asg | pname : asg | pname sig block | * pname sig block | mods1 pname sig block | mods1 * pname sig block | ... asg ;
mods1 : MOD | mods1 MOD ;
import : IMPORT STR semi | IMPORT clause FROM STR semi ;
clause : IDENT | ns | named | IDENT , ns | IDENT , named ;
ns : * AS IDENT ;
named : OB specs } ;
specs : | specs1 | specs1 , ;
specs1 : spec | specs1 , spec ;
spec : KEY | KEY AS IDENT | STR AS IDENT | KEY AS STR | MOD KEY | MOD KEY AS IDENT ;
export : EXPORT VAR decls semi | EXPORT func | EXPORT class | EXPORT DEFAULT dfunc | EXPORT DEFAULT dclass | EXPORT DEFAULT asg semi
 | EXPORT named semi | EXPORT named FROM STR semi | EXPORT * FROM STR semi | EXPORT ns FROM STR semi ;
dfunc : FUNCTION star IDENT sig block | ASYNC FUNCTION star IDENT sig block | FUNCTION star sig block | ASYNC FUNCTION star sig block ;
dclass : CLASS IDENT tparams heritage classbody | CLASS tparams heritage classbody ;
jsx : JLT JGT children JLTS JGT | JLT jn attrs JSLASH JGT | JLT jn attrs JGT children JLTS jn JGT ;
jn : JNAME | jn . JNAME | JNAME : JNAME ;
attrs : | attrs JNAME | attrs JNAME = jvalue | attrs JNAME : JNAME | attrs JNAME : JNAME = jvalue | attrs JB ... asg } ;
jvalue : STR | JB asg } | jsx ;
children : | children JTEXT | children jsx | children JB } | children JB expr } | children JB ... asg } ;
"""

_PLAIN = """
sig : ( params ) ;
annot : ;
declannot : ;
fieldannot : ;
tparams : ;
heritage : | EXTENDS L ;
catchtarget : target ;
"""

_TYPED = """
sig : tparams ( params ) | tparams ( params ) : T ;
annot : | : T | OPT | OPT : T ;
declannot : | : T | BANG : T ;
fieldannot : | : T | OPT | OPT : T | BANG : T ;
param : mods1 target annot init ;
tparams : | targs0 ;
targs0 : TLT tplist TGT | TLT tplist , TGT ;
tplist : tp | tplist , tp ;
tp : IDENT | IDENT EXTENDS T | IDENT = T | IDENT EXTENDS T = T ;
heritage : | EXTENDS L | EXTENDS L TLT Tl TGT | EXTENDS L impl | EXTENDS L TLT Tl TGT impl | impl ;
impl : IMPLEMENTS Tl ;
catchtarget : target | target : T ;
member : mods pname sig semi | mods pname OPT sig semi | mods pname OPT sig block | mods [ IDENT : T ] : T semi ;
arrow : ALP params ) : T => body | targs0 ALP params ) => body | targs0 ALP params ) : T => body ;
E : E AS T ;
U : TAS T TGT U ;
L : L BANG | L TLT Tl TGT ( args ) | L TLT Tl TGT tpl ;
NM : NM TLT Tl TGT ;
stmt : tdecl ;
tdecl : INTERFACE IDENT tparams iext LB tmembers } | TYPE IDENT tparams = T semi | enum | ABSTRACT class | DECLARE stmt
 | NAMESPACE nsname LB items } | DECLARE FUNCTION star IDENT sig semi | DECLARE NAMESPACE nsname semi ;
nsname : qn | STR ;
func : FUNCTION star IDENT sig semi | ASYNC FUNCTION star IDENT sig semi ;
enum : ENUM IDENT LB emembers } | VAR ENUM IDENT LB emembers } ;
emembers : | emembers1 | emembers1 , ;
emembers1 : emember | emembers1 , emember ;
emember : pname | pname = asg ;
iext : | EXTENDS Tl ;
export : EXPORT tdecl | EXPORT = expr semi | EXPORT TYPE named semi | EXPORT TYPE named FROM STR semi | EXPORT TYPE * FROM STR semi | EXPORT DEFAULT INTERFACE IDENT tparams iext LB tmembers }
 | EXPORT DEFAULT ABSTRACT dclass ;
import : IMPORT TYPE clause FROM STR semi | IMPORT IDENT = expr semi ;
tmembers : | tmembers tmember ;
tsep : ; | , | ASI ;
tmember : tsep0 | mods pname fieldannot tsep | mods pname sig tsep | mods pname OPT sig tsep | sig tsep | NEW sig tsep | mods [ IDENT : T ] : T tsep | mods [ IDENT IN T ] annot tsep ;
tsep0 : ; ;
Tl : T | Tl , T ;
T : TU | TU EXTENDS TU ? T : T | ALP params ) => T | targs0 ALP params ) => T | NEW ALP params ) => T | IDENT IS T ;
TU : TQ | BAR TQ | & TQ | TU BAR TQ | TU & TQ ;
TQ : TPO | KEYOF TQ ;
TPO : tprim | TPO [ ] | TPO [ T ] ;
tprim : qn | qn TLT Tl TGT | LIT | STR | - LIT | tpl | VOID | ( T ) | OB tmembers } | LB tmembers } | [ tuple ] | TYPEOF qn | TYPEOF qn TLT Tl TGT ;
qn : IDENT | qn . IDENT ;
tuple : | tuple1 | tuple1 , ;
tuple1 : tel | tuple1 , tel ;
tel : T | T OPT | ... T | T : T | T OPT : T | ... T : T ;
"""

#: loosest first
_PRECEDENCE = [("right", "?"), ("left", "??"), ("left", "||"), ("left", "&&"), ("left", "BAR"), ("left", "^"), ("left", "&"), ("left", "EQ"), ("left", "< > REL IN AS"), ("left", "SHIFT"), ("left", "+ -"), ("left", "* MUL"), ("right", "**")]


@dataclass(frozen=True)
class Tables:
    """``action[state, terminal]``: 0 error, n > 0 go to state n - 1, n < 0 reduce rule -n, ``accept`` at the end."""

    terminals: dict[str, int]
    action: np.ndarray
    goto: np.ndarray
    rule_length: np.ndarray
    rule_left: np.ndarray
    conflicts: tuple[str, ...]

    ACCEPT = -32768


def rules(text: str) -> list[tuple[str, tuple[str, ...]]]:
    """Rules of a grammar in text form: ``;`` at a line's end ends a rule, ``|`` parts alternatives (the mark itself is BAR)."""
    out: list[tuple[str, tuple[str, ...]]] = []
    statement: list[str] = []
    for line in text.strip().split("\n"):
        statement.append(line.strip())
        if line.endswith(" ;"):
            whole = " ".join(statement)[:-2]
            left, _, right = whole.partition(" : ")
            if not _:
                left, right = whole.removesuffix(" :"), ""
            out += [(left.strip(), tuple(part.split())) for part in f" {right.strip()} ".split(" | ")]
            statement = []
    return out


def build(text: str, start: str = "program") -> Tables:
    """LALR(1) tables by the relations of DeRemer and Pennello; conflicts go to precedence, else to shifting, else to the earlier rule."""
    grammar = [("<start>", (start,)), *rules(text)]
    lefts = {left for left, _ in grammar}
    symbols = {s for _, right in grammar for s in right}
    terminals = {t: i for i, t in enumerate(["EOF", "ERR", *sorted(symbols - lefts)])}
    nonterminals = {n: i for i, n in enumerate(sorted(lefts))}
    by_left: dict[str, list[int]] = {}
    for i, (left, _) in enumerate(grammar):
        by_left.setdefault(left, []).append(i)
    nullable: set[str] = set()
    while True:
        more = {left for left, right in grammar if left not in nullable and all(s in nullable for s in right)}
        if not more:
            break
        nullable |= more

    def closure(kernel: frozenset) -> list[tuple[int, int]]:
        items, seen, todo = list(kernel), set(), list(kernel)
        while todo:
            rule, dot = todo.pop()
            right = grammar[rule][1]
            if dot < len(right) and right[dot] in by_left and right[dot] not in seen:
                seen.add(right[dot])
                new = [(r, 0) for r in by_left[right[dot]]]
                items += new
                todo += new
        return items

    first = frozenset({(0, 0)})
    numbers, kernels, moves = {first: 0}, [first], []
    for kernel in kernels:
        step: dict[str, set] = {}
        for rule, dot in closure(kernel):
            right = grammar[rule][1]
            if dot < len(right):
                step.setdefault(right[dot], set()).add((rule, dot + 1))
        out = {}
        for symbol, items in step.items():
            target = frozenset(items)
            if target not in numbers:
                numbers[target] = len(kernels)
                kernels.append(target)
            out[symbol] = numbers[target]
        moves.append(out)

    edges = [(p, a) for p, out in enumerate(moves) for a in out if a in nonterminals]
    at = {e: i for i, e in enumerate(edges)}
    follow = [0] * len(edges)
    reads: list[list[int]] = [[] for _ in edges]
    for i, (p, a) in enumerate(edges):
        r = moves[p][a]
        for s in moves[r]:
            if s in terminals:
                follow[i] |= 1 << terminals[s]
            elif s in nullable:
                reads[i].append(at[r, s])
        if p == 0 and a == start:
            follow[i] |= 1 << terminals["EOF"]
    _spread(follow, reads)
    includes: list[list[int]] = [[] for _ in edges]
    lookback: dict[tuple[int, int], list[int]] = {}
    for i, (p, a) in enumerate(edges):
        for rule in by_left[a]:
            right, state = grammar[rule][1], p
            for k, s in enumerate(right):
                if s in nonterminals and all(x in nullable for x in right[k + 1 :]):
                    includes[at[state, s]].append(i)
                state = moves[state][s]
            lookback.setdefault((state, rule), []).append(i)
    _spread(follow, includes)

    level = {t: (n, side) for n, (side, group) in enumerate(_PRECEDENCE) for t in group.split()}
    action = np.zeros((len(kernels), len(terminals)), np.int16)
    goto = np.zeros((len(kernels), len(nonterminals)), np.int16)
    conflicts = []
    for p, out in enumerate(moves):
        for s, q in out.items():
            if s in terminals:
                action[p, terminals[s]] = q + 1
            else:
                goto[p, nonterminals[s]] = q
    action[moves[0][start], terminals["EOF"]] = Tables.ACCEPT
    names = list(terminals)
    for (p, rule), backs in sorted(lookback.items()):
        ahead = 0
        for b in backs:
            ahead |= follow[b]
        mine = next((level[s] for s in reversed(grammar[rule][1]) if s in level), None)
        for t, name in enumerate(names):
            if not ahead >> t & 1:
                continue
            old = int(action[p, t])
            if old == 0:
                action[p, t] = -rule
            elif old > 0:
                theirs = level.get(name)
                if mine and theirs and len(grammar[rule][1]) == 3:
                    if mine[0] > theirs[0] or mine[0] == theirs[0] and mine[1] == "left":
                        action[p, t] = -rule
                else:
                    conflicts.append(f"shift {name} or reduce {grammar[rule]}")
            elif old != -rule:
                conflicts.append(f"{name}: reduce {grammar[-old]} or {grammar[rule]}")
                action[p, t] = max(old, -rule)  # the earlier rule
    return Tables(terminals, action, goto, np.array([len(r) for _, r in grammar], np.int32), np.array([nonterminals[left] for left, _ in grammar], np.int32), tuple(conflicts))


def _spread(sets: list[int], relation: list[list[int]]) -> None:
    """Adds to every set those it is related to, until nothing changes."""
    changed = True
    while changed:
        changed = False
        for i in range(len(sets) - 1, -1, -1):
            new = sets[i]
            for j in relation[i]:
                new |= sets[j]
            if new != sets[i]:
                sets[i], changed = new, True


@cache
def tables(typed: bool) -> Tables:
    """Tables of the plain or the typed grammar; element syntax comes only with its own terminals."""
    return build(_COMMON + (_TYPED if typed else _PLAIN))
