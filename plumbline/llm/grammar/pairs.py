"""Grammars of the token sequences of each language, and the pairs of adjacent tokens that they permit.

A line is one alternative of a rule: its name, then items.  ``<x>`` is a rule, anything else a token; ``?``
``*`` and ``+`` follow an item in angle brackets that may be absent, repeated, or both.  ``name = a b c`` makes every
token an alternative by itself.  The grammars are wider than the productions that follow (no precedence, patterns
are expressions): what they are for is which token can stand next to which.
"""

from __future__ import annotations

import re
from functools import lru_cache

from plumbline.llm.grammar import END, START, golang, pylang, script

PYTHON = """
file <statement>*
statement <line>
statement <compound>
line <simple> <next>* <semi>? NL
next ; <simple>
semi ;
block : NL I <statement>+ D
block : <line>
compound <decorator>* <head> <block> <clause>*
compound <decorator>* def <name> <typeparams>? P <params>? ) <arrow>? <block>
compound <decorator>* async def <name> <typeparams>? P <params>? ) <arrow>? <block>
compound <decorator>* class <name> <typeparams>? <args>? <block>
compound match <exprs> : NL I <case>+ D
head if <exprs>
head while <exprs>
head for <exprs> in <exprs>
head async for <exprs> in <exprs>
head with <items>
head async with <items>
head try
clause elif <exprs> <block>
clause else <block>
clause finally <block>
clause except <block>
clause except * <expr> <as>? <block>
clause except <expr> <as>? <block>
case case <exprs> <guard>? <block>
guard if <expr>
decorator @ <expr> NL
arrow -> <expr>
as as <expr>
items <expr> <as>? <moreitems>*
moreitems , <expr> <as>?
simple <exprs>
simple <exprs> : <expr>
simple <exprs> : <expr> = <exprs>
simple type <name> <typeparams>? = <expr>
simple return <exprs>?
simple raise <cause>?
simple pass
simple break
simple continue
simple del <exprs>
simple assert <exprs>
simple global <names>
simple nonlocal <names>
simple import <dotted> <alias>? <moreimports>*
simple from <from> import *
simple from <from> import P <imported> )
simple from <from> import <imported>
cause <expr> <fromexpr>?
fromexpr from <expr>
moreimports , <dotted> <alias>?
from <dots>* <dotted>?
dots = . ...
dotted <name> <dotname>*
dotname . <name>
alias as <name>
imported <name> <alias>? <moreimported>* <comma>?
moreimported , <name> <alias>?
names <name> <morenames>*
morenames , <name>
comma ,
name = NAME match case type _
exprs <starred> <moreexprs>* <comma>?
moreexprs <joint> <starred>
joint = , = += -= *= /= //= %= @= &= |= ^= **= >>= <<=
starred <star>? <expr>
star = * **
expr <prefix>* <operand> <suffix>* <tail>*
expr lambda <params>? : <expr>
expr yield <exprs>?
expr yield from <expr>
tail <binary> <prefix>* <operand> <suffix>*
tail if <expr> else <expr>
tail as <name>
tail <comprehension>
comprehension for <exprs> in <expr>
comprehension async for <exprs> in <expr>
comprehension if <expr>
binary = + - * / // % @ & | ^ << >> ** == != < > <= >= in is and or :=
binary not in
binary is not
prefix = + - ~ not await
operand <name>
operand = NUM IMG True False None ...
operand <string>+
operand P <exprs>? )
operand K <exprs>? ]
operand B <entries>? }
string = STR BYTES
string F <field>*
field f <exprs> <equals>? <conversion>? <spec>? }
equals =
conversion ! NAME
spec : <field>*
entries <entry> <moreentries>* <comma>?
moreentries , <entry>
entry <starred>
entry <starred> : <starred> <comprehension>*
suffix . <name>
suffix <args>
suffix K <slices> ]
args P <arguments>? )
arguments <argument> <morearguments>* <comma>?
morearguments , <argument>
argument <starred>
argument <name> = <expr>
slices <slice> <moreslices>* <comma>?
moreslices , <slice>
slice <starred>
slice <expr>? : <expr>? <step>?
step : <expr>?
params <param> <moreparams>* <comma>?
moreparams , <param>
param = * /
param <star>? <name> <annotation>? <default>?
annotation : <starred>
default = <expr>
typeparams K <typeparam> <moretypeparams>* <comma>? ]
moretypeparams , <typeparam>
typeparam <star>? <name> <annotation>? <typedefault>?
typedefault = <starred>
"""

GO = """
file package NAME <end>+ <top>*
file package NAME
top <import> <end>+
top <decl> <end>+
top <end>
top <import>
top <decl>
end = ; NL
import import <spec>
import import P <end>* <specs>? )
specs <spec> <morespecs>* <end>*
morespecs <end>+ <spec>
spec <label>? STR
label = NAME .
decl func <receiver>? NAME <typeparams>? <signature> <block>?
decl <word> <names>
decl <word> P <end>* <nameslist>? )
word = const var type
nameslist <names> <morenames>* <end>*
morenames <end>+ <names>
names NAME <othername>* <typeparams>? <assigned>? <type>? <value>?
othername , NAME
assigned =
value = <exprs>
receiver P <params>? )
typeparams K <params> ]
signature P <params>? ) <result>?
result P <params>? )
result <type>
params <param> <moreparams>* <comma>?
moreparams , <param>
comma ,
param <name>? <dots>? <type> <union>*
name NAME
dots ...
union | <type>
type <typeprefix>* <typebase>
typeprefix = * ~ <- chan
typeprefix chan <-
typeprefix K <expr>? ]
typeprefix K ... ]
typeprefix map K <type> ]
typebase NAME <qualified>? <typeargs>?
typebase P <type> )
typebase func <signature>
typebase struct B <fields>? }
typebase interface B <elements>? }
qualified . NAME
typeargs K <types> ]
types <type> <moretypes>* <comma>?
moretypes , <type>
fields <end>* <field> <morefields>* <end>*
morefields <end>+ <field>
field NAME <othername>* <type> <tag>?
field <type> <tag>?
tag STR
elements <end>* <element> <moreelements>* <end>*
moreelements <end>+ <element>
element NAME <signature>
element <type> <union>*
block B <end>* <statements>? }
statements <statement> <morestatements>* <end>*
morestatements <end>+ <statement>
statement <simple>
statement NAME : <statement>?
statement <block>
statement <decl>
statement go <expr>
statement defer <expr>
statement return <exprs>?
statement break <name>?
statement continue <name>?
statement goto NAME
statement fallthrough
statement if <init>? <simple> <block> <else>?
statement for <block>
statement for <simple> <block>
statement for <simple>? ; <simple>? ; <simple>? <block>
statement switch <init>? <simple>? B <end>* <clause>* }
statement select B <end>* <clause>* }
init <simple>? ;
else else <block>
else else if <init>? <simple> <block> <else>?
clause case <simple> : <end>* <statements>? <end>*
clause default : <end>* <statements>? <end>*
simple <exprs>
simple <exprs> <assign> <exprs>
simple <exprs> <step>
simple <exprs> <assign> range <expr>
simple range <expr>
assign = = := += -= *= /= %= &= |= ^= <<= >>= &^= <-
step = ++ --
exprs <expr> <moreexprs>*
moreexprs , <expr>
expr <prefix>* <operand> <suffix>* <tail>*
tail <binary> <prefix>* <operand> <suffix>*
binary = + - * / % & | ^ << >> &^ && || == < > != <= >=
prefix = + - ! ^ * & <-
operand = NAME NUM STR
operand P <expr> )
operand func <signature> <block>?
operand <type> <values>?
suffix . NAME
suffix . P <type> )
suffix . P type )
suffix K <index> ]
suffix P <args>? )
suffix <values>
index <expr> <moreindex>* <comma>?
index <expr>? : <expr>? <third>?
index <types>
third : <expr>
moreindex , <expr>
args <arg> <moreargs>* <dots>? <comma>?
moreargs , <arg>
arg <expr>
arg <type>
values B <entries>? }
entries <entry> <moreentries>* <comma>?
moreentries , <entry>
entry <element1> <keyed>?
keyed : <element1>
element1 <expr>
element1 <values>
"""

#: A line end stands where one can end a statement, whatever follows, so it belongs to no rule of its own.
SCRIPT = """
file <statement>* <open>?
statement <open> ;
statement ;
statement <block>
statement <name> : <statement>
statement if <paren> <statement> <else>?
statement while <paren> <statement>
statement with <paren> <statement>
statement for <await>? P <for> ) <statement>
statement do <statement> while <paren> <semi>?
statement try <block> <catch>? <finally>?
statement switch <paren> B <clause>* }
statement <function>
statement <class>
open import <imports> from STR <with>?
open import STR <with>?
open export * <as>? from STR <with>?
open export B <names>? } <fromstr>?
statement export default <statement>
statement export <statement>
semi ;
else else <statement>
await await
open <exprs>
open <declare> <exprs>
open return <exprs>?
open throw <exprs>
open break <name>?
open continue <name>?
open debugger
open if <paren> <open>
open if <paren> <open> else <open>
open if <paren> <open> else <statement>
open if <paren> <statement> else <open>
open while <paren> <open>
open for <await>? P <for> ) <open>
open do <open> while <paren>
open do <statement> while <paren>
open export <open>
open export default <open>
open <name> : <open>
declare = var let const
block B <statement>* <open>? }
catch catch <caught>? <block>
caught P <exprs> )
finally finally <block>
clause case <exprs> : <statement>* <open>?
clause default : <statement>* <open>?
paren P <exprs> )
for <forinit>? ; <exprs>? ; <exprs>?
for <forinit>
for <forinit> <of> <exprs>
of = of in
forinit <declare>? <exprs>
imports <name> <star>?
imports <star1>
star , <star1>
star1 * as <name>
star1 B <names>? }
as as <word>
with with B <members>? }
fromstr from STR <with>?
names <alias> <morealiases>* <comma>?
morealiases , <alias>
alias <word> <as>?
alias STR <as>?
comma ,
name <anyname>
word <name>
word <reserved>
exprs <comma>* <element> <more>* <comma>*
more <commas> <element>
commas , <comma>*
element <spread>? <expr>
spread ...
expr <prefix>* <operand> <suffix>* <tail>*
tail <binary> <prefix>* <operand> <suffix>*
tail ? <expr> : <expr>
tail <assign> <expr>
tail => <body>
body <expr>
body <block>
assign = = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=
binary = + - * / % ** < > <= >= == != === !== << >> >>> & | ^ && || ?? instanceof in
prefix = + - ! ~ ++ -- typeof void delete await yield new async
prefix yield *
operand <name>
operand = NUM STR REGEX # this super null true false yield
operand <template>
operand P <exprs>? )
operand K <exprs>? ]
operand B <members>? }
operand <class>
operand <function>
operand <element1>
operand new . NAME
operand import P <exprs> )
operand import . NAME
operand await
template T <hole>*
hole t <exprs> }
element1 J <part>* X
part x <exprs>? }
part y <exprs> }
part z ... <expr> }
suffix . NAME
suffix . #
suffix ?. NAME
suffix ?. #
suffix ?. P <exprs>? )
suffix ?. K <exprs> ]
suffix P <exprs>? )
suffix K <exprs> ]
suffix <template>
suffix ++
suffix --
function <async>? function <times>? <name>? P <exprs>? ) <block>
async async
times *
class class <name>? <extends>? B <classmember>* <lastmember>? }
extends extends <prefix>* <operand> <suffix>*
members <member> <moremembers>* <comma>*
moremembers , <member>
member ... <expr>
member <modifier>* <key> <value>?
value : <expr>
value = <expr>
value P <exprs>? ) <block>
key <word>
key = STR NUM #
key K <expr> ]
modifier = get set async * static accessor
classmember ;
classmember <lastmember> ;
classmember <modifier>* <key> P <exprs>? ) <block>
classmember static <block>
lastmember <modifier>* <key> <field>?
field = <expr>
"""

TYPES = """
type <typeprefix>* <atom> <typesuffix>* <typetail>*
typetail <join> <type>
join = | & => is extends
typetail ? <type> : <type>
typeprefix = keyof typeof readonly unique infer new abstract asserts | & -
typeprefix <typeparams>
atom <name>
atom = STR NUM void null this true false const
atom T <typehole>*
atom P <parameters>? )
atom K <types>? ]
atom B <signatures>? }
atom import P <exprs> )
typehole t <type> }
typesuffix . NAME
typesuffix . #
typesuffix <typeargs>
typesuffix K <type>? ]
typeargs < <types> <comma>? >
types <typeitem> <moretypes>* <comma>?
moretypes , <typeitem>
typeitem <spread>? <type> <optional>? <annotation>?
typeitem <word> <optional>? : <type>
optional ?
annotation : <type>
typeparams < <typeparam> <moretypeparams>* <comma>? >
moretypeparams , <typeparam>
typeparam <variance>* <name> <bound>? <typedefault>?
variance = const in out
bound extends <type>
typedefault = <type>
parameters <parameter> <moreparameters>* <comma>?
moreparameters , <parameter>
parameter <decorator>* <access>* <spread>? <type> <optional>? <annotation>? <default>?
default = <expr>
access = private protected public readonly override static declare abstract async export accessor
signatures <sep>* <signature> <moresignatures>* <sep>*
sep = ; ,
moresignatures <sep>+ <signature>
signature <sign>? <access>* <getset>? <key> <sign>? <optional>? <call>? <annotation>?
signature <new>? <call> <annotation>?
signature <sign>? <access>* K <name> <of> <type> <as1>? ] <sign>? <optional>? <annotation>?
signature <access>* K <name> : <type> ] <annotation>
sign = + -
as1 as <type>
getset = get set
new new
call <typeparams>? P <parameters>? )
decorator @ <operand> <suffix>*
statement <decorator>+ <class>
operand <decorator>+ <class>
classmember <decorator>+ <modifier>* <key> P <exprs>? ) <block>
suffix !
suffix <typeargs>
tail <cast> <type>
cast = as satisfies
tail <optional>? : <type> <default>?
tail <optional>
tail ! : <type>
prefix < <type> >
prefix <typeparams>
operand P <parameters>? )
operand P <exprs>? ) <annotation> => <body>
binary > >
binary > > >
binary > =
assign > =
assign > > =
assign > > > =
caught P <exprs> <annotation>? )
function <async>? function <times>? <name>? <typeparams>? P <parameters>? ) <annotation>? <block>
open <async>? function <times>? <name>? <typeparams>? P <parameters>? ) <annotation>?
class <access>* class <name>? <typeparams>? <extends>? <typeargs>? <implements>? B <classmember>* <lastmember>? }
implements implements <types>
extends extends <prefix>* <operand> <suffix>*
classmember <decorator>* <classmodifier>* <key> <mark>? <call> <annotation>? <block>
lastmember <decorator>* <classmodifier>* <key> <mark>? <annotation>? <default>?
lastmember <decorator>* <classmodifier>* <key> <mark>? <call> <annotation>?
lastmember <access>* K <name> : <type> ] <annotation>
classmodifier <access>
classmodifier <modifier>
mark = ? !
value <call> <annotation>? <block>
statement interface <name> <typeparams>? <extendstypes>? B <signatures>? }
extendstypes extends <types>
open type <name> <typeparams>? = <type>
statement <const>? enum <name> B <enumerators>? }
const const
enumerators <enumerator> <moreenumerators>* <comma>?
moreenumerators , <enumerator>
enumerator <key> <default>?
statement <namespace> <path> <block>
statement global <block>
namespace = namespace module
path <name> <dotname>*
path STR
dotname . NAME
open <namespace> <path>
statement declare <statement>
open declare <open>
open import <type1>? <name> = <exprs>
open export = <exprs>
open export as namespace <name>
open import type <imports> from STR <with>?
open export type B <names>? } <fromstr>?
open export type * <as>? from STR
type1 type
alias type <word> <as>?
alias type STR <as>?
for <declare>? <expr> <of> <exprs>
"""

_ITEM = re.compile(r"<(\w+)>([?*+]?)$")


def _read(*texts: str) -> dict[str, list[list[tuple[str, str]]]]:
    """Rules as lists of alternatives of (item, repetition)."""
    rules: dict[str, list[list[tuple[str, str]]]] = {}
    for line in "\n".join(texts).splitlines():
        if not line.strip():
            continue
        name, *items = line.split()
        alternatives = rules.setdefault(name, [])
        if items and items[0] == "=" and len(items) > 1 and not any(_ITEM.match(x) for x in items):
            alternatives += [[(x, "")] for x in items[1:]]
        else:
            alternatives.append([(m.group(0)[: m.end(1) + 1], m.group(2)) if (m := _ITEM.match(x)) else (x, "") for x in items])
    return rules


def _adjacent(rules: dict) -> set[tuple[str, str]]:
    """Pairs of tokens that the rules put next to each other, from the tokens that each rule can begin and end with."""
    empty: dict[str, bool] = {r: False for r in rules}
    first: dict[str, set[str]] = {r: set() for r in rules}
    last: dict[str, set[str]] = {r: set() for r in rules}

    def of(table: dict, item: str) -> set[str]:
        return table[item[1:-1]] if item[0] == "<" and len(item) > 2 and item[1:-1] in rules else {item}

    def skippable(item: str, repeated: str) -> bool:
        return repeated in ("?", "*") and repeated != "" or item[0] == "<" and len(item) > 2 and empty.get(item[1:-1], False)

    changed = True
    while changed:
        changed = False
        for r, alternatives in rules.items():
            for items in alternatives:
                for table, order in ((first, items), (last, items[::-1])):
                    for item, repeated in order:
                        new = of(table, item) - table[r]
                        if new:
                            table[r] |= new
                            changed = True
                        if not skippable(item, repeated):
                            break
                    else:
                        if not empty[r]:
                            empty[r] = changed = True
    pairs: set[tuple[str, str]] = set()
    for alternatives in [*rules.values(), [[(START, ""), ("<file>", ""), (END, "")]]]:
        for items in alternatives:
            for k, (item, repeated) in enumerate(items):
                if repeated in ("*", "+"):
                    pairs.update((a, b) for a in of(last, item) for b in of(first, item))
                for nxt, nxt_repeated in items[k + 1 :]:
                    pairs.update((a, b) for a in of(last, item) for b in of(first, nxt))
                    if not skippable(nxt, nxt_repeated):
                        break
    return pairs


@lru_cache
def permitted(lang: str) -> frozenset[tuple[str, str]]:
    """(class, class) that can be adjacent in a valid text, with the classes before and after the text."""
    if lang == "python":
        rules, symbols = _read(PYTHON), pylang.O
        classes = {"NAME": "n", "NUM": "0", "IMG": "j", "STR": "s", "BYTES": "b", "NL": "\n"}
    elif lang == "go":
        rules, symbols = _read(GO), golang.O
        classes = {"NAME": "n", "NUM": "0", "STR": "s", "NL": "\n"}
    else:
        rules = _read(SCRIPT, *([TYPES] if lang != "javascript" else []))
        symbols = script.O
        classes = {"NAME": "n", "NUM": "0", "STR": "s", "REGEX": "r"}
        rules["anyname"] = [[("NAME", "")], *([(w, "")] for w in script.CONTEXTUAL.split())]
        rules["reserved"] = [[(w, "")] for w in script.RESERVED.split()]
    pairs = {tuple(classes.get(x, symbols.get(x, x)) for x in pair) for pair in _adjacent(rules)}
    if lang not in ("python", "go"):
        first = {b for a, b in pairs}
        pairs |= {(a, "\n") for a in script._MAY_END} | {("\n", b) for b in script._STARTS & first}
    return frozenset(pairs)
