"""Grammars and token streams of the supported dialects: Python, JavaScript, XML and delimited text.

Grammars only recognise, so binary operators are flat.  Names without rule are token classes.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
from functools import lru_cache

from tessel.llm.gll import EOF, Grammar

PYTHON = r"""
File = Stmt* EOF ;
Stmt = SimpleLine | If | While | For | Try | With | Decorated | Match ;
SimpleLine = Simple (';' Simple)* ';'? NEWLINE ;
Simple = Assignment | StarExprs | 'return' StarExprs? | Import | 'raise' (Expr ('from' Expr)?)? | 'pass' | 'break' | 'continue'
  | 'del' Target (',' Target)* ','? | YieldExpr | 'assert' Expr (',' Expr)? | ('global' | 'nonlocal') Name (',' Name)* ;
Assignment = (SET Targets '=')+ (YieldExpr | StarExprs) | SET 'type' Name TypeParams? '=' Expr | SETAUG OneTarget AUG (YieldExpr | StarExprs) | SETANN OneTarget ':' Expr ('=' (YieldExpr | StarExprs))? ;
Ref = NAME | 'match' | 'case' | 'type' | '_' ;
Name = NAME | NAMEEQ | 'match' | 'case' | 'type' | '_' ;
Targets = '*'? Target (',' '*'? Target)* ','? ;
Target = Name (@Trail@* @Last1@)? | Other @Trail@* @Last1@ | '(' Targets? ')' | '[' Targets? ']' ;
OneTarget = Name (@Trail@* @Last1@)? | Other @Trail@* @Last1@ | '(' OneTarget ')' ;
StarExprs = ('*' Arith | Expr) (',' ('*' Arith | Expr))* ','? ;
Expr = Disj ('if' Disj 'else' Expr)? | 'lambda' LParams? ':' Expr ;
Disj = 'not'* Unary (('+' | '-' | '*' | '/' | '//' | '%' | '@' | '<<' | '>>' | '&' | '^' | '|' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?) Unary | ('and' | 'or') 'not'* Unary)* ;
Arith = Unary (('+' | '-' | '*' | '/' | '//' | '%' | '@' | '<<' | '>>' | '&' | '^' | '|') Unary)* ;
Unary = ('+' | '-' | '~')* 'await'? (Ref | Other) @Trail@* ('**' Unary)? ;
Other = NUMBER | (STRING | FString)+ | 'None' | 'True' | 'False' | '...' | '(' (YieldExpr | @Items@ | @Named@ CompFor)? ')' | '[' (@Items@ | @Named@ CompFor)? ']'
  | '{' (@Items@ | @Named@ CompFor | @Pair@ (',' @Pair@)* ','? | Expr ':' Expr CompFor)? '}' ;
Items = @Items@ ;
Named = @Named@ ;
CompFor = ('async'? 'for' Targets 'in' Disj ('if' (Disj | 'lambda' LParams? ':' Expr | NAMEW ':=' Expr))*)+ ;
Args = @Named@ CompFor ','? | (@Plain@ (',' @Plain@)* (',' @Keyed@)* (',' @Last@)* | @Keyed@ (',' @Keyed@)* (',' @Last@)* | @Last@ (',' @Last@)*) ','? ;
Slices = @Slice@ (',' @Slice@)* ','? ;
YieldExpr = 'yield' ('from' Expr | StarExprs)? ;
Import = 'import' Dotted ('as' Name)? (',' Dotted ('as' Name)?)* | 'from' ('.' | '...')* Dotted 'import' Imported | 'from' ('.' | '...')+ 'import' Imported ;
Dotted = Name ('.' Name)* ;
Imported = '*' | '(' Name ('as' Name)? (',' Name ('as' Name)?)* ','? ')' | Name ('as' Name)? (',' Name ('as' Name)?)* ;
Block = SimpleLine | NEWLINE INDENT Stmt+ DEDENT ;
Else = 'else' ':' Block ;
If = 'if' Named ':' Block ('elif' Named ':' Block)* Else? ;
While = 'while' Named ':' Block Else? ;
For = 'async'? 'for' Targets 'in' StarExprs ':' Block Else? ;
Finally = 'finally' ':' Block ;
Try = 'try' ':' Block (('except' Expr ('as' Name)? ':' Block)* ('except' ':' Block) Else? Finally? | ('except' Expr ('as' Name)? ':' Block)+ Else? Finally? | ('except' '*' Expr ('as' Name)? ':' Block)+ Else? Finally? | Finally) ;
With = 'async'? 'with' (WithItem (',' WithItem)* | '(' WithItem (',' WithItem)* ','? ')') ':' Block ;
WithItem = Expr ('as' '*'? Target)? ;
Decorated = ('@' Named NEWLINE)* ('async'? Func | Class) ;
Func = 'def' Name TypeParams? '(' Params? ')' ('->' Expr)? ':' Block ;
Class = 'class' Name TypeParams? ('(' Args? ')')? ':' Block ;
Params = ((@PN@ | '/') (',' (@PN@ | '/'))* (',' (@PD@ | '/'))* (',' @PStar@)? (',' '**' @PN@)? | @PD@ (',' (@PD@ | '/'))* (',' @PStar@)? (',' '**' @PN@)? | @PStar@ (',' '**' @PN@)? | '**' @PN@) ','? ;
LParams = ((Name | '/') (',' (Name | '/'))* (',' (@LD@ | '/'))* (',' @LStar@)? (',' '**' Name)? | @LD@ (',' (@LD@ | '/'))* (',' @LStar@)? (',' '**' Name)? | @LStar@ (',' '**' Name)? | '**' Name) ','? ;
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam = Name (':' Expr)? ('=' Expr)? | '*' Name ('=' ('*' Arith | Expr))? | '**' Name ('=' Expr)? ;
Match = 'match' Items ':' NEWLINE INDENT ('case' Patterns ('if' Named)? ':' Block)+ DEDENT ;
Patterns = PItem (',' PItem)* ','? ;
PItem = '*' Name | Pattern ;
Pattern = Closed ('|' Closed)* ('as' Name)? ;
Closed = '-'? NUMBER (('+' | '-') NUMBER)? | (STRING | FString)+ | 'None' | 'True' | 'False' | Dotted ('(' (PArg (',' PArg)* ','?)? ')')? | '(' Patterns? ')' | '[' Patterns? ']' | '{' (MItem (',' MItem)* ','?)? '}' ;
PArg = Pattern | NAMEEQ '=' Pattern ;
MItem = '**' Name | ('-'? NUMBER (('+' | '-') NUMBER)? | STRING+ | 'None' | 'True' | 'False' | Dotted) ':' Pattern ;
FString = FSTRING_START (FSTRING_MIDDLE | Field)* FSTRING_END ;
Field = '{' (YieldExpr | StarExprs) '='? ('!' NAME)? (':' (FSTRING_MIDDLE | Field)*)? '}' ;
"""
#: parts that are written out where they occur, so that what begins alike is read once
PARTS = {
    "Trail": "('.' Name | '[' Slices ']' | '(' Args? ')')", "Last1": "('.' Name | '[' Slices ']')",
    "Named": "(Expr | NAMEW ':=' Expr)", "Items": "('*' Arith | @Named@) (',' ('*' Arith | @Named@))* ','?", "Pair": "('**' Arith | Expr ':' Expr)", "Plain": "('*' Expr | @Named@)", "Keyed": "(NAMEEQ '=' Expr | '*' Expr)",
    "Last": "(NAMEEQ '=' Expr | '**' Expr)", "Slice": "(Expr? ':' Expr? (':' Expr?)? | @Named@ | '*' Arith)", "PN": "Name (':' Expr)?", "PD": "Name (':' Expr)? '=' Expr", "LD": "Name '=' Expr", "LStar": "('*' Name (',' (Name | @LD@))* | '*' (',' (Name | @LD@))+)",
    "PStar": "('*' Name (':' ('*' Arith | Expr))? (',' (@PN@ | @PD@))* | '*' (',' (@PN@ | @PD@))+)",
}
while "@" in re.sub(r"'@=?'", "", PYTHON):
    PYTHON = re.sub(r"@(\w+)@", lambda m: PARTS[m[1]], PYTHON)
#: assignment operators of Python besides '='
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())


def _statements(r: str) -> str:
    """Statement rules; ``r`` is the suffix of those inside functions, which also have ``return``."""
    extra = "| 'return' Expr? Semi" if r else ""
    return f"""
Stmt{r} = Block{r} | Var Semi | Semi1 | !('{{' 'function' 'class') Expr Semi | 'if' '(' Expr ')' (Stmt{r} | Declared) ('else' (Stmt{r} | Declared))? | 'do' Stmt{r} 'while' '(' Expr ')' (';' | !(';'))
  | 'while' '(' Expr ')' Stmt{r} | For{r} | 'continue' Ident? Semi | 'break' Ident? Semi | 'with' '(' Expr ')' Stmt{r} | 'throw' Expr Semi | LABEL ':' Item{r}
  | 'switch' '(' Expr ')' '{{' (('case' Expr | 'default') ':' Item{r}*)* '}}'
  | 'try' Block{r} ('catch' ('(' Binding ')')? Block{r} ('finally' Block{r})? | 'finally' Block{r}) | 'debugger' Semi {extra} ;
Item{r} = Stmt{r} | Lexical Semi | Function | Class ;
Block{r} = '{{' Item{r}* '}}' ;
For{r} = 'for' 'await'? '(' (ForVar | Lexical | Expr)? ';' Expr? ';' Expr? ')' Stmt{r} | 'for' 'await'? '(' (('var' | 'let' | 'const') Binding | LHS) ('in' Expr | 'of' Assign) ')' Stmt{r} ;
"""


JAVASCRIPT = (
    r"""
Script = Item* EOF ;
Module = (Item | Import | Export)* EOF ;
"""
    + _statements("")
    + _statements("R")
    + r"""
Semi = ';' | BREAK ;
Semi1 = ';' ;
Var = 'var' VarItem (',' VarItem)* ;
ForVar = 'var' VarItem (',' VarItem)* ;
VarItem = SET? (Ident ('=' Assign)? | Pattern '=' Assign) ;
Lexical = 'let' VarItem (',' VarItem)* | 'const' SET? Binding '=' Assign (',' SET? Binding '=' Assign)* ;
Ident = IDENT | LABEL | 'async' | 'of' | 'get' | 'set' | 'static' | 'let' | 'await' | 'yield' | 'from' | 'as' ;
Word = Ident | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' ;
Binding = Ident | Pattern ;
Pattern = ('[' | 'P[') ','* (('...' Binding | SET? Binding ('=' Assign)?) (','+ ('...' Binding | SET? Binding ('=' Assign)?))* ','*)? ']' | ('{' | 'P{') (PatternProp (',' PatternProp)* ','?)? '}' ;
PatternProp = SET? Ident ('=' Assign)? | PropName ':' SET? Binding ('=' Assign)? | '...' Ident ;
Params = (SET? Binding ('=' Assign)? (',' SET? Binding ('=' Assign)?)* (',' '...' Binding | ',')? | '...' Binding)? ;
Body = '{' ItemR* '}' ;
Declared = 'function' Ident '(' Params ')' Body ;
Function = 'async'? 'function' '*'? Ident? '(' Params ')' Body ;
Class = 'class' Ident? ('extends' LHS)? '{' (';' | 'static'? Method | 'static'? FieldDef | 'static' BlockR)* '}' ;
FieldDef = SET? (PropName | PRIV) ('=' Assign)? Semi ;
Method = 'async'? '*'? (PropName | PRIV) '(' Params ')' Body | 'get' (PropName | PRIV) '(' ')' Body | 'set' (PropName | PRIV) '(' SET? Binding ('=' Assign)? ','? ')' Body ;
PropName = Word | STR | NUM | ('[' | 'P[') Assign ']' ;
Expr = Assign (',' Assign)* ;
Assign = Cond | 'yield' '*'? Assign | 'yield' | 'async'? (ARROWID | 'ARROW(' Params ')') '=>' (!('{') Assign | Body) | SET AssignTarget ('=' | ASSIGNOP) Assign ;
AssignTarget = SimpleTarget | 'P[' @Elems@ ']' | 'P{' @Props@ '}' ;
SimpleTarget = Ident | '(' AssignTarget ')' | Primary Suffix* ('.' (Word | PRIV) | ('[' | 'P[') Expr ']') | 'super' ('.' Word | ('[' | 'P[') Expr ']') (Suffix* ('.' (Word | PRIV) | ('[' | 'P[') Expr ']'))? ;
InnerTarget = SimpleTarget | ('[' | 'P[') @Elems@ ']' | ('{' | 'P{') @Props@ '}' ;
Cond = @Bits@ ((('||' | '&&') @Bits@)* | ('??' @Bits@)*) ('?' Assign ':' Assign)? ;
Unary = ('delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await')+ @Update@ | @Update@ ('**' Unary)? ;
LHS = (Primary | 'super' (Args | '.' Word | '[' Expr ']') | 'import' '(' Assign ')' | 'import' '.' IDENT | New) Suffix* ;
New = 'new' (Primary ('.' (Word | PRIV) | '[' Expr ']' | Template)* | New | '.' IDENT | 'super' '.' Word) Args? ;
Suffix = '.' (Word | PRIV) | '?.' (Word | PRIV | '[' Expr ']' | Args) | ('[' | 'P[') Expr ']' | Args | Template ;
Args = '(' ('...'? Assign (',' '...'? Assign)* ','?)? ')' ;
Template = TFULL | THEAD Expr (TMID Expr)* TTAIL ;
Primary = 'this' | Ident | STR | NUM | REGEX | 'null' | 'true' | 'false' | '[' ','* ('...'? Assign (','+ '...'? Assign)* ','*)? ']' | '{' (Prop (',' Prop)* ','?)? '}' | Function | Class | Template | '(' Expr ')' ;
Prop = PropName ':' Assign | Ident | '...' Assign | Method ;
Import = 'import' (STR | ImportClause 'from' STR) Semi ;
ImportClause = Ident (',' (Star | Named))? | Star | Named ;
Star = '*' 'as' Ident ;
Named = '{' (Spec (',' Spec)* ','?)? '}' ;
Spec = (Word | STR) ('as' (Word | STR))? ;
Export = 'export' ('*' ('as' (Word | STR))? 'from' STR Semi | Named ('from' STR)? Semi | Var Semi | Lexical Semi | Function | Class | 'default' (Function | Class | !('function' 'class') Assign Semi)) ;
"""
)
ELEM = "'...'? SET? InnerTarget ('=' Assign)?"
PROP = "(SET? Ident ('=' Assign)? | PropName ':' SET? InnerTarget ('=' Assign)? | '...' InnerTarget)"
BITS = "Unary (BINOP Unary | '*' Unary | 'in' Unary | 'instanceof' Unary | '+' Unary | '-' Unary)*"
JAVASCRIPT = JAVASCRIPT.replace("@Bits@", BITS).replace("@Update@", "('++' | '--')* (LHS ('++' | '--')? | PRIV)").replace("@Elems@", f"','* ({ELEM} (','+ {ELEM})* ','*)?").replace("@Props@", f"({PROP} (',' {PROP})* ','?)?")

XML = r"""
Document = DECL? Misc* (DOCTYPE Misc*)? Element Misc* EOF ;
Misc = COMMENT | PI | SPACE ;
Element = EMPTY | OPEN (Element | TEXT | SPACE | CDATA | COMMENT | PI)* CLOSE ;
"""

CSV = r"""
Lf = Record ('LF' Record)* 'LF'? EOF | EOF ;
CrLf = Record ('CRLF' Record)* 'CRLF'? EOF ;
Mixed = Record (('LF' | 'CRLF') Record)* ('LF' | 'CRLF')? EOF ;
Record = (FIELD | QUOTED)? (',' (FIELD | QUOTED)?)+ | FIELD | QUOTED ;
"""

#: dialects that run together, per file extension
DIALECTS = {"py": (PYTHON, ("File",)), "js": (JAVASCRIPT, ("Script", "Module")), "xml": (XML, ("Document",)), "csv": (CSV, ("Lf", "CrLf", "Mixed"))}


@lru_cache
def grammar(extension: str) -> Grammar:
    return Grammar(*DIALECTS[extension])


class LexError(ValueError):
    """The text has a piece that is no token of the language."""


# ---- Python


def python_tokens(text: str, kinds: dict[str, int]) -> list[int]:
    if "\0" in text:
        raise LexError("null byte")
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    out: list[int] = []
    named = {tokenize.NUMBER: "NUMBER", tokenize.STRING: "STRING", tokenize.NEWLINE: "NEWLINE", tokenize.INDENT: "INDENT", tokenize.DEDENT: "DEDENT", tokenize.ENDMARKER: EOF}
    named |= {tokenize.FSTRING_START: "FSTRING_START", tokenize.FSTRING_MIDDLE: "FSTRING_MIDDLE", tokenize.FSTRING_END: "FSTRING_END"}
    numbers = {k: 2 * kinds[v] for k, v in named.items()}
    name, augmented = 2 * kinds["NAME"], 2 * kinds["AUG"]
    keyed, walrus, comma, paren = (2 * kinds[k] for k in ("NAMEEQ", "NAMEW", ",", "("))
    names = {name, *(2 * kinds[k] for k in ("match", "case", "type", "_"))}
    inside: list[str] = []
    # a statement's targets are marked where it turns out to assign: SET before each '=', SETAUG, SETANN
    begins = {2 * kinds[k] for k in ("NEWLINE", "INDENT", "DEDENT")}
    first, lambdas, marked = 0, 0, False
    marks = {k: 2 * kinds[k] for k in ("SET", "SETAUG", "SETANN")}
    soft, lambda_ = {2 * kinds["match"], 2 * kinds["case"]}, 2 * kinds["lambda"]
    starters = names | {2 * kinds[k] for k in ("(", "[", "{", "*", "STRING", "NUMBER", "FSTRING_START", "...", "None", "True", "False")}
    try:
        for tok in tokenize.generate_tokens(io.StringIO(text).readline):
            kind, string = tok[0], tok[1]
            if kind == tokenize.NAME:
                out.append(2 * kinds[string] if string in kinds and (keyword.iskeyword(string) or string in ("match", "case", "type", "_")) else name)
                lambdas += out[-1] == lambda_ and not inside
            elif kind == tokenize.OP:
                if string in kinds:
                    # a name before := or, as a keyword or a parameter in brackets, before =
                    if string == "=":
                        if inside and inside[-1] == "(" and len(out) > 1 and out[-1] in names and out[-2] in (paren, comma):
                            out[-1] = keyed
                    elif string == ":=":
                        if out and out[-1] in names:
                            out[-1] = walrus
                    elif string in "([{":
                        inside.append(string)
                    elif string in ")]}" and inside:
                        inside.pop()
                    if inside:
                        pass
                    elif string == "=" and not lambdas:
                        if not marked and first < len(out):
                            out.insert(first, marks["SET"])
                        first = len(out) + 1
                    elif string == ";":
                        first, lambdas, marked = len(out) + 1, 0, False
                    elif string == ":" and lambdas:
                        lambdas -= 1
                    elif string == ":" and not marked and first < len(out):
                        if out[first] in starters and (out[first] not in soft or len(out) == first + 1):
                            out.insert(first, marks["SETANN"])
                            marked = True
                        else:
                            first = len(out) + 1
                    out.append(2 * kinds[string])
                elif string in AUGMENTED:
                    if not inside and not lambdas and first < len(out):
                        out.insert(first, marks["SETAUG"])
                        marked = True
                    out.append(augmented)
                else:
                    raise LexError(string)
            elif kind in numbers:
                out.append(numbers[kind])
                if out[-1] in begins:
                    first, lambdas, marked = len(out), 0, False
            elif kind not in (tokenize.NL, tokenize.COMMENT):
                raise LexError(string)
    except (tokenize.TokenError, SyntaxError, UnicodeError) as e:
        raise LexError(str(e)) from None
    return out


# ---- JavaScript

JS_TOKEN = re.compile(
    r"""(?P<space>(?:[ \t\v\f\xa0﻿  -   　\r\n  ]+|//[^\r\n  ]*|/\*(?:[^*]|\*(?!/))*+\*/)+)
|(?P<num>(?>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?\d)*)n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?))(?![\w$])
|(?P<priv>\#(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4})*)
|(?P<word>(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
|(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|[^ux]|u[0-9a-fA-F]{4}|u\{0*(?:10|[0-9a-fA-F]?)[0-9a-fA-F]{1,4}\}|x[0-9a-fA-F]{2}))*+"|'(?:[^'\\\r\n]|\\(?:\r\n|[^ux]|u[0-9a-fA-F]{4}|u\{0*(?:10|[0-9a-fA-F]?)[0-9a-fA-F]{1,4}\}|x[0-9a-fA-F]{2}))*+')
|(?P<tick>`)
|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.])""",
    re.X,
)
JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n  ]|\\[^\r\n  ]|\[(?:[^\]\\\r\n  ]|\\[^\r\n  ])*+\])++/[\w$]*")
JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
JS_KEYWORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with async of get set static let await yield from as".split())
JS_BINARY = frozenset("| ^ & == != === !== < > <= >= << >> >>> * / %".split())
JS_ASSIGN = frozenset("*= /= %= += -= <<= >>= >>>= &= ^= |= **= &&= ||= ??=".split())
#: a slash after one of these starts a regular expression
REGEX_AFTER = frozenset("case delete do else in instanceof new return throw typeof void await yield of { } ( [ ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? : = => ...".split()) | JS_ASSIGN
JS_LINE_END = re.compile("[\r\n  ]")


def js_tokens(text: str, kinds: dict[str, int]) -> list[int]:
    out: list[int] = []
    text = text.removeprefix("﻿")
    pos, n, fresh, last, ended = 0, len(text), 0, None, False
    braces: list[str] = []  # '{', '${' and what stood before each '('
    places: list[int] = []  # where each of these is in the output
    shut = -1  # where the bracket that was closed last opened
    arrow, arrow_paren, label = 2 * kinds["ARROWID"], 2 * kinds["ARROW("], 2 * kinds["LABEL"]
    patterns = {2 * kinds[b] + f: 2 * kinds["P" + b] + f for b in "[{" for f in (0, 1)}
    closed: dict[int, int] = {}  # where each closing bracket's opening one is
    brackets = [2 * kinds[k] for k in (")", "]", "}")]
    pieces = {2 * kinds["TMID"], 2 * kinds["TTAIL"]}
    dots = {2 * kinds["."], 2 * kinds["?."]}
    ends = {2 * kinds[k] for k in ("IDENT", "PRIV", "STR", "TFULL", "TTAIL", ")", "]", "this", "super", "async", "of", "get", "set", "from", "as")}
    starts = {2 * kinds[k] for k in ("{", "}", ";", ":", ")", "else", "do")}
    named = {2 * kinds["IDENT"], *(2 * kinds[k] for k in ("async", "of", "get", "set", "static", "let", "await", "yield", "from", "as"))}
    binop, assignop = 2 * kinds["BINOP"], 2 * kinds["ASSIGNOP"]
    if text.startswith("#!"):
        pos = (m.start() if (m := JS_LINE_END.search(text)) else n)
    group_numbers = {"num": 2 * kinds["NUM"], "priv": 2 * kinds["PRIV"], "str": 2 * kinds["STR"]}

    def template(at: int, full: str, more: str) -> int:
        nonlocal last
        m = JS_TEMPLATE.match(text, at)
        if not m:
            raise LexError("open template")
        if m[1] == "`":
            out.append(2 * kinds[full] + fresh)
            last = "`"
        else:
            out.append(2 * kinds[more] + fresh)
            braces.append("${")
            places.append(len(out) - 1)
            last = "{"
        return m.end()

    def mark() -> None:
        """Put SET before the target that the assignment operator at hand turns out to follow."""
        nonlocal shut
        j = len(out) - 1
        while j >= 0:
            kind = out[j] & ~1
            if kind in pieces:
                j = closed.get(j, -1)
            elif kind in brackets:
                j = closed.get(j, -1)
                if j < 1 or kind == brackets[2] or out[j - 1] & ~1 not in ends:
                    break
                j -= 1
            elif j > 1 and out[j - 1] & ~1 in dots:
                j -= 2
            else:
                while j and out[j - 1] & ~1 == 2 * kinds["new"]:
                    j -= 1
                break
        if j >= 0:
            out.insert(j, 2 * kinds["SET"] + (out[j] & 1))
            shut += shut >= j

    while pos < n:
        if text[pos] == "/" and (last is None or last in REGEX_AFTER and last not in ("++", "--", "}") or last == ")" and ended or last == "}" and fresh) and (m := JS_REGEX.match(text, pos)):
            out.append(2 * kinds["REGEX"] + fresh)
            last, fresh, pos = "re", 0, m.end()
            continue
        m = JS_TOKEN.match(text, pos)
        if not m:
            raise LexError(text[pos : pos + 20])
        group, string = m.lastgroup, m[0]
        at, pos = pos, m.end()
        if group == "space":
            if JS_LINE_END.search(string):
                fresh = 1
            continue
        if group == "word":
            if string in JS_KEYWORDS and last not in (".", "?."):
                out.append(2 * kinds[string] + fresh)
                last = string
            else:
                out.append(2 * kinds[string if string in JS_KEYWORDS else "IDENT"] + fresh)
                last = "word"
        elif group == "tick":
            pos = template(pos, "TFULL", "THEAD")
        elif group == "op":
            if string == "}" and braces and braces[-1] == "${":
                braces.pop()
                closed[len(out)] = places.pop()
                pos = template(pos, "TTAIL", "TMID")
                fresh = 0
                continue
            if string in "({[":
                braces.append(last if string == "(" and last in ("if", "while", "for", "with") else string)
                places.append(len(out))
            elif string in ")}]":
                opened = braces.pop() if braces else ""
                shut = places.pop() if places else -1
                closed[len(out)] = shut
                ended = string == ")" and opened in ("if", "while", "for", "with")
            elif string == "=>":
                if fresh:
                    raise LexError("line end before =>")
                if last == ")" and shut >= 0 and out[shut] & ~1 == 2 * kinds["("]:
                    out[shut] = arrow_paren + (out[shut] & 1)
                elif out and out[-1] & ~1 in named:
                    out[-1] = arrow + (out[-1] & 1)
            elif string == "=":
                if last in ("}", "]") and shut >= 0 and out[shut] in patterns:
                    out[shut] = patterns[out[shut]]
                mark()
            elif string in JS_ASSIGN:
                mark()
            elif string == ":":
                if out and out[-1] & ~1 in named and (len(out) == 1 or out[-1] & 1 or out[-2] & ~1 in starts):
                    out[-1] = label + (out[-1] & 1)
            if last == "throw" and fresh:
                raise LexError("line end after throw")
            out.append((binop if string in JS_BINARY and string != "*" else assignop if string in JS_ASSIGN else 2 * kinds[string] if string in kinds else -1) + fresh)
            if out[-1] < 0:
                raise LexError(string)
            last = string
        else:
            out.append(group_numbers[group] + fresh)
            last = group
        fresh = 0
        del at
    out.append(2 * kinds[EOF] + 1)
    return out


# ---- XML

XML_CHAR = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
NAME = "[:A-Z_a-z\xc0-\xd6\xd8-\xf6\xf8-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff][-.0-9\xb7̀-ͯ‿⁀:A-Z_a-z\xc0-\xd6\xd8-\xf6\xf8-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff]*+"
XML_ATTRIBUTE = re.compile(rf"""[ \t\r\n]++({NAME})[ \t\r\n]*+=[ \t\r\n]*+("[^<"]*+"|'[^<']*+')""")
XML_TOKEN = re.compile(
    rf"""(?P<DECL>\A<\?xml[ \t\r\n]+version[ \t\r\n]*=[ \t\r\n]*(?:"1\.[0-9]+"|'1\.[0-9]+')(?:[ \t\r\n]+encoding[ \t\r\n]*=[ \t\r\n]*(?:"[A-Za-z][\w.\-]*"|'[A-Za-z][\w.\-]*'))?(?:[ \t\r\n]+standalone[ \t\r\n]*=[ \t\r\n]*(?:"(?:yes|no)"|'(?:yes|no)'))?[ \t\r\n]*\?>)
|(?P<COMMENT><!--(?:[^-]|-(?!-))*+-->)
|(?P<CDATA><!\[CDATA\[(?:[^\]]|\](?!\]>))*+\]\]>)
|(?P<PI><\?(?![xX][mM][lL][ \t\r\n?])(?:{NAME})(?:\?>|[ \t\r\n](?:[^?]|\?(?!>))*+\?>))
|(?P<DOCTYPE><!DOCTYPE[ \t\r\n]+(?:{NAME})(?:"[^"]*+"|'[^']*+'|[^"'<>\[\]])*+(?:\[(?:"[^"]*+"|'[^']*+'|<!--(?:[^-]|-(?!-))*+-->|[^"'\]])*+\][ \t\r\n]*)?>)
|(?P<CLOSE></(?P<close>{NAME})[ \t\r\n]*>)
|(?P<OPEN><(?P<open>{NAME})(?P<attributes>(?:[ \t\r\n]++(?:{NAME})[ \t\r\n]*+=[ \t\r\n]*+(?:"[^<"]*+"|'[^<']*+'))*+)[ \t\r\n]*+(?P<empty>/?)>)
|(?P<SPACE>[ \t\r\n]++(?![^<]))
|(?P<TEXT>[^<]+)""",
    re.X,
)
XML_REFERENCE = re.compile(rf"&(?:#([0-9]+);|#x([0-9a-fA-F]+);|({NAME});)?")
XML_ENTITY = re.compile(rf"<!ENTITY[ \t\r\n]+({NAME})")


def _references(text: str, entities: set[str]) -> bool:
    """Whether every ampersand starts a reference to a character or a declared entity."""
    for m in XML_REFERENCE.finditer(text):
        if m[1] or m[2]:
            code = int(m[1]) if m[1] else int(m[2], 16)
            if code > 0x10FFFF or XML_CHAR.match(chr(code)):
                return False
        elif m[3] not in entities:
            return False
    return True


def xml_tokens(text: str, kinds: dict[str, int]) -> list[int]:
    text = text.removeprefix("﻿")
    if XML_CHAR.search(text):
        raise LexError("a character XML excludes")
    entities = {"lt", "gt", "amp", "apos", "quot"}
    out, pos, opened = [], 0, []
    while pos < len(text):
        m = XML_TOKEN.match(text, pos)
        if not m:
            raise LexError(text[pos : pos + 20])
        pos, kind = m.end(), m.lastgroup
        if m["open"]:
            kind = "EMPTY" if m["empty"] else "OPEN"
            names = [a[1] for a in XML_ATTRIBUTE.finditer(m["attributes"])]
            if len(names) != len(set(names)) or "&" in m["attributes"] and not _references(m["attributes"], entities):
                raise LexError("attributes")
            if kind == "OPEN":
                opened.append(m["open"])
        elif m["close"]:
            kind = "CLOSE"
            if not opened or opened.pop() != m["close"]:
                raise LexError("tags do not match")
        elif kind == "DOCTYPE":
            entities.update(XML_ENTITY.findall(m[0]))
        elif kind == "TEXT" and ("]]>" in m[0] or "&" in m[0] and not _references(m[0], entities)):
            raise LexError("text")
        out.append(2 * kinds[kind])
    out.append(2 * kinds[EOF])
    return out


# ---- delimited text

CSV_TOKEN = re.compile(r'(?P<QUOTED>"(?:[^"]|"")*+"(?=[,\r\n]|\Z))|(?P<FIELD>[^",\r\n]++)|(?P<comma>,)|(?P<CRLF>\r\n)|(?P<LF>\n)')


def csv_tokens(text: str, kinds: dict[str, int]) -> list[int]:
    out, pos, width, count = [], 0, None, 1
    text = text.removeprefix("﻿")
    while pos < len(text):
        m = CSV_TOKEN.match(text, pos)
        if not m:
            raise LexError(text[pos : pos + 20])
        pos, kind = m.end(), m.lastgroup
        if kind == "comma":
            count += 1
        elif kind in ("CRLF", "LF"):
            if width not in (None, count):
                raise LexError("another number of fields")
            width, count = count, 1
        out.append(2 * kinds["," if kind == "comma" else kind])
    if text and text[-1] != "\n" and width not in (None, count):
        raise LexError("another number of fields")
    out.append(2 * kinds[EOF])
    return out


TOKENS = {"py": python_tokens, "js": js_tokens, "xml": xml_tokens, "csv": csv_tokens}


def parses(text: str, extension: str) -> bool:
    """Whether any dialect of the extension derives the text."""
    g = grammar(extension)
    try:
        toks = TOKENS[extension](text, g.kinds)
    except LexError:
        return False
    return g.accepts(toks)
