"""Parsing expression grammars of four languages, over the tokens of ``lexing``.

The grammars state what the languages' public specifications state: Python 3.13,
Go, ECMAScript (script and module) and RFC 8259 JSON.  Only what decides validity
is kept: operator precedence, for instance, never makes a text invalid.
"""

from __future__ import annotations

JSON = """
Json <- Value
Value <- STR / NUM / 'true' / 'false' / 'null' / BRACK[Array] / BRACE[Object]
Array <- (Value (',' Value)*)?
Object <- (STR ':' Value (',' STR ':' Value)*)?
"""

# ---------------------------------------------------------------- Python: one logical line
PYTHON_LINE = """
Line <- Simple (';' Simple)* ';'? END
Tail <- ':' Simple (';' Simple)* ';'? END
Open <- ':' END
IfHead <- 'if' Named
ElifHead <- 'elif' Named
WhileHead <- 'while' Named
ElseHead <- 'else'
TryHead <- 'try'
FinallyHead <- 'finally'
ForHead <- 'async'? 'for' Targets 'in' StarExprs
WithHead <- 'async'? 'with' (PAREN[WithItems] &':' / WithItem (',' WithItem)*)
WithItems <- WithItem (',' WithItem)* ','?
WithItem <- Expr ('as' StarTarget)?
ExceptHead <- 'except' ('*' Expr ('as' NAME)? / Expr ('as' NAME)?)?
DefHead <- 'async'? 'def' NAME BRACK[TypeParams]? PAREN[Params] ('->' Expr)?
ClassHead <- 'class' NAME BRACK[TypeParams]? PAREN[Args]?
Decorator <- '@' Named END
MatchHead <- 'match' StarNamed (',' StarNamed)* ','?
CaseHead <- 'case' Patterns ('if' Named)?
TypeParams <- TypeParam (',' TypeParam)* ','?
TypeParam <- ('*' / '**')? NAME (':' Expr)? ('=' StarExpr)?

Simple <- 'pass' / 'break' / 'continue' / 'return' StarExprs? / 'raise' (Expr ('from' Expr)?)? / 'global' NAME (',' NAME)* / 'nonlocal' NAME (',' NAME)* / 'del' DelTarget (',' DelTarget)* ','? &(END / ';') / 'assert' Expr (',' Expr)? / Import / 'type' NAME BRACK[TypeParams]? '=' Expr / Assignment / StarExprs / Yield
Import <- 'import' Dotted ('as' NAME)? (',' Dotted ('as' NAME)?)* / 'from' ('.' / '...')* Dotted 'import' Imported / 'from' ('.' / '...')+ 'import' Imported
Imported <- '*' / PAREN[ImportedIn] / ImportName (',' ImportName)*
ImportedIn <- ImportName (',' ImportName)* ','?
ImportName <- NAME ('as' NAME)?
Dotted <- NAME ('.' NAME)*
Assignment <- Single ':' Expr ('=' (Yield / StarExprs))? / (Targets '=')+ (Yield / StarExprs) !'=' / Single AUG (Yield / StarExprs)
Single <- Ending / NAME !Trailer / PAREN[Single] !Trailer
Targets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*'? Target
Target <- Ending / NAME !Trailer / PAREN[TargetsIn] !Trailer / BRACK[TargetsIn] !Trailer
TargetsIn <- Targets?
DelTarget <- Ending / NAME !Trailer / PAREN[DelIn] !Trailer / BRACK[DelIn] !Trailer
DelIn <- (DelTarget (',' DelTarget)* ','?)?
Ending <- Atom (PAREN[Args]* Selector)+ !PAREN
Selector <- '.' NAME / BRACK[Slices]
Trailer <- Selector / PAREN[Args]

StarExprs <- StarExpr (',' StarExpr)* ','?
StarExpr <- '*' BitOr / Expr
StarNamed <- '*' BitOr / Named
Named <- NAME ':=' Expr / Expr
Expr <- 'lambda' LambdaParams ':' Expr / Disjunction ('if' Disjunction 'else' Expr)?
Disjunction <- Negation (('and' / 'or') Negation)*
Negation <- 'not'* Comparison
Comparison <- BitOr (('<' / '>' / '==' / '>=' / '<=' / '!=' / 'in' / 'not' 'in' / 'is' 'not'?) BitOr)*
BitOr <- Unary (('|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@' / '**') Unary)*
Unary <- ('+' / '-' / '~')* 'await'? Primary
Primary <- Atom Trailer*
Atom <- NAME / NUM / STR+ / BYTES+ / 'None' / 'True' / 'False' / '...' / PAREN[Inside] / BRACK[ListIn] / BRACE[DictIn]
Inside <- END / Yield END / Named Comprehension END / Named END / StarNamed ',' (StarNamed (',' StarNamed)* ','?)? END
ListIn <- END / Named Comprehension END / StarNamed (',' StarNamed)* ','? END
DictIn <- END / Expr ':' Expr Comprehension END / DictItem (',' DictItem)* ','? END / Named Comprehension END / StarNamed (',' StarNamed)* ','? END
DictItem <- '**' BitOr / Expr ':' Expr
Comprehension <- ('async'? 'for' Targets 'in' Disjunction ('if' Disjunction)*)+
Yield <- 'yield' ('from' Expr / StarExprs)?
Args <- (Positional (',' Positional)* (',' Keyword)* ','? / Keyword (',' Keyword)* ','?)? END
Positional <- !(NAME '=') ('*' Expr / Named Comprehension?)
Keyword <- NAME '=' Expr / '**' Expr / '*' Expr
Slices <- Slice (',' Slice)* ','?
Slice <- Expr? ':' Expr? (':' Expr?)? / StarNamed
Params <- (Leading (',' Trailing)? ','? / Trailing ','?)? END
Leading <- Plain (',' Plain)* (',' Default)* / Default (',' Default)*
Plain <- NAME (':' Expr)? !'=' / '/'
Default <- NAME (':' Expr)? '=' Expr / '/'
Trailing <- '*' NAME (':' StarExpr)? (',' KeyOnly)* (',' '**' NAME (':' Expr)?)? / '*' (',' KeyOnly)+ (',' '**' NAME (':' Expr)?)? / '**' NAME (':' Expr)?
KeyOnly <- NAME (':' Expr)? ('=' Expr)?
LambdaParams <- (LLeading (',' LTrailing)? ','? / LTrailing ','?)?
LLeading <- LPlain (',' LPlain)* (',' LDefault)* / LDefault (',' LDefault)*
LPlain <- NAME !'=' / '/'
LDefault <- NAME '=' Expr / '/'
LTrailing <- '*' NAME (',' NAME ('=' Expr)?)* (',' '**' NAME)? / '*' (',' NAME ('=' Expr)?)+ (',' '**' NAME)? / '**' NAME
Patterns <- StarPattern (',' StarPattern)* ','?
StarPattern <- '*' NAME / Pattern
Pattern <- Closed ('|' Closed)* ('as' NAME)?
Closed <- '-'? NUM (('+' / '-') NUM)? / STR+ / BYTES+ / 'None' / 'True' / 'False' / NAME ('.' NAME)* PAREN[ClassPattern]? / PAREN[SequencePattern] / BRACK[SequencePattern] / BRACE[MappingPattern]
SequencePattern <- Patterns?
ClassPattern <- (ClassArg (',' ClassArg)* ','?)?
ClassArg <- NAME '=' Pattern / Pattern
MappingPattern <- (MapItem (',' MapItem)* ','?)?
MapItem <- '**' NAME / Closed ':' Pattern
"""

# ---------------------------------------------------------------- Python: lines of a block
# A capital letter is a head that needs a block, a small one has its statements on the line.
PYTHON_BLOCK = """
Top <- Statement*
Block <- Statement+
Statement <- 's' / '@'+ (('D' / 'K') BRACE[Block] / 'd' / 'k') / ('D' / 'K' / 'H') BRACE[Block] / 'd' / 'k' / 'h' / If / Loop / Try / 'M' BRACE[Cases]
If <- ('I' BRACE[Block] / 'i') ('E' BRACE[Block] / 'e')* Else?
Else <- 'L' BRACE[Block] / 'l'
Loop <- (('F' / 'W') BRACE[Block] / 'f' / 'w') Else?
Try <- ('T' BRACE[Block] / 't') (('X' BRACE[Block] / 'x')+ Else? Finally? / Finally)
Finally <- 'Y' BRACE[Block] / 'y'
Cases <- ('C' BRACE[Block] / 'c')+
"""

# ---------------------------------------------------------------- Go
# "@" stands for rules with and without composite literals of plain type names.
_GO_EXPR = """
Exprs@ <- Expr@ (',' Expr@)*
Expr@ <- Unary@ (BINARY Unary@)*
Unary@ <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~')* Primary@
Primary@ <- Operand@ Postfix*
Simple@ <- Names ':=' Exprs@ / Exprs@ (ASSIGN Exprs@ / '++' / '--' / '<-' Expr@)?
Operand@ <- LITERAL / 'func' Signature BRACE[Block] / TypeLiteral BRACE[Values]? / {named} ID / PAREN[ExprIn]
"""
GO = (
    """
File <- 'package' ID ';' (Import ';')* Tops
Top <- (Function / Declaration) (';' / &END) / ';'
Import <- 'import' (ImportSpec / PAREN[ImportSpecs])
ImportSpecs <- (ImportSpec (';' ImportSpec)* ';'?)?
ImportSpec <- ('.' / ID)? STRING
Declaration <- 'const' (ConstSpec / PAREN[ConstSpecs]) / 'var' (VarSpec / PAREN[VarSpecs]) / 'type' (TypeSpec / PAREN[TypeSpecs])
ConstSpecs <- (ConstSpec (';' ConstSpec)* ';'?)?
ConstSpec <- Names (Type? '=' Exprs)?
VarSpecs <- (VarSpec (';' VarSpec)* ';'?)?
VarSpec <- Names ('=' Exprs / Type ('=' Exprs)?)
TypeSpecs <- (TypeSpec (';' TypeSpec)* ';'?)?
TypeSpec <- ID BRACK[TypeParams] Type / ID '='? Type
TypeParams <- TypeParam (',' TypeParam)* ','?
TypeParam <- Names Union
Union <- '~'? Type ('|' '~'? Type)*
Names <- ID (',' ID)*
Function <- 'func' PAREN[Params]? ID BRACK[TypeParams]? Signature BRACE[Block]?
Signature <- PAREN[Params] (PAREN[Params] / Type)?
Params <- END / Named (',' Named)* ','? END / '...'? Type (',' '...'? Type)* ','? END
Named <- Names '...'? Type
Type <- ID ('.' ID)? BRACK[TypeArgs]? / TypeLiteral / '*' Type / PAREN[Type]
TypeArgs <- Type (',' Type)* ','?
TypeLiteral <- BRACK[Length] Type / 'map' BRACK[Type] Type / 'chan' '<-'? Type / '<-' 'chan' Type / 'struct' BRACE[Fields] / 'interface' BRACE[Methods] / 'func' Signature
Length <- ('...' / Expr)?
Fields <- (Field (';' Field)* ';'?)?
Field <- Names Type STRING? / '*'? ID ('.' ID)? BRACK[TypeArgs]? STRING?
Methods <- (Method (';' Method)* ';'?)?
Method <- ID Signature / Union
ExprIn <- Expr
Index <- Expr? ':' Expr? (':' Expr)? END / Expr (',' Expr)* ','? END
Args <- (Expr (',' Expr)* '...'? ','?)?
Postfix <- '.' ID / '.' PAREN[Asserted] / BRACK[Index] / PAREN[Args]
Asserted <- 'type' / Type
Values <- (Element (',' Element)* ','?)?
Element <- Value (':' Value)?
Value <- Expr / BRACE[Values]
Block <- Statements
Item <- Statement (';' / &END) / ';'
Statement <- Declaration / ID ':' Statement? / 'return' Exprs? / 'break' ID? / 'continue' ID? / 'goto' ID / 'fallthrough' / BRACE[Block] / If / 'switch' (SimpleN? ';')? SimpleN? BRACE[Cases] / 'select' BRACE[Cases] / For / 'defer' Expr / 'go' Expr / Simple
If <- 'if' (SimpleN? ';')? ExprN BRACE[Block] ('else' (If / BRACE[Block]))?
For <- 'for' (BRACE[Block] / Range BRACE[Block] / SimpleN? ';' ExprN? ';' SimpleN? BRACE[Block] / ExprN BRACE[Block])
Range <- (Names ':=' / ExprsN '=')? 'range' ExprN
Cases <- (&('case' / 'default') Clauses)?
Clause <- ('case' (Exprs &':' / Simple) / 'default') ':' / Item
"""
    + _GO_EXPR.format(named="ID ('.' ID)? BRACK[TypeArgs]? BRACE[Values] /").replace("@", "")
    + _GO_EXPR.format(named="").replace("@", "N")
)

# ---------------------------------------------------------------- ECMAScript
# "@" is the context: S script, M module, F function, A async, G generator, H async generator.
_JS_CONTEXT = """
Block@ <- Statements@
Statement@ <- ';' / NL / BRACE[Block@] / Variables@ Semi / Function / Class@ / If@ / 'for' {await_kw} PAREN[ForHead@] NL? Statement@ / 'while' PAREN[Expr@] NL? Statement@ / 'do' NL? Statement@ NL? 'while' PAREN[Expr@] (';' / NL)? / {ret} 'break' BIND@? Semi / 'continue' BIND@? Semi / 'throw' !NL Expr@ Semi / Try@ / 'switch' PAREN[Expr@] NL? BRACE[Cases@] / 'with' PAREN[Expr@] NL? Statement@ / 'debugger' Semi / {modules} BIND@ ':' NL? Statement@ / !BRACE !'function' !'class' Expr@ Semi
If@ <- 'if' PAREN[Expr@] NL? Statement@ (NL? 'else' NL? Statement@)?
ForHead@ <- ('var' / 'let' / 'const') Target@B ('in' Expr@ / 'of' Assign@) END / Reference@ ('in' Expr@ / 'of' Assign@) END / (Variables@ / Expr@)? ';' Expr@? ';' Expr@? END
Try@ <- 'try' BRACE[Block@] NL? ('catch' PAREN[Target@B]? NL? BRACE[Block@] (NL? 'finally' BRACE[Block@])? / 'finally' BRACE[Block@])
Cases@ <- (&('case' / 'default') Clauses@)?
Clause@ <- 'case' Expr@ ':' / 'default' ':' / Statement@
Variables@ <- ('var' / 'let') Declared@ (',' Declared@)* / 'const' Constant@ (',' Constant@)*
Declared@ <- BIND@ ('=' Assign@)? / Target@B '=' Assign@
Constant@ <- Target@B '=' Assign@
Target@B <- BIND@ / BRACK[ArrayTarget@] / BRACE[ObjectTarget@]
ArrayTarget@ <- (Bound@? ',')* ('...' Target@B / Bound@)?
Bound@ <- Target@B ('=' Assign@)?
ObjectTarget@ <- ('...' BIND@ / BoundName@ (',' BoundName@)* (',' '...' BIND@)? ','?)?
BoundName@ <- Name@ ':' Bound@ / BIND@ ('=' Assign@)?
Params@ <- ('...' Target@B / Bound@ (',' Bound@)* (',' '...' Target@B)? ','?)?
Expr@ <- Assign@ (',' Assign@)*
Assign@ <- Arrow@ / {yield_kw} Reference@ ASSIGN Assign@ / BRACK[ArrayAssign@] '=' Assign@ / BRACE[ObjectAssign@] '=' Assign@ / Conditional@
Arrow@ <- (BIND@ / PAREN[Params@]) '=>' (BRACE[BlockF] / !BRACE AssignF) / 'async' (BIND@ / PAREN[ParamsA]) '=>' (BRACE[BlockA] / !BRACE AssignA)
Reference@ <- (Base@ ((PAREN[Args@] / TEMPLATE / '?.' PROP)* Selector@)+ / BIND@ / PAREN[Reference@]) &(ASSIGN / 'in' / 'of' / END / ',' / '=')
ArrayAssign@ <- (Assigned@? ',')* ('...' AssignTo@ / Assigned@)?
Assigned@ <- AssignTo@ ('=' Assign@)?
AssignTo@ <- BRACK[ArrayAssign@] !Selector@ / BRACE[ObjectAssign@] !Selector@ / Reference@
ObjectAssign@ <- ((Name@ ':' Assigned@ / BIND@ ('=' Assign@)?) (',' (Name@ ':' Assigned@ / BIND@ ('=' Assign@)?))* (',' '...' AssignTo@)? ','? / '...' AssignTo@)?
Conditional@ <- Binary@ ('?' Assign@ ':' Assign@)?
Binary@ <- Unary@ (BINARY Unary@)*
Unary@ <- (UNARY {await_op})* Base@ Trailer@* ('++' / '--')?
Selector@ <- '.' PROP / '.' PRIVATE / BRACK[Expr@] / '?.' PROP / '?.' PRIVATE / '?.' BRACK[Expr@]
Trailer@ <- Selector@ / PAREN[Args@] / TEMPLATE / '?.' PAREN[Args@]
Args@ <- ('...'? Assign@ (',' '...'? Assign@)* ','?)?
Base@ <- BIND@ !'=>' / VALUE / TEMPLATE / BRACK[Elements@] / BRACE[Members@] / PAREN[Expr@] / Function / FunctionNameless / Class@ / ClassNameless@ / 'new' ('.' PROP / Base@ ('.' PROP / '.' PRIVATE / BRACK[Expr@] / TEMPLATE)* PAREN[Args@]?) / 'super' &(PAREN / '.' / BRACK) / 'import' (PAREN[Args@] / '.' PROP) / PRIVATE &'in'
Elements@ <- (('...'? Assign@)? ',')* ('...'? Assign@)?
Members@ <- (Member@ (',' Member@)* ','?)?
Member@ <- '...' Assign@ / Name@ ':' Assign@ / Method@ / BIND@ &(',' / END)
Name@ <- PROP / STR / NUM / BRACK[Assign@]
Method@ <- 'async' '*' Key@ PAREN[ParamsH] NL? BRACE[BlockH] / 'async' !NL Key@ PAREN[ParamsA] NL? BRACE[BlockA] / '*' Key@ PAREN[ParamsG] NL? BRACE[BlockG] / 'get' Key@ PAREN[Nothing] NL? BRACE[BlockF] / 'set' Key@ PAREN[Target@B1] NL? BRACE[BlockF] / Key@ PAREN[ParamsF] NL? BRACE[BlockF]
Target@B1 <- Bound@
Key@ <- Name@ / PRIVATE
Class@ <- 'class' BIND@ ClassTail@
ClassNameless@ <- 'class' ClassTail@
ClassTail@ <- ('extends' Base@ Trailer@*)? NL? BRACE[ClassBody@]
ClassBody@ <- ClassItems@
ClassItem@ <- ';' / NL / 'static' BRACE[BlockF] / 'static'? Method@ / 'static'? Key@ ('=' Assign@)? Semi
"""
_JS_SHARED = """
Semi <- ';' / NL / &END
Nothing <- END
Function <- 'async' !NL 'function' ('*' BIND PAREN[ParamsH] NL? BRACE[BlockH] / BIND PAREN[ParamsA] NL? BRACE[BlockA]) / 'function' ('*' BIND PAREN[ParamsG] NL? BRACE[BlockG] / BIND PAREN[ParamsF] NL? BRACE[BlockF])
FunctionNameless <- 'async' !NL 'function' ('*' PAREN[ParamsH] NL? BRACE[BlockH] / PAREN[ParamsA] NL? BRACE[BlockA]) / 'function' ('*' PAREN[ParamsG] NL? BRACE[BlockG] / PAREN[ParamsF] NL? BRACE[BlockF])
Script <- StatementsS
Module <- StatementsM
ModuleItem <- 'import' !PAREN !'.' (STR / Imports 'from' STR) ('with' BRACE)? Semi / 'export' Exported
Imports <- BIND (',' (BRACE[ImportNames] / '*' 'as' BIND))? / BRACE[ImportNames] / '*' 'as' BIND
ImportNames <- (ImportName (',' ImportName)* ','?)?
ImportName <- (PROP / STR) 'as' BIND / BIND
Exported <- '*' ('as' (PROP / STR))? 'from' STR ('with' BRACE)? Semi / BRACE[ExportNames] ('from' STR ('with' BRACE)?)? Semi / 'default' (Function / FunctionNameless / ClassM / ClassNamelessM / AssignM Semi) / VariablesM Semi / Function / ClassM
ExportNames <- ((PROP / STR) ('as' (PROP / STR))? (',' (PROP / STR) ('as' (PROP / STR))?)* ','?)?
"""


def javascript() -> str:
    out = _JS_SHARED
    for c in "SMFAGH":
        waits, yields = c in "MAH", c in "GH"
        out += _JS_CONTEXT.format(
            await_kw="'await'?" if waits else "",
            ret="" if c in "SM" else "'return' (Semi / Expr@ Semi) /",
            modules="ModuleItem /" if c == "M" else "",
            yield_kw="'yield' ('*' Assign@ / !NL Assign@)? &(')' / ';' / ',' / NL / END / ':' / ',') /" if yields else "",
            await_op="/ 'await'" if waits else "",
        ).replace("@", c)
    return out


#: Rules whose results are kept by position, since alternatives try them again.
MEMO = {"javascript": " ".join(f"Base{c} Assign{c} Conditional{c} Reference{c} Name{c} Target{c}B" for c in "SMFAGH"), "python": "Atom Expr BitOr Primary Ending Targets", "go": "Expr ExprN Exprs ExprsN Type Primary PrimaryN"}
