"""Parsing expression grammars of the languages, for :class:`coppice.llm.packrat.Grammar`.

They decide whether a file is well formed, not what it means: operators have no precedence here, as
none is needed for that. Comments and C's directives are left out by the lexers.
"""

from __future__ import annotations

PYTHON = r"""
file <- (NEWLINE / stmt)* EOF
stmt <- compound / simple
simple <- small (';' small)* ';'? NEWLINE
small <- 'pass' / 'break' / 'continue' / 'return' starexprs? / 'raise' (expr ('from' expr)?)? / ('global' / 'nonlocal') NAME (',' NAME)*
    / 'del' starexprs / 'assert' expr (',' expr)? / yieldexpr / importstmt / typealias / assignment / starexprs
typealias <- &'type' NAME NAME typeparams? '=' expr
importstmt <- 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' names ','? ')' / names)
names <- NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
dotted <- NAME ('.' NAME)*
assignment <- single ':' expr ('=' value)? / single augmented value / (targets '=')+ value !'='
value <- yieldexpr / starexprs
augmented <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**='
single <- chain / NAME / '(' single ')'
targets <- target (',' target)* ','?
target <- '*'? (chain / NAME / '(' targets? ')' / '[' targets? ']')
chain <- atom (suffix &suffix)* ('.' NAME / '[' slices ']') !suffix
compound <- decorated / asyncstmt / ifstmt / whilestmt / forstmt / trystmt / withstmt / funcdef / classdef / matchstmt
decorated <- ('@' namedexpr NEWLINE)+ (classdef / funcdef / 'async' funcdef)
asyncstmt <- 'async' (funcdef / forstmt / withstmt)
block <- NEWLINE INDENT stmt+ DEDENT / simple
ifstmt <- 'if' namedexpr ':' block ('elif' namedexpr ':' block)* elseblock?
elseblock <- 'else' ':' block
whilestmt <- 'while' namedexpr ':' block elseblock?
forstmt <- 'for' targets 'in' starexprs ':' block elseblock?
trystmt <- 'try' ':' block ((('except' '*'? (expr (',' expr)* ('as' NAME)?)? ':' block)+ elseblock? finblock?) / finblock)
finblock <- 'finally' ':' block
withstmt <- 'with' ('(' withitem (',' withitem)* ','? ')' ':' / withitem (',' withitem)* ':') block
withitem <- expr ('as' target)?
funcdef <- 'def' NAME typeparams? '(' params? ')' ('->' expr)? ':' block
typeparams <- '[' ('*' / '**')? NAME (':' expr)? ('=' expr)? (',' ('*' / '**')? NAME (':' expr)? ('=' expr)?)* ','? ']'
params <- param (',' param)* ','?
param <- ('*' / '**')? NAME (':' starexpr)? ('=' expr)? / '*' / '/'
classdef <- 'class' NAME typeparams? ('(' arguments? ')')? ':' block
matchstmt <- &'match' NAME starexprs ':' NEWLINE INDENT caseblock+ DEDENT
caseblock <- &'case' NAME patterns ('if' namedexpr)? ':' block
patterns <- pattern (',' pattern)* ','?
pattern <- '*' NAME / orpattern ('as' NAME)?
orpattern <- closed ('|' closed)*
closed <- '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / dotted ('(' (patarg (',' patarg)* ','?)? ')')? / '(' patterns? ')' / '[' patterns? ']' / '{' (patkey (',' patkey)* ','?)? '}'
patarg <- NAME '=' pattern / pattern
patkey <- '**' NAME / closed ':' pattern
starexprs <- starexpr (',' starexpr)* ','?
starexpr <- '*' binary / namedexpr
namedexpr <- NAME ':=' expr / expr
yieldexpr <- 'yield' ('from' expr / starexprs)?
expr <- lambda / binary ('if' binary 'else' expr)?
lambda <- 'lambda' (lparam (',' lparam)* ','?)? ':' expr
lparam <- ('*' / '**')? NAME ('=' expr)? / '*' / '/'
binary <- unary (binop unary)*
binop <- 'or' / 'and' / 'not' 'in' / 'in' / 'is' 'not'? / '==' / '!=' / '<=' / '>=' / '<' / '>' / '|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@' / '**'
unary <- ('not' / '+' / '-' / '~')* 'await'? atom suffix*
suffix <- '.' NAME / '(' arguments? ')' / '[' slices ']'
arguments <- argument (',' argument)* ','?
argument <- '**' expr / '*' expr / NAME '=' expr / namedexpr compfor?
slices <- slice (',' slice)* ','?
slice <- expr? ':' expr? (':' expr?)? / '*' binary / namedexpr
atom <- NAME / NUM / STR+ / '...' / 'None' / 'True' / 'False' / paren / list / braces
paren <- '(' (yieldexpr / starexpr compfor / starexprs)? ')'
list <- '[' (starexpr compfor / starexprs)? ']'
braces <- '{' (item compfor / item (',' item)* ','?)? '}'
item <- '**' binary / expr ':' expr / starexpr
compfor <- ('async'? 'for' targets 'in' binary ('if' compcond)*)+
compcond <- NAME ':=' binary / lambda / binary
"""

JAVASCRIPT = r"""
program <- statement* EOF
statement <- block / variables / function / class / ifstmt / forstmt / whilestmt / dostmt / jump / throwstmt / trystmt / switchstmt / importstmt / exportstmt / 'with' '(' expr ')' statement / ';' / 'debugger' semi / label / expressionstmt
block <- '{' statement* '}'
semi <- ';' / &'}' / ~nl / &EOF
variables <- ('const' / 'var' / &'let' NAME) binding (',' binding)* semi
binding <- (NAME / object / array) ('=' assign)?
function <- (&'async' NAME)? 'function' '*'? NAME params block
params <- '(' (param (',' param)* ','?)? ')'
param <- '...'? (NAME / object / array) ('=' assign)?
class <- ('@' postfix)* 'class' NAME ('extends' postfix)? classbody
classbody <- '{' (';' / member)* '}'
member <- ('@' postfix)* ('static' block / (&'static' NAME block) / (&'static' NAME !'(' !'=')? method / (&'static' NAME)? propname ('=' assign)? semi)
method <- (&'async' NAME !'(' '*'? / (&'get' / &'set') NAME !'(' !'=' / '*')? propname params block
propname <- NAME / KEYWORD / STR / NUM / '[' assign ']' / '#' NAME
ifstmt <- 'if' '(' expr ')' statement ('else' statement)?
forstmt <- 'for' (&'await' NAME)? '(' forhead ')' statement
forhead <- forvar (&'of' NAME assign / 'in' expr) / (fordecl / expr)? ';' expr? ';' expr? / postfix &'of' NAME assign / expr
forvar <- ('const' / 'var' / &'let' NAME) (NAME / object / array)
fordecl <- ('const' / 'var' / &'let' NAME) binding (',' binding)*
whilestmt <- 'while' '(' expr ')' statement
dostmt <- 'do' statement 'while' '(' expr ')' ';'?
jump <- ('break' / 'continue') (!~nl NAME)? semi / 'return' (!~nl !';' !'}' expr)? semi
throwstmt <- 'throw' expr semi
trystmt <- 'try' block ('catch' ('(' (NAME / object / array) ')')? block finally? / finally)
finally <- 'finally' block
switchstmt <- 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' statement*)* '}'
importstmt <- 'import' (STR / importnames &'from' NAME STR) semi
importnames <- NAME (',' (namespace / named))? / namespace / named
namespace <- '*' &'as' NAME NAME
named <- '{' (spec (',' spec)* ','?)? '}'
spec <- (NAME / KEYWORD / STR) (&'as' NAME (NAME / KEYWORD / STR))?
exportstmt <- 'export' ('default' (function / class / assign semi) / variables / function / class / '*' (&'as' NAME NAME)? &'from' NAME STR semi / named (&'from' NAME STR)? semi)
label <- NAME ':' statement
expressionstmt <- !'{' !'function' !'class' expr semi
expr <- assign (',' assign)*
assign <- arrow / yield / unary (binop unary / '?' assign ':' assign)*
yield <- &'yield' NAME '*'? !~nl assign
arrow <- (&'async' NAME)? (NAME / params) '=>' (block / assign)
binop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>>=' / '>>>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' / '===' / '!==' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '<<' / '>>' / '>>>' / '+' / '-' / '*' / '/' / '%' / '**' / '&&' / '||' / '??' / '&' / '|' / '^' / 'in' / 'instanceof'
unary <- ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete')* (&'await' NAME unary / postfix)
postfix <- primary suffix* (!~nl ('++' / '--'))?
suffix <- '.' ('#'? (NAME / KEYWORD)) / '?.' (NAME / KEYWORD / '[' expr ']' / arguments) / '[' expr ']' / arguments / TEMPLATE
arguments <- '(' ('...'? assign (',' '...'? assign)* ','?)? ')'
primary <- functionexpr / classexpr / NAME / NUM / STR / TEMPLATE / REGEX / 'this' / 'super' / 'null' / 'true' / 'false' / '(' expr ')' / array / object / 'new' ('.' NAME / 'new'? primary newsuffix* arguments?) / 'import' ('(' assign ')' / '.' NAME) / '#' NAME
newsuffix <- '.' (NAME / KEYWORD) / '[' expr ']'
functionexpr <- (&'async' NAME)? 'function' '*'? NAME? params block
classexpr <- 'class' NAME? ('extends' postfix)? classbody
array <- '[' (',' / '...'? assign (',' / &']'))* ']'
object <- '{' (prop (',' prop)* ','?)? '}'
prop <- '...' assign / method / propname ':' assign / NAME ('=' assign)?
"""

JAVA = r"""
program <- (annotation* 'package' qualified ';')? (import / ';')* (typedecl / method)* EOF
import <- 'import' 'static'? qualified ('.' '*')? ';'
qualified <- NAME ('.' NAME)*
typedecl <- ';' / modifier* (class / interface / enum / record / annotationdecl)
modifier <- annotation / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !':' !'->' / &'sealed' NAME &(modifier / 'class' / 'interface') / &'non' NAME '-' NAME
annotation <- '@' !'interface' qualified ('(' (element (',' element)*)? ')')?
element <- NAME '=' elementvalue / elementvalue
elementvalue <- annotation / '{' (elementvalue (',' elementvalue)*)? ','? '}' / ternary
class <- 'class' NAME typeparams? ('extends' type)? ('implements' types)? (&'permits' NAME types)? classbody
interface <- 'interface' NAME typeparams? ('extends' types)? (&'permits' NAME types)? classbody
enum <- 'enum' NAME ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant <- annotation* NAME arguments? classbody?
record <- &'record' NAME NAME typeparams? formals ('implements' types)? classbody
annotationdecl <- '@' 'interface' NAME '{' (modifier* type NAME '(' ')' ('default' elementvalue)? ';' / typedecl / member)* '}'
types <- type (',' type)*
typeparams <- '<' annotation* NAME ('extends' type ('&' type)*)? (',' annotation* NAME ('extends' type ('&' type)*)?)* '>'
classbody <- '{' member* '}'
member <- 'static'? block / typedecl / method / modifier* type declarator (',' declarator)* ';'
method <- modifier* typeparams? ('void' / type)? NAME (formals dims? ('throws' types)? (block / ';') / block)
formals <- '(' (formal (',' formal)*)? ')'
formal <- modifier* type '...'? (NAME ('.' 'this')? / 'this') dims?
dims <- (annotation* '[' ']')+
type <- annotation* (primitive / classtype) dims?
primitive <- 'int' / 'long' / 'double' / 'boolean' / 'char' / 'byte' / 'short' / 'float'
classtype <- NAME typeargs? ('.' annotation* NAME typeargs?)*
typeargs <- '<' (typearg (',' typearg)*)? '>'
typearg <- annotation* '?' (('extends' / 'super') type)? / type
block <- '{' statement* '}'
statement <- block / ';' / local ';' / ifstmt / forstmt / whilestmt / dostmt / trystmt / switch / 'synchronized' '(' expr ')' block / 'return' expr? ';' / ('break' / 'continue') NAME? ';' / 'throw' expr ';' / 'assert' expr (':' expr)? ';' / &'yield' NAME !'=' !'.' !'(' !'[' !'++' !'--' expr ';' / modifier* (class / interface / enum / record) / NAME ':' statement / expressionstmt
expressionstmt <- expr ';'
local <- ('final' / annotation)* type declarator (',' declarator)*
declarator <- NAME dims? ('=' (arrayinit / expr))?
arrayinit <- '{' ((arrayinit / expr) (',' (arrayinit / expr))*)? ','? '}'
ifstmt <- 'if' '(' expr ')' statement ('else' statement)?
forstmt <- 'for' '(' (('final' / annotation)* type NAME ':' expr / (local / exprs)? ';' expr? ';' exprs?) ')' statement
exprs <- expr (',' expr)*
whilestmt <- 'while' '(' expr ')' statement
dostmt <- 'do' statement 'while' '(' expr ')' ';'
trystmt <- 'try' ('(' resource (';' resource)* ';'? ')' block catch* finally? / block (catch+ finally? / finally))
resource <- local / expr
catch <- 'catch' '(' ('final' / annotation)* type ('|' type)* NAME ')' block
finally <- 'finally' block
switch <- 'switch' '(' expr ')' '{' case* '}'
case <- ('case' caselabel (',' caselabel)* / 'default') (':' statement* / '->' (block / 'throw' expr ';' / expr ';'))
caselabel <- 'default' / ('final' / annotation)* type (NAME / '(' (caselabel (',' caselabel)*)? ')') (&'when' NAME expr)? / ternary
expr <- lambda / ternary
lambda <- (NAME / '(' (lambdaparam (',' lambdaparam)*)? ')') '->' (block / expr)
lambdaparam <- ('final' / annotation)* type '...'? NAME dims? / NAME
ternary <- unary (binop (lambda / unary) / 'instanceof' 'final'? type (NAME / '(' (caselabel (',' caselabel)*)? ')')? / '?' expr ':' expr)*
binop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>=' / '>' '>=' / '==' / '!=' / '<=' / '>=' / '&&' / '||' / '<<' / '>' '>' '>' / '>' '>' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^'
unary <- ('+' / '-' / '!' / '~' / '++' / '--') unary / cast / postfix
cast <- '(' primitive dims? ')' unary / '(' type ('&' type)* ')' &(NAME / STR / NUM / CHAR / '(' / '!' / '~' / 'new' / 'this' / 'super' / 'switch' / 'true' / 'false' / 'null') (lambda / unary)
postfix <- primary suffix* ('++' / '--')*
suffix <- '.' (typeargs? NAME / 'new' creator / 'class' / 'this' / 'super') / '[' expr ']' / arguments / '::' typeargs? (NAME / 'new')
arguments <- '(' (expr (',' expr)*)? ')'
primary <- NUM / STR / CHAR / 'true' / 'false' / 'null' / 'this' / 'super' / '(' expr ')' / 'new' creator / switch / primitive dims? ('.' 'class' / '::' 'new') / 'void' '.' 'class' / classtype dims ('.' 'class' / '::' 'new') / classtype &'::' / NAME
creator <- annotation* (primitive / classtype) (('[' expr ']')+ dims? / dims arrayinit / arguments classbody?)
"""

GO = r"""
program <- ';'* EOF / 'package' NAME ';' (import ';')* (topdecl ';')* EOF
import <- 'import' (importspec / '(' (importspec (';' importspec)* ';'?)? ')')
importspec <- ('.' / NAME)? STR
topdecl <- function / declaration
declaration <- 'const' (constspec / '(' (constspec ';'?)* ')') / 'var' (varspec / '(' (varspec ';'?)* ')') / 'type' (typespec / '(' (typespec ';'?)* ')')
constspec <- names (type? '=' exprs)?
varspec <- names (type ('=' exprs)? / '=' exprs)
typespec <- NAME typeparams? '='? type
names <- NAME (',' NAME)*
typeparams <- '[' names constraint (',' names constraint)* ','? ']'
constraint <- '~'? type ('|' '~'? type)*
function <- 'func' params? NAME typeparams? signature block?
signature <- params result?
result <- params / type
params <- '(' (param (',' param)* ','?)? ')'
param <- NAME '...'? type / '...'? type
type <- NAME ('.' NAME)? typeargs? / '*' type / '[' ']' type / '[' ('...' / expr) ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' signature / struct / interface / '(' type ')'
typeargs <- '[' type (',' type)* ','? ']'
struct <- 'struct' '{' (field (';' field)* ';'?)? '}'
field <- (names type / '*'? NAME ('.' NAME)? typeargs?) STR?
interface <- 'interface' '{' (method (';' method)* ';'?)? '}'
method <- NAME signature / constraint
block <- '{' (statement? ';')* statement? '}'
statement <- declaration / block / ifstmt / forstmt / switchstmt / selectstmt / 'return' exprs? / ('break' / 'continue' / 'goto') NAME? / 'fallthrough' / ('go' / 'defer') expr / NAME ':' statement? / simple
simple <- exprs (assignop (exprs) / '++' / '--' / '<-' expr)?
assignop <- '=' / ':=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
csimple <- cexprs (assignop cexprs / '++' / '--' / '<-' cexpr)?
ifstmt <- 'if' (csimple? ';')? cexpr block ('else' (ifstmt / block))?
forstmt <- 'for' (block / range block / csimple? ';' cexpr? ';' csimple? block / cexpr block)
range <- (cexprs ('=' / ':='))? 'range' cexpr
switchstmt <- 'switch' (csimple? ';')? (typeguard / cexpr)? '{' (('case' switchexprs / 'default') ':' statements)* '}'
switchexprs <- (type / expr) !'(' (',' (type / expr))* / exprs
typeguard <- (NAME ':=')? cpostfix '.' '(' 'type' ')' / csimple
statements <- (!'case' !'default' statement? ';')* (!'case' !'default' statement)?
selectstmt <- 'select' '{' (('case' simple / 'default') ':' statements)* '}'
exprs <- expr (',' expr)*
cexprs <- cexpr (',' cexpr)*
expr <- unary (binop unary)*
cexpr <- cunary (binop cunary)*
binop <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&^' / '&'
unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-')* postfix
cunary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-')* cpostfix
postfix <- operand suffix*
cpostfix <- coperand suffix*
suffix <- '.' (NAME / '(' ('type' / type) ')') / '[' (expr? ':' expr? (':' expr)? / typeorexpr (',' typeorexpr)* ','?) ']' / '(' (typeorexpr (',' typeorexpr)* '...'? ','?)? ')'
typeorexpr <- expr !'{' / type
operand <- NUM / STR / CHAR / 'func' signature block / literaltype literal / NAME typeargs? literal / NAME '.' NAME typeargs? literal / conversion / NAME / '(' (expr / type) ')'
coperand <- NUM / STR / CHAR / 'func' signature block / literaltype literal / conversion / NAME / '(' (expr / type) ')'
literaltype <- '[' ('...' / expr)? ']' type / 'map' '[' type ']' type / struct
conversion <- ('[' expr? ']' type / 'map' '[' type ']' type / 'chan' type / 'func' signature / interface / struct) &('(')
literal <- '{' (entry (',' entry)* ','?)? '}'
entry <- (literal / expr) (':' (literal / expr))?
"""

_C_STATEMENTS = r"""
block <- '{' (statement)* '}'
ifstmt <- 'if' 'constexpr'? '(' condition ')' statement ('else' statement)?
whilestmt <- 'while' '(' condition ')' statement
dostmt <- 'do' statement 'while' '(' expr ')' ';'
switchstmt <- 'switch' '(' condition ')' statement
jump <- 'return' (expr / braces)? ';' / 'break' ';' / 'continue' ';' / 'goto' NAME ';'
label <- 'case' ternary ('...' ternary)? ':' / 'default' ':' / NAME ':' !':'
"""

C = (
    r"""
program <- external* EOF
external <- ';' / 'extern' STR (external / '{' external* '}') / '_Static_assert' '(' ternary (',' STR)? ')' ';' / function / declaration
function <- specs declarator declaration* block
declaration <- specs (init (',' init)*)? ';'
init <- declarator asm? attribute* ('=' (braces / assign))?
asm <- (&'__asm__' / &'asm') NAME '(' STR+ ')'
specs <- spec* (aggregate / builtin (spec / builtin)* / NAME) spec*
spec <- 'static' / 'extern' / 'typedef' / 'register' / 'auto' / 'inline' / 'const' / 'volatile' / 'restrict' / '_Noreturn' / '_Thread_local' / '_Atomic' / attribute / '_Alignas' '(' ternary ')'
attribute <- (&'__attribute__' / &'__declspec') NAME '(' balanced* ')' / '[' '[' balanced* ']' ']'
balanced <- '(' balanced* ')' / !'(' !')' !'[' !']' !EOF any
any <- NAME / KEYWORD / NUM / STR / CHAR / SIGN
builtin <- 'int' / 'char' / 'long' / 'short' / 'unsigned' / 'signed' / 'float' / 'double' / 'void' / '_Bool' / '_Complex'
aggregate <- ('struct' / 'union') attribute* (NAME? '{' field* '}' / NAME) / 'enum' (NAME? '{' (enumerator (',' enumerator)* ','?)? '}' / NAME)
field <- ';' / specs (fielddecl (',' fielddecl)*)? ';'
fielddecl <- declarator (':' ternary)? / ':' ternary
enumerator <- NAME ('=' ternary)?
declarator <- ('*' qualifier*)* attribute* (NAME / '(' declarator ')') declsuffix* attribute*
qualifier <- 'const' / 'volatile' / 'restrict' / '_Atomic'
declsuffix <- '[' ('static' / qualifier)* (assign / '*')? ']' / '(' params? ')'
params <- '...' / param (',' param)* (',' '...')?
param <- specs (declarator / abstract)?
abstract <- ('*' qualifier*)+ ('(' abstract ')')? abssuffix* / '(' abstract ')' abssuffix* / abssuffix+
abssuffix <- '[' (assign / '*')? ']' / '(' params? ')'
typename <- specs abstract?
statement <- block / ifstmt / whilestmt / dostmt / forstmt / switchstmt / jump / label statement? / ';' / typedlocal / expr ';' / declaration
typedlocal <- &(spec / builtin / 'struct' / 'union' / 'enum' / NAME '*'* NAME) declaration
condition <- expr
forstmt <- 'for' '(' (declaration / expr? ';') expr? ';' expr? ')' statement
"""
    + _C_STATEMENTS
    + r"""
braces <- '{' (initializer (',' initializer)* ','?)? '}'
initializer <- (('[' ternary ('...' ternary)? ']' / '.' NAME)+ '=')? (braces / assign)
expr <- assign (',' assign)*
assign <- unary (binop unary / '?' expr? ':' assign)*
ternary <- assign
binop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '==' / '!=' / '<=' / '>=' / '&&' / '||' / '<<' / '>>' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^'
unary <- ('++' / '--' / '+' / '-' / '!' / '~' / '*' / '&' / '&&') unary / ('sizeof' / '_Alignof') (unary / '(' typename ')') / cast / postfix
cast <- '(' &(spec / builtin / 'struct' / 'union' / 'enum') typename ')' (braces / unary) / '(' NAME '*'+ ')' unary / '(' NAME ')' &(NAME / NUM / STR / CHAR / 'sizeof' / '{') (braces / unary)
postfix <- primary suffix*
suffix <- '[' expr ']' / '(' (argument (',' argument)*)? ')' / ('.' / '->') NAME / '++' / '--'
argument <- assign / typename
primary <- STR (STR / NAME STR)* / NAME STR+ / NAME / NUM / CHAR+ / '(' block ')' / '(' expr ')' / '_Generic' '(' assign (',' ('default' / typename) ':' assign)+ ')'
"""
)

CPP = (
    r"""
program <- external* EOF
external <- ';' / 'extern' STR (external / '{' external* '}') / namespace / using / staticassert / template external / 'export'? function / special / declaration
namespace <- 'inline'? 'namespace' attribute* (NAME ('::' 'inline'? NAME)*)? ('{' external* '}' / '=' qualified ';')
using <- 'using' ('namespace' qualified / 'enum' qualified / NAME attribute* '=' typename / 'typename'? qualified (',' 'typename'? qualified)*) ';'
staticassert <- 'static_assert' '(' ternary (',' STR+)? ')' ';'
template <- 'template' ('<' (tparam (',' tparam)*)? '>')? requires?
tparam <- template? ('typename' / 'class') '...'? NAME? ('=' typename)? / param
requires <- &'requires' NAME unary (('&&' / '||') unary)*
function <- template? specs declarator trailer* functionbody
special <- (spec / 'explicit' ('(' ternary ')')?)* (qualified '::')? ('~'? NAME typeargs? ('::' '~'? NAME)? / conversion) '(' params? ')' trailer* (functionbody / ('=' ('default' / 'delete' / NUM))? ';')
conversion <- (NAME typeargs? '::')* 'operator' specs ptr*
functionbody <- ('try')? (':' meminit (',' meminit)*)? block ('catch' '(' (param / '...') ')' block)*
meminit <- qualified ('(' arguments? ')' / braces) '...'?
trailer <- 'const' / 'volatile' / '&&' / '&' / 'noexcept' ('(' ternary ')')? / 'throw' '(' balanced* ')' / '->' typename / &'override' NAME / &'final' NAME / requires / attribute
declaration <- specs (init (',' init)*)? ';' / 'auto' ('&&' / '&')? '[' NAME (',' NAME)* ']' ('=' assign / braces) ';'
init <- declarator trailer* ('=' ('default' / 'delete' / braces / assign) / braces / '(' arguments ')')?
specs <- spec* (aggregate / builtin (spec / builtin)* / 'auto' / 'decltype' '(' expr ')' / 'typename'? qualified) spec*
spec <- 'static' / 'extern' / 'typedef' / 'register' / 'inline' / 'const' / 'volatile' / 'constexpr' / 'consteval' / 'constinit' / 'virtual' / 'explicit' / 'friend' / 'mutable' / 'thread_local' / attribute / 'alignas' '(' (typename / ternary) ')'
attribute <- (&'__attribute__' / &'__declspec') NAME '(' balanced* ')' / '[' '[' balanced* ']' ']'
balanced <- '(' balanced* ')' / !'(' !')' !'[' !']' !EOF any
any <- NAME / KEYWORD / NUM / STR / CHAR / SIGN
builtin <- 'int' / 'char' / 'long' / 'short' / 'unsigned' / 'signed' / 'float' / 'double' / 'void' / 'bool' / 'wchar_t' / 'char8_t' / 'char16_t' / 'char32_t'
qualified <- '::'? segment ('::' 'template'? segment)*
segment <- ('~'? NAME / operatorname) typeargs?
operatorname <- 'operator' ('(' ')' / '[' ']' / 'new' ('[' ']')? / 'delete' ('[' ']')? / STR NAME / '->*' / '->' / '<=>' / '<<=' / '>' '>=' / '<<' / '>' '>' / '==' / '!=' / '<=' / '>=' / '&&' / '||' / '++' / '--' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '~' / '!' / '=' / '<' / '>' / ',')
typeargs <- '<' (typearg (',' typearg)*)? '>'
typearg <- typename '...'? &(',' / '>') / simpleunary (simplebin simpleunary)*
simplebin <- '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '&&' / '||' / '&' / '|' / '<<'
simpleunary <- unary
aggregate <- ('class' / 'struct' / 'union') attribute* (qualified? (&'final' NAME)? bases? '{' classmember* '}' / qualified) / 'enum' ('class' / 'struct')? (NAME? (':' specs)? '{' (enumerator (',' enumerator)* ','?)? '}' / NAME)
bases <- ':' base (',' base)*
base <- ('virtual' / 'public' / 'private' / 'protected')* qualified '...'?
classmember <- ';' / ('public' / 'private' / 'protected') ':' / using / staticassert / template classmember / function / special / 'friend' declaration / specs (fielddecl (',' fielddecl)*)? ';'
fielddecl <- declarator trailer* (':' ternary)? ('=' ('default' / 'delete' / braces / assign) / braces)? / ':' ternary
enumerator <- NAME ('=' ternary)?
ptr <- '*' qualifier* / '&&' / '&' / qualified '::' '*' qualifier*
qualifier <- 'const' / 'volatile'
declarator <- ptr* attribute* '...'? (qualified / '(' declarator ')') declsuffix*
declsuffix <- '[' ternary? ']' / '(' params? ')' &(trailer / '{' / ';' / ',' / '=' / ')' / ':' / '[' / '(' / 'try')
params <- '...' / param (',' param)* (','? '...')?
param <- attribute* specs (declarator / abstract)? ('=' (braces / assign))?
abstract <- ptr+ '...'? ('(' abstract ')')? abssuffix* / '...' / '(' abstract ')' abssuffix* / abssuffix+
abssuffix <- '[' ternary? ']' / '(' params? ')' trailer*
typename <- specs abstract?
statement <- block / ifstmt / whilestmt / dostmt / forstmt / switchstmt / trystmt / jump / 'co_return' expr? ';' / label statement? / ';' / using / staticassert / typedlocal / expr ';' / declaration
typedlocal <- &(spec / builtin / 'auto' / 'class' / 'struct' / 'union' / 'enum' / 'decltype' / 'typename' / qualified ptr* NAME) declaration
trystmt <- 'try' block ('catch' '(' ('...' / param) ')' block)+
condition <- (declaration / expr ';')? (specs declarator ('=' assign / braces) / expr)
forstmt <- 'for' '(' (declaration / expr? ';')? ((specs declarator / 'auto' ('&&' / '&')? '[' NAME (',' NAME)* ']' / 'const' 'auto' ('&&' / '&')? '[' NAME (',' NAME)* ']') ':' (braces / expr) / expr? ';' expr?) ')' statement
    / 'for' '(' (declaration / expr? ';') expr? ';' expr? ')' statement
"""
    + _C_STATEMENTS
    + r"""
braces <- '{' (initializer (',' initializer)* ','?)? '}'
initializer <- (('[' ternary ']' / '.' NAME)+ '=')? (braces / assign) '...'?
expr <- assign (',' assign)*
assign <- 'throw' assign? / 'co_yield' assign / unary (binop (braces / unary) / '?' expr? ':' assign)*
ternary <- assign
arguments <- (braces / assign) '...'? (',' (braces / assign) '...'?)*
binop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>=' / '==' / '!=' / '<=>' / '<=' / '>=' / '&&' / '||' / '<<' / '>' '>' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '.*' / '->*'
unary <- ('++' / '--' / '+' / '-' / '!' / '~' / '*' / '&' / '&&' / 'co_await') unary / 'sizeof' ('...' '(' NAME ')' / unary / '(' typename ')') / 'alignof' '(' typename ')' / 'noexcept' '(' expr ')' / new / '::'? 'delete' ('[' ']')? unary / cast / postfix
new <- '::'? 'new' ('(' arguments ')')? (specs ptr* ('[' expr ']')* / '(' typename ')') ('(' arguments? ')' / braces)?
cast <- '(' &(spec / builtin / 'struct' / 'class' / 'union' / 'enum' / 'decltype' / 'auto') typename ')' (braces / unary) / '(' qualified ptr+ ')' unary / '(' qualified ')' &(NAME / NUM / STR / CHAR / 'sizeof' / 'new' / 'this' / 'true' / 'false' / 'nullptr') unary
postfix <- primary suffix*
suffix <- '[' (braces / expr)? ']' / '(' arguments? ')' / ('.' / '->') 'template'? (qualified / '~' NAME) / '++' / '--'
primary <- lambda / STR (STR / NAME STR)* / NUM / CHAR / 'true' / 'false' / 'nullptr' / 'this' / ('static_cast' / 'dynamic_cast' / 'const_cast' / 'reinterpret_cast') '<' typename '>' '(' expr ')' / 'typeid' '(' (typename / expr) ')' / builtin+ ('(' arguments? ')' / braces) / 'auto' ('(' arguments ')' / braces) / 'typename' qualified ('(' arguments? ')' / braces) / templated / plain braces !block / plain / '(' fold ')' / '(' block ')' / '(' expr ')'
templated <- qualified &('(' / '{' / ')' / ';' / ',' / '::' / '>' / '}' / '.') (braces)?
plain <- '::'? (NAME / operatorname) ('::' '~'? (NAME / operatorname))*
fold <- '...' binop unary / unary binop '...' (binop unary)?
lambda <- '[' capture* ']' ('<' tparam (',' tparam)* '>')? ('(' params? ')')? ('mutable' / 'constexpr' / trailer)* block
capture <- ('&' / '=' / '*')? (NAME / 'this')? ('=' assign / braces)? '...'? ','  / '&' NAME? ('=' assign)? '...'? / '=' / '*'? 'this' / NAME ('=' assign / braces)? '...'?
"""
)

GRAMMARS = {"python": PYTHON, "javascript": JAVASCRIPT, "java": JAVA, "go": GO, "c": C, "cpp": CPP}
