"""Tokens of source texts, as far as the grammars of :mod:`coppice.llm.grammars` need them."""

from __future__ import annotations

import re

from coppice.llm.packrat import Tokens

_NUMBER = r"(?:0[xX][0-9a-fA-F_']*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bBoO][0-9_']+|(?:[0-9][0-9_']*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)[A-Za-z0-9_]*"
_NAME = r"[^\W\d]\w*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_BLOCK = r"/\*[\s\S]*?\*/"


def _signs(text: str) -> str:
    return "|".join(re.escape(s) for s in sorted(text.split(), key=lambda s: -len(s)))


# The keywords (which are not names) and the signs of the languages.
KEYWORDS = {
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local",
    "cpp": "alignas alignof asm auto bool break case catch char char8_t char16_t char32_t class const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
}
SIGNS = {
    "c": "... <<= >>= -> ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= ( ) [ ] { } ; , . & * + - ~ ! / % < > ^ | ? : = #",
    "cpp": "... <<= ->* .* :: -> ++ -- << <= >= == != && || += -= *= /= %= &= |= ^= <=> ( ) [ ] { } ; , . & * + - ~ ! / % < > ^ | ? : = #",
    "java": "... <<= -> ++ -- << <= >= == != && || += -= *= /= %= &= |= ^= :: ( ) [ ] { } ; , . & * + - ~ ! / % < > ^ | ? : = @",
    "javascript": "... >>>= === !== **= <<= >>= >>> &&= ||= ??= => ?. ?? ** ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= ( ) [ ] { } ; , . & * + - ~ ! / % < > ^ | ? : = # @",
    "go": "... <<= >>= &^= <- := &^ ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= ( ) [ ] { } ; , . & * + - ! / % < > ^ | : = ~",
    "python": "... **= //= <<= >>= -> := ** // << >> <= >= == != += -= *= /= %= &= |= ^= @= ( ) [ ] { } ; , . & * + - ~ / % < > ^ | : = @",
}
_STRINGS = {
    "c": rf"(?P<STR>(?:u8|[uUL])?{_DQ})|(?P<CHAR>[uUL]?{_SQ})",
    "cpp": rf'(?P<STR>(?:u8|[uUL])?R"(?P<d>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=d)"|(?:u8|[uUL])?{_DQ})|(?P<CHAR>(?:u8|[uUL])?{_SQ})',
    "java": rf'(?P<STR>"""[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?"""|{_DQ})|(?P<CHAR>{_SQ})',
    "javascript": rf"(?P<STR>{_DQ}|{_SQ})|(?P<TEMPLATE>`(?:[^`\\]|\\[\s\S])*`)",
    "go": rf"(?P<STR>{_DQ}|`[^`]*`)|(?P<CHAR>{_SQ})",
}
#: A text token's mark in place of its content.
_MARK = '"'


def _pattern(lang: str) -> re.Pattern:
    skip = rf"(?P<SKIP>\\\r?\n|//[^\n]*|{_BLOCK})"
    name = r"(?P<NAME>(?:[^\W\d]|\$)[\w$]*)" if lang in ("java", "javascript") else rf"(?P<NAME>{_NAME})"
    # an unclosed comment is an error of its own
    return re.compile(rf"[ \t\f\v\r\ufeff\u00a0]*(?:(?P<NL>\n)|{skip}|(?P<OPEN>/\*)|{_STRINGS[lang]}|(?P<NUM>{_NUMBER})|{name}|(?P<SIGN>{_signs(SIGNS[lang])})|(?P<END>\Z))")


_patterns: dict[str, re.Pattern] = {}
_SPACE = re.compile(r"[ \t\f\v\r\ufeff\u00a0]*")
_keywords = {lang: frozenset(words.split()) for lang, words in KEYWORDS.items()}
#: After these a slash begins a regular expression in JavaScript.
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)(?:[^\n\\/\"']|\\\r?\n|\\.|//[^\n]*|/\*[\s\S]*?\*/|/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[\"'])*")


def tokens(text: str, lang: str) -> Tokens:
    """The tokens of a text in a language; what is no token becomes one of kind ERROR."""
    return _python(text) if lang == "python" else _braces(text, lang)


def _braces(text: str, lang: str) -> Tokens:
    if lang not in _patterns:
        _patterns[lang] = _pattern(lang)
    match, words = _patterns[lang].match, _keywords[lang]
    out = Tokens()
    kinds, texts, places, breaks = out.kinds, out.texts, out.at, out.nl
    at, n, nl = 0, len(text), True
    go, script, directives = lang == "go", lang == "javascript", lang in ("c", "cpp")
    open_ifs = 0
    if script and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    ends = ("NAME", "NUM", "STR", "CHAR")
    while at < n:
        if directives and nl:
            d = _DIRECTIVE.match(text, at)
            if d:
                word = d[1]
                if word in ("if", "ifdef", "ifndef"):
                    open_ifs += 1
                elif word == "endif":
                    open_ifs -= 1
                need = _NEEDED.get(word)
                if open_ifs < 0 or (word and word not in _DIRECTIVES) or (need and not need.match(text, d.end(1))):
                    out.add("ERROR", "#", at, True)
                    open_ifs = max(open_ifs, 0)
                at = d.end()
                nl = False
                continue
        m = match(text, at)
        if not m:
            # an unclosed string or a strange character
            at = _SPACE.match(text, at).end()
            out.add("ERROR", text[at], at, nl)
            at += 1
            nl = False
            continue
        kind = m.lastgroup
        if kind == "d":
            kind = "STR"
        start, at = m.start(kind), m.end()
        if kind == "NAME" or (kind == "SIGN" and not script):
            word = m[kind]
            kinds.append("KEYWORD" if kind == "NAME" and word in words else kind)
            texts.append(word)
            places.append(start)
            breaks.append(nl)
            nl = False
            continue
        if kind == "END":
            break
        if kind == "NL":
            if go and kinds and not nl and (kinds[-1] in ends or texts[-1] in _GO_ENDS):
                out.add("SIGN", ";", start, False)
            nl = True
            continue
        if kind == "SKIP":
            if text.startswith("/*", start) and "\n" in m[kind]:
                if go and kinds and not nl and (kinds[-1] in ends or texts[-1] in _GO_ENDS):
                    out.add("SIGN", ";", start, False)
                nl = True
            continue
        if kind == "OPEN":
            out.add("ERROR", "/*", start, nl)
            break
        if script and kind == "SIGN" and text[start] == "/" and (not kinds or not (kinds[-1] in ("NAME", "NUM", "STR", "TEMPLATE", "REGEX") or texts[-1] in (")", "]", "}", "this", "super", "null", "true", "false"))):
            r = _REGEX.match(text, start)
            if r:
                kinds.append("REGEX")
                texts.append(_MARK)
                places.append(start)
                breaks.append(nl)
                at, nl = r.end(), False
                continue
        kinds.append(kind)
        texts.append(m[kind] if kind == "SIGN" else _MARK)
        places.append(start)
        breaks.append(nl)
        nl = False
    if go and kinds and not nl and (kinds[-1] in ends or texts[-1] in _GO_ENDS):
        out.add("SIGN", ";", n, False)
    if open_ifs:
        out.add("ERROR", "#", n, True)
    return out


_GO_ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
_WORD_NEXT, _ANY_NEXT = re.compile(r"(?:[ \t]|\\\r?\n|/\*[\s\S]*?\*/)*[A-Za-z_$]"), re.compile(r"(?:[ \t]|\\\r?\n|/\*[\s\S]*?\*/)*(?!//)[^\s]")
_HEADER_NEXT = re.compile(r"(?:[ \t]|\\\r?\n|/\*[\s\S]*?\*/)*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_$])")
#: What must follow a directive's name.
_NEEDED = {"include": _HEADER_NEXT, "include_next": _HEADER_NEXT, "define": _WORD_NEXT, "undef": _WORD_NEXT, "ifdef": _WORD_NEXT, "ifndef": _WORD_NEXT, "if": _ANY_NEXT, "elif": _ANY_NEXT}
_DIRECTIVES = frozenset("include include_next import define undef if ifdef ifndef elif elifdef elifndef else endif line error warning pragma ident assert unassert embed sccs".split())

_PY = re.compile(
    r"[ \t\f]*(?:(?P<NL>\r?\n|\r)|(?P<SKIP>\\\r?\n|\#[^\r\n]*)"
    r"|(?P<STR>(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|(?!\"\"\"|''')(?:\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')))"
    r"|(?P<NUM>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)(?P<stuck>[^\W\d]\w*)?"
    rf"|(?P<NAME>{_NAME})|(?P<SIGN>{_signs(SIGNS['python'])}|!=)|(?P<END>\Z))"
)
_INDENT = re.compile(r"[ \t\f]*")
_OPENING, _CLOSING = frozenset("([{"), {")": "(", "]": "[", "}": "{"}
_LEADING_ZERO = re.compile(r"0[0-9_]*[1-9][0-9_]*")
#: Keywords that may follow a number without a space.
_NUMBER_NEXT = frozenset("and else for if in is not or".split())


def _python(text: str) -> Tokens:
    out = Tokens()
    at, n = (1 if text.startswith("﻿") else 0), len(text)
    stack, levels, fresh = [], [0], True
    words = _keywords["python"]
    kinds, texts, places, breaks, match = out.kinds, out.texts, out.at, out.nl, _PY.match
    while True:
        if fresh and not stack:
            m = _INDENT.match(text, at)
            end = m.end()
            nxt = text[end : end + 1]
            if nxt == "" and end >= n:
                break
            if nxt in ("\n", "\r", "#") or (nxt == "\\" and text[end + 1 : end + 2] in ("\n", "\r")):
                # a blank line, or one with a comment only, has no indent
                e = text.find("\n", end)
                at = n if e < 0 else e + 1
                continue
            width = 0
            for ch in m[0]:
                width = 0 if ch == "\f" else width + (8 - width % 8 if ch == "\t" else 1)
            if width > levels[-1]:
                levels.append(width)
                out.add("INDENT", "", end, True)
            while width < levels[-1]:
                levels.pop()
                out.add("DEDENT", "", end, True)
            if width != levels[-1]:
                out.add("ERROR", "indent", end, True)
                levels[-1] = max(levels[-1], 0)
                levels.append(width)
            at, fresh = end, False
        if at >= n:
            break
        m = match(text, at)
        if not m:
            at = _INDENT.match(text, at).end()
            out.add("ERROR", text[at], at, False)
            at += 1
            continue
        kind = m.lastgroup
        if kind == "stuck":
            kind = "NUM"
        start, at = m.start(kind), m.end()
        if kind == "END":
            break
        if kind == "NL":
            if not stack:
                out.add("NEWLINE", "", start, False)
                fresh = True
            continue
        if kind == "SKIP":
            continue
        word = m[kind]
        if kind == "NAME":
            kind = "KEYWORD" if word in words else "NAME"
        elif kind == "SIGN":
            if word in _OPENING:
                stack.append(word)
            elif word in _CLOSING:
                if not stack or stack.pop() != _CLOSING[word]:
                    out.add("ERROR", word, start, False)
                    stack.clear()
                    continue
        elif kind == "NUM":
            if m["stuck"]:
                if not any(m["stuck"].startswith(w) for w in _NUMBER_NEXT):
                    out.add("ERROR", "number", start, False)
                at -= len(m["stuck"])
            elif word[0] == "0" and _LEADING_ZERO.fullmatch(word):
                out.add("ERROR", "number", start, False)
            word = _MARK
        else:
            word = _MARK
        kinds.append(kind)
        texts.append(word)
        places.append(start)
        breaks.append(False)
    if stack:
        out.add("ERROR", "end", n, False)
    if out.kinds and out.kinds[-1] not in ("NEWLINE", "DEDENT", "INDENT"):
        out.add("NEWLINE", "", n, False)
    for _ in levels[1:]:
        out.add("DEDENT", "", n, True)
    return out
