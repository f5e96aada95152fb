"""Programming languages: aliases and file extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, aliases and extensions of the languages that have a grammar.
ALIASES: dict[str, tuple[str, ...]] = {
    "c": (),
    "cpp": ("c++",),
    "css": (),
    "c-sharp": ("csharp", "c#"),
    "haskell": (),
    "html": ("xhtml",),
    "go": ("golang",),
    "java": (),
    "javascript": ("js", "node"),
    "julia": (),
    "ocaml": (),
    "php": (),
    "python": ("rusthon", "python3", "python2"),
    "ruby": ("jruby", "macruby", "rake", "rb", "rbx"),
    "rust": (),
    "scala": (),
    "typescript": ("ts",),
}
EXTENSIONS: dict[str, tuple[str, ...]] = {
    "c": (".c", ".cats", ".h", ".idc"),
    "cpp": (".cpp", ".c++", ".cc", ".cp", ".cxx", ".h", ".h++", ".hh", ".hpp", ".hxx", ".inc", ".inl", ".ino", ".ipp", ".re", ".tcc", ".tpp"),
    "css": (".css",),
    "c-sharp": (".cs", ".cake", ".cshtml", ".csx"),
    "haskell": (".hs", ".hsc"),
    "html": (".html", ".htm", ".html.hl", ".inc", ".st", ".xht", ".xhtml"),
    "go": (".go",),
    "java": (".java",),
    "javascript": (".js", "._js", ".bones", ".es", ".es6", ".frag", ".gs", ".jake", ".jsb", ".jscad", ".jsfl", ".jsm", ".jss", ".mjs", ".njs", ".pac", ".sjs", ".ssjs", ".xsjs", ".xsjslib"),
    "julia": (".jl",),
    "ocaml": (".ml", ".eliom", ".eliomi", ".ml4", ".mli", ".mll", ".mly"),
    "php": (".php", ".aw", ".ctp", ".fcgi", ".inc", ".php3", ".php4", ".php5", ".phps", ".phpt"),
    "python": (".py", ".bzl", ".cgi", ".fcgi", ".gyp", ".gypi", ".lmi", ".py3", ".pyde", ".pyi", ".pyp", ".pyt", ".pyw", ".rpy", ".spec", ".tac", ".wsgi", ".xpy"),
    "ruby": (".rb", ".builder", ".eye", ".fcgi", ".gemspec", ".god", ".jbuilder", ".mspec", ".pluginspec", ".podspec", ".rabl", ".rake", ".rbuild", ".rbw", ".rbx", ".ru", ".ruby", ".spec", ".thor", ".watchr"),
    "rust": (".rs", ".rs.in"),
    "scala": (".scala", ".kojo", ".sbt", ".sc"),
    "typescript": (".ts", ".tsx"),
}

# Further spellings that occur in data but not in the table above.
SPELLINGS: dict[str, str] = {"py": "python", "cplusplus": "cpp", "cxx": "cpp", "cc": "cpp", "cs": "c-sharp", "ecmascript": "javascript", "nodejs": "javascript", "node.js": "javascript"}

ALIAS_OF = {name: lang for lang, more in ALIASES.items() for name in (lang, *more)}
#: Extension to its only language; extensions of several languages are missing here.
ONLY_LANGUAGE = {e: owners[0] for e in {x for s in EXTENSIONS.values() for x in s} if len(owners := [lang for lang, s in EXTENSIONS.items() if e in s]) == 1}


def _chain(c: Column, table: dict[str, str]) -> Column:
    """A lookup in a small fixed table, inside the generated code."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), c)


def language_identifier(c: Column, spellings: bool = False) -> Column:
    """The identifier of a language's name or alias, whatever its case; an unknown name stays as it
    is, null stays null. ``spellings``: also know :data:`SPELLINGS`, and disregard padding."""
    name = F.trim(c) if spellings else c
    table = ALIAS_OF | SPELLINGS if spellings else ALIAS_OF
    return F.coalesce(_chain(name, table), _chain(F.lower(name), table), F.lower(name) if spellings else name)


def extension(path: Column) -> Column:
    """The last extension of a path, with its dot; empty where there is none."""
    return F.regexp_extract(path, r"[^/]\.[^./]*$", 0).substr(F.lit(2), F.length(path))


def extension_language(path: Column) -> Column:
    """The language of a path's extension where it has only one."""
    return _chain(F.lower(extension(path)), ONLY_LANGUAGE)
