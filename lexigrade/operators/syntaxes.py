"""Comment syntax of the languages that the scanner knows, as plain data.

Fixed values: comment openers, string quotes, doc prefixes and directive patterns.  A
string is (open, close, escape, doubled, multiline); a block is (open, close, nested).
"""

from __future__ import annotations

from dataclasses import dataclass

C_BLOCK, C_NESTED = ("/*", "*/", False), ("/*", "*/", True)
DOUBLE, SINGLE = ('"', '"', "\\", False, False), ("'", "'", "\\", False, False)
TRIPLE_DOUBLE, TRIPLE_SINGLE = ('"""', '"""', "\\", False, True), ("'''", "'''", "\\", False, True)
BACKTICK = ("`", "`", "\\", False, True)


@dataclass(frozen=True)
class Syntax:
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str, bool], ...] = ()
    strings: tuple[tuple[str, str, str, bool, bool], ...] = ()
    doc: tuple[str, ...] = ()
    directive: str | None = None
    after_space: bool = False
    declaration: str | None = None


_C = dict(line=("//",), block=(C_BLOCK,), strings=(DOUBLE, SINGLE))
_JS = Syntax(("//",), (C_BLOCK,), (BACKTICK, DOUBLE, SINGLE), ("/**",), r"\s*(?:eslint(?:-disable|-enable|-env)?\b|globals?\s|jshint\b|jslint\b|prettier-ignore\b|@ts-(?:ignore|expect-error|nocheck|check)\b|(?:istanbul|c8|v8) ignore\b|oxlint-(?:disable|enable)\b|biome-ignore\b|@jsx(?:ImportSource|Runtime|Frag)?\b|@flow\b|#(?:end)?region\b|<(?:reference|amd-module|amd-dependency)\b|webpack[A-Z]|@vite-ignore\b|[@#]__(?:PURE|NO_SIDE_EFFECTS)__)", declaration=r"\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)|\s*(?:(?:public|private|protected|static|readonly|async|get|set)\s+)*([A-Za-z_$][\w$]*)\s*(?:\(|[?!]?:|=)")
_CPP = r"(?i)\s*(?:NOLINT\w*|clang-format\s+(?:off|on)\b|cppcheck-suppress\b|LCOV_EXCL_\w+|IWYU pragma:|fall ?through\b|FALLTHROUGH\b|coverity\[)"
_HASH = dict(line=("#",))
_MARKUP = Syntax(block=(("<!--", "-->", False),), directive=r"\s*(?:prettier-ignore\b|htmlhint\b|#(?:end)?region\b)")
_TYPED = r"\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|partial|readonly|const|inline|extern|unsigned|struct)\s+)*(?:(?:class|interface|enum|struct|record|namespace)\s+([A-Za-z_]\w*)|[\w<>\[\],.:*& ]+?[\s*&]([A-Za-z_~]\w*)\s*(?:\(|=|;|\{))"
_OBJC = Syntax(**_C, doc=("///", "/**"), directive=r"\s*(?:NOLINT\w*|clang-format\s+(?:off|on)\b)")
_SASS = Syntax(**_C, doc=("///",), directive=r"\s*(?:stylelint-(?:disable|enable)\S*|prettier-ignore\b)")

SYNTAXES: dict[str, Syntax] = {
    "javascript": _JS,
    "javascriptreact": _JS,
    "typescript": _JS,
    "typescriptreact": _JS,
    "python": Syntax(("#",), (), (TRIPLE_DOUBLE, TRIPLE_SINGLE, DOUBLE, SINGLE), (), r"\s*(?:noqa\b|type:|pylint:|pyright:|mypy:|pragma:|fmt:\s*(?:off|on|skip)\b|isort:|ruff:|-\*-|(?:vim?|ex):)", declaration=r"\s*(?:async\s+)?(?:def|class)\s+(\w+)|\s*(\w+)\s*(?::[^=]*)?="),
    "go": Syntax(("//",), (C_BLOCK,), (BACKTICK, DOUBLE, SINGLE), (), r"\s*(?:go:\w|\+build\b|nolint\b|lint:(?:ignore|file-ignore)\b|export\s|line\s|extern\s|#cgo\b|Code generated .* DO NOT EDIT\.)", declaration=r"\s*(?:func\s+(?:\([^)]*\)\s*)?(\w+)|(?:type|var|const|package)\s+(\w+)|(\w+)\s)"),
    "rust": Syntax(("//",), (C_NESTED,), (DOUBLE,), ("///", "//!", "/**", "/*!"), r"\s*(?:@generated\b|rustfmt::skip\b)", declaration=r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|mod|type|static|const|union|macro_rules!)\s+(\w+)|\s*(?:pub\s+)?(\w+)\s*[:,({]"),
    "java": Syntax(("//",), (C_BLOCK,), (TRIPLE_DOUBLE, DOUBLE, SINGLE), ("/**",), r"\s*(?:noinspection\b|CHECKSTYLE[:.]|@formatter:(?:off|on)\b|NOSONAR\b|NOPMD\b|spotless:(?:off|on)\b|language=)", declaration=_TYPED),
    "c": Syntax(**_C, doc=("///", "//!", "/**", "/*!"), directive=_CPP, declaration=_TYPED),
    "cpp": Syntax(**_C, doc=("///", "//!", "/**", "/*!"), directive=_CPP, declaration=_TYPED),
    "csharp": Syntax(**_C, doc=("///", "/**"), directive=r"\s*(?:ReSharper\s+(?:disable|restore)\b|<auto-generated\b|csharpier-ignore\b|dotcover\s+(?:disable|enable)\b)", declaration=_TYPED),
    "ruby": Syntax(("#",), (("=begin", "=end", False),), (DOUBLE, SINGLE), (), r"\s*(?:frozen_string_literal:|(?:en)?coding:|warn_indent:|shareable_constant_value:|rubocop:(?:disable|enable|todo)\b|standard:(?:disable|enable)\b|typed:|:nodoc:|steep:ignore\b|-\*-)", declaration=r"\s*(?:def\s+(?:self\.)?([\w?!]+)|(?:class|module)\s+(\w+))"),
    "php": Syntax(("//", "#"), (C_BLOCK,), (DOUBLE, SINGLE), ("/**",), r"\s*(?:phpcs:\w+|@phpstan-ignore\S*|@psalm-suppress\b|@codeCoverageIgnore\S*|@noinspection\b|@var\b)", declaration=r"\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:function\s+&?(\w+)|(?:class|interface|trait)\s+(\w+)|\$(\w+))"),
    "shellscript": Syntax(("#",), (), (DOUBLE, ("'", "'", "", False, True)), (), r"\s*(?:shellcheck\s|-\*-|(?:vim?|ex):)", after_space=True, declaration=r"\s*(?:function\s+)?([\w-]+)\s*\(\)"),
    "css": Syntax((), (C_BLOCK,), (DOUBLE, SINGLE), (), r"\s*(?:stylelint-(?:disable|enable)\S*|prettier-ignore\b|autoprefixer:\s*(?:off|on|ignore next)\b|purgecss\s|#(?:end)?region\b|rtl:)"),
    "kotlin": Syntax(("//",), (C_NESTED,), (('"""', '"""', "", False, True), DOUBLE, SINGLE), ("/**",), r"\s*(?:noinspection\b|@formatter:(?:off|on)\b|ktlint-(?:disable|enable)\b)"),
    "swift": Syntax(("//",), (C_NESTED,), (TRIPLE_DOUBLE, DOUBLE), ("///", "/**"), r"\s*swiftlint:"),
    "objective-c": _OBJC,
    "objective-cpp": _OBJC,
    "dart": Syntax(("//",), (C_NESTED,), (TRIPLE_DOUBLE, TRIPLE_SINGLE, DOUBLE, SINGLE), ("///", "/**"), r"\s*ignore(?:_for_file)?:"),
    "scala": Syntax(("//",), (C_NESTED,), (TRIPLE_DOUBLE, DOUBLE, SINGLE), ("/**",)),
    "groovy": Syntax(("//",), (C_BLOCK,), (TRIPLE_DOUBLE, TRIPLE_SINGLE, DOUBLE, SINGLE), ("/**",)),
    "fsharp": Syntax(("//",), (("(*", "*)", True),), (TRIPLE_DOUBLE, DOUBLE), ("///",)),
    "lua": Syntax(("--",), (("--[[", "]]", False),), (("[[", "]]", "", False, True), DOUBLE, SINGLE), ("---",), r"\s*(?:luacheck:|@diagnostic\b)"),
    "sql": Syntax(("--",), (C_BLOCK,), (("'", "'", "", True, True), ('"', '"', "", True, False))),
    "yaml": Syntax(**_HASH, strings=(DOUBLE, ("'", "'", "", True, False)), directive=r"\s*(?:yaml-language-server:|yamllint\s+(?:disable|enable)|prettier-ignore\b)", after_space=True),
    "scss": _SASS,
    "less": Syntax(**_C, directive=_SASS.directive),
    "html": _MARKUP,
    "xml": _MARKUP,
    "elixir": Syntax(**_HASH, strings=(TRIPLE_DOUBLE, TRIPLE_SINGLE, ('"', '"', "\\", False, True), SINGLE), directive=r"\s*credo:"),
    "haskell": Syntax(("--",), (("{-", "-}", True),), (DOUBLE,), ("-- |", "-- ^", "{-|"), r"#"),
    "erlang": Syntax(("%",), (), (DOUBLE,)),
    "clojure": Syntax((";",), (), (DOUBLE,)),
    "r": Syntax(**_HASH, strings=(DOUBLE, SINGLE), doc=("#'",)),
    "julia": Syntax(**_HASH, block=(("#=", "=#", True),), strings=(TRIPLE_DOUBLE, DOUBLE)),
    "perl": Syntax(**_HASH, strings=(DOUBLE, SINGLE)),
    "powershell": Syntax(**_HASH, block=(("<#", "#>", False),), strings=(('"', '"', "`", False, False), ("'", "'", "", True, False)), directive=r"\s*(?i:requires)\b"),
    "dockerfile": Syntax(**_HASH, strings=(DOUBLE, SINGLE), directive=r"\s*(?:syntax|escape|check)=", after_space=True),
    "makefile": Syntax(**_HASH),
    "toml": Syntax(**_HASH, strings=(TRIPLE_DOUBLE, ("'''", "'''", "", False, True), DOUBLE, ("'", "'", "", False, False)), directive=r"\s*:schema\b"),
    "ini": Syntax((";", "#"), after_space=True),
}
