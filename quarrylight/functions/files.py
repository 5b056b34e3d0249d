"""What a file is: its language by name, whether it is binary, secret or to be ignored. Column builders, all inside the JVM."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file name, by double ending and by ending. Each line: category, language, names or endings.
BY_NAME = """
source Dockerfile: dockerfile containerfile
source Makefile: makefile gnumakefile
source Ruby: gemfile rakefile vagrantfile
source Groovy: jenkinsfile
configuration Configuration: procfile
configuration CMake: cmakelists.txt
documentation Text: license licence copying readme authors contributing changelog
"""
BY_DOUBLE_ENDING = """
source TypeScript: .d.ts .d.mts .d.cts .test.ts .test.tsx .spec.ts .spec.tsx
source JavaScript: .test.js .test.jsx .spec.js .spec.jsx
source PHP: .blade.php
other Archive: .tar.gz .tar.bz2 .tar.xz
"""
BY_ENDING = """
source Python: .py .pyw .pyi
source JavaScript: .js .mjs .cjs .jsx
source TypeScript: .ts .mts .cts .tsx
source Java: .java
source C: .c .h
source C++: .cpp .cc .cxx .hpp .hh .hxx
source C#: .cs
source Go: .go
source Rust: .rs
source Ruby: .rb
source PHP: .php
source Kotlin: .kt .kts
source Swift: .swift
source Dart: .dart
source Scala: .scala .sc
source Shell: .sh .bash .zsh
source PowerShell: .ps1 .psm1 .psd1
source SQL: .sql
source HTML: .html .htm
source CSS: .css
source SCSS: .scss
source Sass: .sass
source Less: .less
source Vue: .vue
source Svelte: .svelte
source Lua: .lua
source R: .r
source Perl: .pl .pm
source Elixir: .ex .exs
source Erlang: .erl .hrl
source Clojure: .clj .cljs
source Haskell: .hs .lhs
source Protocol Buffer: .proto
source GraphQL: .graphql .gql
configuration JSON: .json .json5 .jsonc
configuration YAML: .yaml .yml
configuration TOML: .toml
configuration XML: .xml
configuration INI: .ini
configuration Config: .cfg .conf
configuration Properties: .properties
configuration EditorConfig: .editorconfig
configuration Git Attributes: .gitattributes
documentation Markdown: .md .markdown .mdown
documentation reStructuredText: .rst
documentation AsciiDoc: .adoc
documentation Plain Text: .txt
documentation PDF: .pdf
data CSV: .csv
data TSV: .tsv
data Parquet: .parquet
data SQLite: .sqlite
data Database: .db
other PNG Image: .png
other JPEG Image: .jpg .jpeg
other GIF Image: .gif
other SVG Image: .svg
other Icon: .ico
other Font: .woff .woff2 .ttf .eot
other Zip Archive: .zip
other Gzip Archive: .gz
other Tar Archive: .tar
other Executable: .exe
other Library: .dll .so .dylib
other Python Bytecode: .pyc
other WebAssembly: .wasm
"""
# Endings that say binary, directories that are passed over, names that hold secrets.
BINARY_ENDINGS = (
    ".png .jpg .jpeg .gif .ico .webp .bmp .tiff .pdf .zip .tar .gz .bz2 .xz .7z .rar .exe .dll .so .dylib .bin .o .a .lib .class .pyc .pyo .wasm "
    ".woff .woff2 .ttf .eot .otf .mp3 .mp4 .avi .mov .flv .wav .sqlite .db .parquet"
).split()
IGNORED_DIRECTORIES = (
    ".git .hg .svn node_modules .venv venv env __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox dist build coverage .next .nuxt vendor .idea .vscode .turbo .serverless target bin obj "
    ".gemini .antigravity"
).split()
SECRET_NAMES = ".env .env.* *.pem *.key *.p12 *.pfx *.pkcs12 id_rsa id_ed25519 id_dsa id_ecdsa credentials.json client_secrets*.json service_account*.json *.keystore *.jks".split()
#: Bytes of a file that are looked at, and the share of other than text characters among them that makes it binary.
SAMPLE_BYTES, MOST_ODD = 8192, 0.30


def entries(lines: str) -> list[tuple[str, str, str]]:
    """(name or ending, category, language) of each entry."""
    found = []
    for line in lines.strip().splitlines():
        said, _, names = line.partition(":")
        category, _, language = said.partition(" ")
        found += [(n, category, language) for n in names.split()]
    return found


def _told(category: str, language: str) -> Column:
    return F.struct(F.lit(language).alias("language"), F.lit(category).alias("category"), F.lit(category == "source").alias("is_source"))


def _lookup(lines: str) -> Column:
    return F.create_map(*[x for name, category, language in entries(lines) for x in (F.lit(name), _told(category, language))])


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def ending(path: Column) -> Column:
    """The name's last dot and what follows, lower-cased; empty if the name starts with its only dot or ends with it."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """struct(language, category, is_source) by the whole name, else a double ending, else the ending."""
    name = F.lower(file_name(path))
    double = F.coalesce(*[F.when(name.endswith(e), _told(c, x)) for e, c, x in entries(BY_DOUBLE_ENDING)])
    return F.coalesce(F.try_element_at(_lookup(BY_NAME), name), double, F.try_element_at(_lookup(BY_ENDING), ending(path)), _told("other", "Unknown"))


def known_binary(path: Column) -> Column:
    return ending(path).isin(*BINARY_ENDINGS)


def binary_content(content: Column) -> Column:
    """Whether the first bytes hold a NUL, or more than three in ten that are no plain text character."""
    head = F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")
    odd = F.regexp_count(head, F.lit(r"[^\x20-\x7e\n\r\t\x08]"))
    return F.when(F.length(head) == 0, F.lit(False)).otherwise(F.contains(head, F.lit("\0")) | (odd / F.length(head) > MOST_ODD))


def ignored(path: Column) -> Column:
    """Whether the file stands under a directory that is passed over."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))


def secret(path: Column) -> Column:
    """Whether the file's name is one that holds keys or credentials."""
    name = F.lower(file_name(path))
    return reduce(lambda a, b: a | b, [name.rlike(whole(p)) for p in SECRET_NAMES])


def whole(pattern: str) -> str:
    """A shell pattern as a Java expression for the whole text."""
    body = fnmatch.translate(pattern)
    body = body.removesuffix("\\Z").removesuffix("\\z")
    return f"^{body}\\z"
