"""Column builders for tokens, stems, hashes, paths and redaction. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an attempt to instruct the reader of retrieved text, and what replaces it.
INJECTIONS = (
    r"ignore\s+(all\s+)?(previous|above)\s+instructions?",
    r"disregard\s+(all\s+)?(previous|above)\s+instructions?",
    r"system\s+prompt\s*:\s*",
    r"you\s+are\s+now\s+a\s+",
    r"reveal\s+(the\s+)?(api[_\s-]?key|secret|password|credential|env|token)",
    r"printenv|env\s*=\s*",
    r"<\s*/?\s*system\s*>",
)
REDACTED = "[REDACTED_INJECTION_ATTEMPT]"
# What a word of code is, and the parts of one in camel case.
CODE_WORD = r"[A-Za-z0-9_]+"
CAMEL_PART = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|\d+"


def words(text: Column) -> Column:
    """Lower-case ASCII words with digits and underscores, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0))


def stems(word: Column) -> Column:
    """The root forms that a lower-case word of five letters or more also stands for."""
    cut = lambda n: F.substring(word, 1, F.length(word) - n)
    none = F.array().cast("array<string>")
    return (
        F.when(F.length(word) <= 4, none)
        .when(word.endswith("ation"), F.array(cut(F.lit(5)), F.concat(cut(F.lit(5)), F.lit("ate"))))
        .when(word.endswith("ing") & (F.length(word) > 5), F.array(cut(F.lit(3))))
        .when(word.endswith("ed"), F.array(cut(F.lit(2)), cut(F.lit(1))))
        .when(word.endswith("es"), F.array(cut(F.lit(2))))
        .when(word.endswith("s") & ~word.endswith("ss"), F.array(cut(F.lit(1))))
        .otherwise(none)
    )


def code_tokens(text: Column) -> Column:
    """Identifiers with their snake_case and camelCase parts and stems, repeats included."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE_WORD), F.lit(0))

    def expand(token: Column) -> Column:
        low = F.lower(token)
        snake = F.when(token.contains("_"), F.filter(F.split(low, "_"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
        camel = F.regexp_extract_all(token, F.lit(CAMEL_PART), F.lit(0))
        camel = F.when(F.size(camel) > 1, F.transform(camel, F.lower)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(low), snake, camel, stems(low))

    return F.flatten(F.transform(raw, expand))


def hash_head(token: Column) -> Column:
    """The first 32 bits of a token's SHA-256 as a number; take it once where bucket and sign are both asked for."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long")


def bucket_of(head: Column, width: int) -> Column:
    """Bucket of a token in a feature-hash vector: its ``hash_head`` modulo the width."""
    return (head % width).cast("int")


def sign_of(head: Column) -> Column:
    """+1 or -1 by the second bit of a ``hash_head``."""
    return F.when(F.shiftright(head, 1).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0)


def hash_bucket(token: Column, width: int) -> Column:
    return bucket_of(hash_head(token), width)


def hash_sign(token: Column) -> Column:
    return sign_of(hash_head(token))


def redacted(text: Column) -> Column:
    for pattern in INJECTIONS:
        text = F.regexp_replace(text, f"(?i){pattern}", REDACTED.replace("$", r"\$"))
    return text


def suspicious(text: Column) -> Column:
    """Whether redaction changes anything."""
    return F.coalesce(redacted(text) != text, F.lit(False))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons; null parts count as empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def excerpt(text: Column, lines: int = 8) -> Column:
    """The first lines, and how many more there are."""
    parts = F.split(text, "\n")
    more = F.concat(F.lit("\n... ["), (F.size(parts) - lines).cast("string"), F.lit(" more lines]"))
    return F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.when(F.size(parts) > lines, more).otherwise(F.lit("")))


def line_count(text: Column) -> Column:
    """Newlines, plus one for a last line without one; 0 for empty text."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).when(text.endswith("\n"), newlines).otherwise(newlines + 1)


def top_directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("/ (root)"))


def normal_path(path: Column) -> Column:
    """A relative path without empty, "." and ".." parts."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def package_name(name: Column, ecosystem: Column) -> Column:
    """PyPI names by PEP 503, others lower-cased and trimmed."""
    low = F.lower(F.trim(name))
    return F.when(F.lower(ecosystem) == "pypi", F.regexp_replace(low, r"[-_.]+", "-")).otherwise(low)


def moment(text: Column) -> Column:
    """An ISO date or time as a timestamp, with Z or an offset; null if it is none."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(F.trim(text), r"Z$", "+00:00")), F.lit(None).cast("timestamp"))


def number(text: Column) -> Column:
    """A text as a double; null if it is none."""
    return F.trim(text).try_cast("double")


# What a log must not show, and what stands there instead.
SECRETS_IN_LOGS = (
    (r"(?i)(password|token|secret|api_key|apikey|private_key|authorization)\s*[:=]\s*['\"]?([^'\",\s]+)['\"]?", "$1=******"),
    (r"(?i)(://[^:\s/]+):([^@\s/]+)@", "$1:******@"),
    (r"(?i)(Bearer\s+)([A-Za-z0-9_\-\.]+)", "$1******"),
)


def masked(text: Column) -> Column:
    """A log line without passwords, tokens and credentials in addresses."""
    for pattern, instead in SECRETS_IN_LOGS:
        text = F.regexp_replace(text, pattern, instead)
    return text
