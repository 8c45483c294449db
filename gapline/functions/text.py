"""Text preparation as Column expressions: normal forms, hashes, ids, tokens.

White space is the ASCII kind (``WS``), so that results do not depend on the engine's idea of Unicode classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f]"
BLANK = r"^[ \t\n\r\f]*$"
# Typographic characters and their plain forms.
TYPOGRAPHIC, PLAIN = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- "
#: Kinds whose normal form drops blank lines.
DROPS_BLANK_LINES = ("irs",)
COMMENTS = {
    "python": (r"(?md)#.*$", r'(?s)""".*?"""', r"(?s)'''.*?'''"),
    "fastapi": (r"(?md)#.*$", r'(?s)""".*?"""', r"(?s)'''.*?'''"),
    "yaml": (r"(?md)#.*$",),
    "kubernetes": (r"(?md)#.*$",),
    "javascript": (r"(?md)//.*$", r"(?s)/\*.*?\*/"),
    "cobol": (r"(?md)^[ \t]*\*.*$",),
    "mumps": (r"(?md);.*$",),
}
YAML_METADATA = r"(?i)^[ \t]*(?:creationTimestamp|resourceVersion|uid|generation|timestamp):"
PREFIXES = ("k8s", "py", "cobol", "irs", "mumps")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def normalize_encoding(text: Column) -> Column:
    """Curly quotes, dashes and no-break spaces in ASCII. (Composition to NFC: ``operators.text.compose``.)"""
    return F.translate(text, TYPOGRAPHIC, PLAIN)


def normalize_line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def rstrip_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)[ \t\r\f]+$", "")


def normalize_whitespace(text: Column, aggressive: bool = False) -> Column:
    """Conservative: no trailing spaces, one blank line of each run. Aggressive: inner runs become one space, indents stay."""
    if aggressive:
        return F.array_join(F.transform(lines(text), lambda x: F.when(x.rlike(BLANK), "").otherwise(F.concat(F.regexp_extract(x, r"^[ \t\r\f]*", 0), F.regexp_replace(strip(x), rf"{WS}+", " ")))), "\n")
    bare = rstrip_lines(text)
    squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "\n{3,}", "\n\n"), "^\n{2,}", "\n"), "\n{2,}$", "\n")
    return F.when(bare.rlike("^\n*$"), "").otherwise(squeezed)


def full_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"[ \t\r\f]+$", "")), lambda x: x != ""), "\n")


def normalize_by_source(text: Column, kind: Column) -> Column:
    """Trailing spaces go; kinds in ``DROPS_BLANK_LINES`` lose blank lines too."""
    return F.when(kind.isin(*DROPS_BLANK_LINES), full_lines(text)).otherwise(rstrip_lines(text))


def strip_comments(text: Column, kind: Column) -> Column:
    made = text
    for name, patterns in COMMENTS.items():
        made = F.when(kind == name, reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)).otherwise(made)
    return made


def strip_yaml_metadata(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(YAML_METADATA)), "\n")


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; text that is no JSON stays."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def embedding_text(text: Column) -> Column:
    return strip(normalize_line_endings(text))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text without carriage returns, trailing spaces and repeated blank lines."""
    return F.sha2(strip(normalize_whitespace(normalize_line_endings(text))), 256)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.regexp_replace(strip(text), rf"{WS}+", " ")) / 4)).cast("long")


def word_tokens(text: Column) -> Column:
    """Identifiers of more than two characters."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))


def significant_tokens(text: Column, kind: Column) -> Column:
    """Names that tell one artifact from another, by kind."""

    def found(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    by = {
        "fastapi": F.concat(found(r"def\s+([A-Za-z0-9_]+)"), found(r"class\s+([A-Za-z0-9_]+)"), found(r"@app\.([A-Za-z0-9_]+)"), found(r"from\s+([A-Za-z0-9_]+)"), found(r"import\s+([A-Za-z0-9_]+)")),
        "kubernetes": F.concat(found(r"(?m)^([A-Za-z0-9_]+):"), found(r"kind:\s*([A-Za-z0-9_]+)"), found(r"apiVersion:\s*([^ \t\n\r\f]+)")),
        "cobol": F.concat(found(r"(?m)^[ \t]*\d{2}[ \t]+([A-Z0-9_-]+)"), found(r"PIC\s+([A-Z0-9()]+)")),
        "irs": found(r"(\d{3}-\d{3})"),
        "mumps": F.concat(found(r"\^([A-Z0-9_]+)"), found(r"(?m)^[ \t]*(\d+)[ \t]+")),
    }
    made = word_tokens(text)
    for name, tokens in by.items():
        made = F.when(kind == name, tokens).otherwise(made)
    return made


def sanitize(part: Column) -> Column:
    """URL-safe: other characters become one underscore, none at the ends, ``unknown`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(part, F.lit("")), r"[^A-Za-z0-9_\-.]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def normal_path(path: Column) -> Column:
    """Forward slashes; what follows the first ``/src/``, else ``/app/``."""
    forward = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+(?:\\./+)*", "/")
    return F.when(forward.contains("/src/"), F.regexp_replace(forward, r"^.*?/src/", "")).when(forward.contains("/app/"), F.regexp_replace(forward, r"^.*?/app/", "")).otherwise(forward)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def artifact_id(kind: Column, path: Column, fields: dict[str, Column]) -> Column:
    """The kind's semantic URI; ``fields`` holds namespace, kind, name, start_line, end_line, structure, record_type, layout_version,
    section, global_name and node_path.
    """

    def f(name: str, default: str | Column) -> Column:
        return sanitize(F.coalesce(fields.get(name, F.lit(None).cast("string")), F.lit(default) if isinstance(default, str) else default))

    line = F.coalesce(fields.get("start_line", F.lit(1)), F.lit(1))
    end = F.coalesce(fields.get("end_line", line), line)
    uris = {
        "kubernetes": F.concat(F.lit("k8s://"), f("namespace", "default"), F.lit("/"), f("kind", "unknown"), F.lit("/"), f("name", file_stem(path))),
        "fastapi": F.concat(F.lit("py://"), normal_path(path), F.lit("#"), line.cast("string"), F.lit("-"), end.cast("string")),
        "cobol": F.concat(F.lit("cobol://"), sanitize(file_stem(path)), F.lit("/01-"), f("structure", "main")),
        "irs": F.concat(F.lit("irs://"), f("record_type", "IMF"), F.lit("/"), f("layout_version", "2024"), F.lit("/"), f("section", "main")),
        "mumps": F.concat(F.lit("mumps://"), f("global_name", "UNKNOWN"), F.lit("/"), f("node_path", "ROOT")),
    }
    made = F.concat(kind, F.lit("://"), normal_path(path), F.lit("/"), f("section", "main"))
    for name, uri in uris.items():
        made = F.when(kind == name, uri).otherwise(made)
    return made


def valid_id(uri: Column) -> Column:
    """An emitted prefix, 10 to 500 characters, none of ``<>"|?*``."""
    return uri.rlike("^(?:" + "|".join(PREFIXES) + ")://.") & F.length(uri).between(10, 500) & ~uri.rlike(r'[<>"|?*]')


def valid_hash(digest: Column) -> Column:
    return digest.rlike("^[0-9a-f]{64}$")
