"""Text, path and naming rules as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as Python's ``splitlines`` knows them (fixed values).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: The characters that Python's ``strip`` removes (fixed values).
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Suffix to language (fixed values).
LANGUAGES = {".py": "python", ".java": "java", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp"}
MAX_FILE_BYTES = 512 * 1024
CALLABLES = ("function", "method", "constructor")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def split_lines(text: Column) -> Column:
    """The lines of a text without their ends; none for an empty text."""
    return let(F.split(text, LINE_END, -1), lambda x: F.when(F.get(x, F.size(x) - 1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def normalize_code(code: Column) -> Column:
    """The code without blanks at both ends and around its lines."""
    return F.array_join(F.transform(split_lines(strip(code)), strip), "\n")


def last_part(path: Column, mark: str = "/") -> Column:
    return F.substring_index(path, mark, -1)


def language_of_path(path: Column) -> Column:
    """By the last suffix in lower case; null for all that isn't supported."""
    suffix = F.lower(F.regexp_extract(path, r"(?s)[^/](\.[^./]+)\z", 1))
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[suffix]


def skip_reason(language: Column, size: Column, parse_error: Column, limit: int = MAX_FILE_BYTES) -> Column:
    """The first reason that holds, null for a file that is analysed."""
    return F.when(language.isNull(), "unsupported_language").when(size > limit, "file_too_large").when(parse_error, "parse_error")


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def storage_path(root: Column, path: Column) -> Column:
    """The absolute path with ``.``, ``..`` and empty parts resolved."""
    parts = F.split(F.concat_ws("/", posix(root), posix(path)), "/")
    keep = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "") | (p == "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(keep, "/"))


def collection_name(prefix: Column, language: Column) -> Column:
    """``prefix-language-code-impl`` with runs of other characters as one dash; null if a part has no letter or digit."""

    def part(x):
        return F.nullif(F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "-"), F.lit("-")), F.lit(""))

    return F.concat(part(prefix), F.lit("-"), part(language), F.lit("-code-impl"))


def document_text(signature: Column, body: Column) -> Column:
    return let(strip(body), lambda b: F.when(b != "", F.concat(signature, F.lit("\n"), b)).otherwise(signature))


def query_text(body: Column, code: Column) -> Column:
    return strip(F.coalesce(F.nullif(body, F.lit("")), code))


def metadata_json(metadata: Column) -> Column:
    """A map of booleans as JSON with sorted keys and a blank after colons and commas."""
    entries = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(F.lit('"'), e.key, F.lit('": '), e.value.cast("string")))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(entries, ", "), F.lit("")), F.lit("}"))


def symbol_id(kind: Column, path: Column, qualified_name: Column, start_line: Column) -> Column:
    return F.concat_ws(":", kind, path, qualified_name, start_line.cast("string"))


def qualified_name(name: Column, parent: Column) -> Column:
    return F.when(parent.isNotNull() & (parent != ""), F.concat_ws(".", parent, name)).otherwise(name)


def edge_id(kind: Column, path: Column, source: Column, destination: Column) -> Column:
    return F.concat(kind, F.lit(":"), path, F.lit(":"), source, F.lit("->"), destination)
