"""Names of programming languages and codes of human ones."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import js_trim, nullable

#: Other names of a language.
ALIASES = {
    "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "python": "python", "py": "python",
    "java": "java", "c#": "csharp", "csharp": "csharp", "c++": "cpp", "cpp": "cpp", "c": "c", "go": "go", "golang": "go", "rust": "rust",
    "rs": "rust", "ruby": "ruby", "rb": "ruby", "php": "php", "swift": "swift", "kotlin": "kotlin", "kt": "kotlin", "scala": "scala",
    "shell": "shell", "bash": "shell", "sh": "shell", "powershell": "powershell", "ps1": "powershell", "sql": "sql", "json": "json", "xml": "xml",
    "html": "html", "css": "css", "scss": "scss", "yaml": "yaml", "yml": "yaml", "markdown": "markdown", "md": "markdown",
    "dockerfile": "dockerfile", "docker": "dockerfile",
}

#: The language of a file extension.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python",
    "rb": "ruby", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "c": "c", "cs": "csharp", "kt": "kotlin",
    "swift": "swift", "scala": "scala", "php": "php", "sql": "sql", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "sh": "shell",
    "bash": "shell", "zsh": "shell", "ps1": "powershell", "md": "markdown", "html": "html", "css": "css",
}

#: Codes with a region that stand for the plain code.
REGIONS = {"zh-cn": "zh", "zh-tw": "zh"}


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain(*values.items())))


def language_tag(x: Column) -> Column:
    """First token without wrappers and prefixes, by its usual name; unknown if nothing is left."""
    t = F.element_at(F.split(F.lower(js_trim(x)), "\\s+"), 1)
    t = F.regexp_replace(F.regexp_replace(t, "^[{.(]+", ""), "[)}]+$", "")
    t = F.regexp_replace(t, "^(language|lang)[:_]", "")
    t = F.regexp_replace(F.regexp_replace(t, "^language-", ""), "^lang-", "")
    return F.when(t.isNull() | (t == ""), "unknown").otherwise(F.coalesce(F.try_element_at(lookup(ALIASES), t), t))


def tag_of(x: str | None) -> str:
    """The same for a string."""
    import re

    t = (x or "").lower().split()
    t = re.sub(r"[)}]+$", "", re.sub(r"^[{.(]+", "", t[0])) if t else ""
    t = re.sub(r"^(language|lang)[:_]", "", t).removeprefix("language-").removeprefix("lang-")
    return ALIASES.get(t, t) or "unknown"


def code_language(explicit: Column, extension: Column, filename: Column) -> Column:
    """The language given, else the extension's; null if unknown."""
    named = language_tag(explicit)
    ext = F.coalesce(nullable(extension), F.element_at(F.split(nullable(filename), "\\."), -1))
    ext = F.regexp_replace(F.lower(ext), "^\\.", "")
    return F.when(nullable(explicit).isNotNull(), F.nullif(named, F.lit("unknown"))).otherwise(F.try_element_at(lookup(EXTENSIONS), ext))


def language_code(x: Column) -> Column:
    """A code of two or three letters, else unknown."""
    low = F.lower(js_trim(x))
    return F.coalesce(F.try_element_at(lookup(REGIONS), low), F.when(low.rlike("^[a-z]{2,3}$"), low), F.lit("unknown"))


def parse_languages(value: str | None) -> list[str] | None:
    """A comma-separated setting; null if blank."""
    if not value or not value.strip():
        return None
    return [x for x in (v.strip().lower() for v in value.split(",")) if x]


def allowed(detected: Column, accepted: list[str] | None) -> Column:
    """Whether a document of these languages is taken in: any, without a list; unknown only if it is listed."""
    if not accepted:
        return F.lit(True)
    listed = F.array(*map(F.lit, accepted))
    return F.when(F.array_contains(detected, "unknown"), F.lit("unknown" in accepted)).otherwise(F.arrays_overlap(detected, listed))


def matches(languages: Column, wanted: list[str] | None) -> Column:
    """Whether a document passes a query's languages: one without any only if unknown is wanted."""
    if not wanted:
        return F.lit(True)
    none = languages.isNull() | (F.size(languages) == 0)
    return F.when(none, F.lit("unknown" in wanted)).otherwise(F.arrays_overlap(languages, F.array(*map(F.lit, wanted))))
