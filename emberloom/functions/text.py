"""Text as columns: tokens, headings, front matter, snippets, normal forms."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """All runs of a-z and 0-9 in lower case, with repeats; null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """All runs of letters and digits of any script in lower case, with repeats."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def first_heading(body: Column) -> Column:
    """The first level-one heading, or null."""
    return F.nullif(F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def title_of(body: Column, path: Column) -> Column:
    """First heading, else the file's name."""
    return F.coalesce(first_heading(body), basename(path))


def front_matter(text: Column) -> Column:
    """A struct of the front-matter block (null if there is none) and the body behind it."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\s*(?:\n|\z)", 1)
    has = text.rlike(r"(?s)\A---\r?\n.*?\r?\n---\s*(?:\n|\z)")
    body = F.when(has, F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\s*(?:\n|\z)", "")).otherwise(text)
    return F.struct(F.when(has, block).alias("block"), body.alias("body"))


def front_matter_field(block: Column, name: str) -> Column:
    """One ``name: value`` line of a block as text, without quotes; null where it is missing or empty."""
    value = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(value, r"^[\"'](.*)[\"']$", "$1"), F.lit(""))


def value_score(value: Column) -> Column:
    """A whole number from 0 to 4, else null: unknown is never low."""
    n = F.when(value.rlike(r"^\d{1,9}$"), value.cast("int"))
    return F.when(n.between(0, 4), n)


def summary_of(body: Column, limit: int = 300) -> Column:
    """The text under the heading Summary up to the next heading, cut; null where empty."""
    section = F.regexp_extract(body, r"(?s)(?:\A|\n)##\s+Summary[ \t]*\n(.*?)(?=\n#{1,6}\s|\z)", 1)
    return F.nullif(F.left(F.trim(F.regexp_replace(section, r"^\s+|\s+$", "")), F.lit(limit)), F.lit(""))


def collapse(text: Column, limit: int) -> Column:
    """Control characters out, white space as single spaces, cut to ``limit``."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.left(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(limit))


def word_snippet(text: Column, words: int = 32) -> Column:
    """The first words with an ellipsis where the result is shorter than the text."""
    short = F.array_join(F.slice(F.split(text, r"\s+", -1), 1, words), " ")
    return F.when(F.length(short) < F.length(text), F.concat(short, F.lit("…"))).otherwise(short)


def hit_snippet(text: Column, terms: list[str], words: int = 32, marks: tuple[str, str] = ("<mark>", "</mark>"), prefixes: list[str] | None = None, stems: Callable[[Column], Column] | None = None) -> Column:
    """A window of words that begins a quarter before the first hit of a term (or of a word that begins with one of some
    prefixes), with the hits in marks and an ellipsis where the text goes on; the first words where there is no hit. With
    ``stems``, terms and prefixes are stems and words are compared by theirs."""
    cut = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    bare = F.transform(cut, lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    bare = bare if stems is None else stems(bare)
    is_hit = lambda x: functools.reduce(operator.or_, [x.startswith(p) for p in prefixes or []], x.isin(*terms) if terms else F.lit(False))
    hits = F.transform(bare, lambda x: F.coalesce(is_hit(x), F.lit(False)))
    first = F.array_position(hits, F.lit(True)).cast("int") - 1
    start = F.greatest(F.lit(0), F.least(first - words // 4, F.size(cut) - words))
    both = F.slice(F.arrays_zip(cut.alias("word"), hits.alias("hit")), start + 1, F.lit(words))
    shown = lambda x: F.regexp_replace(x, r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", f"$1{marks[0]}$2{marks[1]}$3")
    marked = F.transform(both, lambda x: F.when(x["hit"], shown(x["word"])).otherwise(x["word"]))
    before, behind = F.when(start > 0, "…").otherwise(""), F.when(start + words < F.size(cut), "…").otherwise("")
    return F.when(F.coalesce(first, F.lit(-1)) < 0, word_snippet(text, words)).otherwise(F.concat(before, F.array_join(marked, " "), behind))


def char_snippet(text: Column, chars: int = 240) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("…"))).otherwise(text)


def highlight(text: Column, terms: list[str], marks: tuple[str, str] = ("[", "]")) -> Column:
    """Whole-word hits of the terms between marks."""
    return F.regexp_replace(text, rf"(?iu)\b({'|'.join(terms)})\b", f"{marks[0]}$1{marks[1]}")


#: Keys of an episode's front matter that count. Fixed values.
FRONT_KEYS = ("date", "session_id", "project", "turns", "promoted", "value_score", "value_source", "value_rubric_version", "value_model")


def front_matter_map(block: Column) -> Column:
    """The known keys of a front-matter block with their values as text: true and false in lower case, whole numbers
    without leading zeros, no empty values, no score out of range. A key that is there twice has its last value."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    value = lambda x: F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))
    plain = lambda v: F.when(F.lower(v).isin("true", "false"), F.lower(v)).when(v.rlike(r"^\d+$"), F.regexp_replace(v, r"^0+(?=\d)", "")).otherwise(v)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), plain(value(x)).alias("v")))
    known = F.filter(pairs, lambda p: p["k"].isin(*FRONT_KEYS) & (p["v"] != ""))
    keys = F.array_distinct(F.transform(known, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(known, lambda p: p["k"] == k), -1)["v"].alias("v")))
    return F.map_from_entries(F.filter(last, lambda p: (p["k"] != "value_score") | p["v"].rlike("^[0-4]$")))


def is_slug(text: Column) -> Column:
    """A project's short name: lower-case letters, digits and hyphens, the first one no hyphen."""
    return F.coalesce(text.rlike(r"\A[a-z0-9][a-z0-9-]*\z"), F.lit(False))


def entry_date(front: Column, path: Column) -> Column:
    """Front-matter date, else the date that the file's name starts with."""
    return F.coalesce(F.nullif(F.regexp_extract(front, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.nullif(F.regexp_extract(basename(path), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def keyword_hit(text: Column, keyword: str) -> Column:
    """Whether the keyword stands in the text with no letter, digit or hyphen beside it."""
    plain = "".join(c if c.isalnum() or c in " -_" else "\\" + c for c in keyword.lower())
    return F.coalesce(F.lower(text).rlike(rf"(?<![a-z0-9-]){plain}(?![a-z0-9-])"), F.lit(False))


def normal_command(command: Column) -> Column:
    """Ticket ids folded to one form, and runs of spaces and tabs to a space; no command is an empty one."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(command, F.lit("")), r"[A-Z]+-[0-9]+", "XXX-NNN"), r"[ \t]+", " ")


def ticket_keys(*texts: Column) -> Column:
    """Distinct ticket ids of several texts, in order."""
    every = [F.coalesce(F.regexp_extract_all(t, F.lit(r"\b[A-Z][A-Z0-9]+-[0-9]+\b"), F.lit(0)), F.array().cast("array<string>")) for t in texts]
    return F.array_distinct(F.concat(*every))


#: What a server's command line shows: the package a runner starts, the folder of an index script (built or not), a path
#: segment with mcp in it; and what goes from a name: scope, version, platform. Fixed values.
PACKAGE = r"(?:npm exec|npx|uvx)\s+(.+)"
SCRIPTS = (r"/([^/\s]+)/dist/index\.[mc]?[jt]s\b", r"/([^/\s]+)/index\.[mc]?[jt]s\b")
SEGMENT = r"(?i)/([^/\s]*mcp[^/\s]*)"
SCOPE, VERSION, PLATFORM = r"^@[^/]+/", r"@.*$", r"(?i)-(?:darwin|linux|win32)-(?:arm64|x64|x86_64).*$"


def server_base(name: Column) -> Column:
    """A package or folder name without scope, version and platform."""
    for part in (SCOPE, VERSION, PLATFORM):
        name = F.regexp_replace(name, part, "")
    return name


def server_name(command: Column, known: tuple[tuple[str, str], ...] = (), prefix: str = "") -> Column:
    """A server's name from its command line: a known mark (part of the command, name), else the package that a
    runner starts (its flags left out), else the folder of an index script, else the path segment with ``mcp`` in
    it, else the program. ``prefix`` is a start of names that goes."""
    part = lambda pattern: F.nullif(F.regexp_extract(command, pattern, 1), F.lit(""))
    words = F.filter(F.split(part(PACKAGE), r"\s+"), lambda t: (t != "") & ~t.startswith("-"))
    program = F.regexp_extract(F.split_part(command, F.lit(" "), F.lit(1)), r"([^/]*)$", 1)
    found = F.coalesce(
        F.get(words, F.lit(0)),
        *map(part, SCRIPTS),
        part(SEGMENT),
        F.nullif(program, F.lit("")),
        F.lit("other"),
    )
    name = F.regexp_replace(server_base(found), f"^{prefix}", "") if prefix else server_base(found)
    for mark, own in reversed(known):
        name = F.when(command.contains(mark), own).otherwise(name)
    return F.when(command.isNotNull(), name)
