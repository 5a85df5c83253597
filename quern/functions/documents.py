"""What is derived from a corpus file's name, header and text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.functions.text import replace_first

OUTLINE = "^([A-Z]{2,4})_([0-9][A-Z0-9]{3,4})_([0-9]{6})"


def _part(filename: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(filename, OUTLINE, i), F.lit(""))


def _stem(filename: Column) -> Column:
    return F.replace(filename, F.lit(".txt"), F.lit(""))


def _parts(filename: Column) -> Column:
    stem = _stem(filename)
    return F.when(stem.contains("_"), F.split(stem, "_")).when(stem.contains("-"), F.split(stem, "-")).otherwise(F.array(stem))


def file_keywords(filename: Column) -> Column:
    """array<string>: from the parts of an outline's name, else from what _ or else - parts."""
    outline = F.array(F.lower(_part(filename, 1)), _part(filename, 2), F.lit("course"), F.lit("outline"))
    return F.when(filename.rlike(OUTLINE), outline).otherwise(F.transform(_parts(filename), F.lower))


def file_kind(filename: Column) -> Column:
    """course_outline, program (a name of parts) or general."""
    stem = _stem(filename)
    return F.when(filename.rlike(OUTLINE), "course_outline").when(stem.contains("_") | stem.contains("-"), "program").otherwise("general")


def readable_name(filename: Column) -> Column:
    return F.when(filename.rlike(OUTLINE), F.concat_ws(" ", _part(filename, 1), _part(filename, 2))).otherwise(F.array_join(_parts(filename), " "))


def header(text: Column, name: str, last: bool = True) -> Column:
    """The value of the last (or first) `name:` line among the first ten lines."""
    lines = F.slice(F.split(text, "\n"), 1, 10)
    found = F.filter(lines, lambda x: F.startswith(x, F.lit(f"{name}:")))
    found = F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit(f"{name}:"), F.lit("")), r"(?U)^\s+|\s+$", ""))
    if not last:  # the first that says something
        found = F.filter(found, lambda x: x != "")
    return F.try_element_at(found, F.lit(-1 if last else 1))


def metadata(filename: Column, text: Column) -> dict[str, Column]:
    """Column by name; those that the file doesn't have are null."""
    low = F.lower(text)
    found = lambda pattern, i=1: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    number = found(r"(?i)(level|term)\s+([0-9]+)", 2)
    return {
        "file_kind": file_kind(filename),
        "filename_keywords": F.array_join(file_keywords(filename), ", "),
        "file_size": F.length(text),
        "course_dept": _part(filename, 1),
        "course_num": _part(filename, 2),
        "term_code": _part(filename, 3),
        "course_code": F.coalesce(F.when(filename.rlike(OUTLINE), readable_name(filename)), header(text, "Course", last=False)),
        "url": header(text, "URL"),
        "title": header(text, "Title"),
        "program_type": F.when(low.contains("full-time") | low.contains("full time"), "full-time").when(low.contains("part-time") | low.contains("flex"), "part-time").otherwise("unknown"),
        "program_level": F.when(low.contains("diploma"), "diploma").when(low.contains("certificate"), "certificate").when(low.contains("bachelor") | low.contains("degree"), "degree"),
        "level": F.concat(F.lit("Level "), number),
        "term": F.concat(F.lit("Term "), number),
        "year": F.when(text.contains("First Year") | text.contains("first year"), "First Year").when(text.contains("Second Year") | text.contains("second year"), "Second Year"),
        "credits": found(r"Credits?:\s*([0-9]+(?:[.][0-9]+)?)").cast("double"),
        "prerequisites": F.nullif(F.trim(found(r"(?i)prerequisites?:\s*([^\n]+)")), F.lit("")),
    }


def prefix(filename: Column, columns: dict[str, Column]) -> Column:
    """Tags that stand before a text."""
    tag = lambda *parts: F.concat(F.lit("["), *parts, F.lit("]"))
    outline = filename.rlike(OUTLINE)
    named = F.when(outline, tag(F.lit("COURSE: "), readable_name(filename))).otherwise(tag(F.lit("DOCUMENT: "), readable_name(filename)))
    mode = F.when(columns["program_type"] != "unknown", tag(F.upper(columns["program_type"])))
    return F.concat_ws(" ", named, F.when(outline, tag(F.lit("TERM: "), _part(filename, 3))), mode, tag(F.upper(columns["program_level"])), tag(F.upper(columns["level"])))


def enhanced(tags: Column, text: Column, level: Column) -> Column:
    """The tags, a blank line, and the text, whose first "Level n" names the term, too."""
    whole = F.concat(tags, F.lit("\n\n"), text)
    n = F.regexp_extract(level, "([0-9]+)$", 1)
    return F.when(level.isNull(), whole).otherwise(replace_first(whole, level, F.concat(level, F.lit(" (also known as Term "), n, F.lit(", Term-"), n, F.lit(")"))))


def embedding_text(title: Column, category: Column, text: Column) -> Column:
    title, category = (F.translate(F.coalesce(c, F.lit("")), "_", " ") for c in (title, category))
    named = F.concat(title, F.when(category != "", F.concat(F.lit(" ("), category, F.lit(")"))).otherwise(""), F.lit(". "), text)
    return F.when((title == "") & (category == ""), text).otherwise(named)


def lexical_text(title: Column, category: Column, keywords: Column, slug: Column, text: Column) -> Column:
    """The text with the page's identity before it; empty parts leave no space."""
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (title, category, keywords, slug)), text)


def record_title(title: Column, keywords: Column, category: Column, most: int = 200) -> Column:
    """What a reranker sees as a chunk's title."""
    some = lambda c: F.when((c != "") & (c != "None"), c)
    return F.substring(F.concat_ws(" ", some(title), some(keywords), some(category)), 1, most)


def record_text(text: Column, most: int = 1024) -> Column:
    """What a reranker sees of a chunk."""
    return F.substring(text, 1, most)


def outline_url(base: Column, term: Column, crn: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/outlines/"), term, crn)


def course_code_of_slug(slug: Column) -> Column:
    """The code at the end of a course page's address, as "DEPT NUM"; null without one."""
    part = lambda i: F.regexp_extract(slug, "-([a-z]{2,4})-([0-9]{4}[a-z]?)/?$", i)
    return F.when(part(1) != "", F.upper(F.concat_ws(" ", part(1), part(2))))
