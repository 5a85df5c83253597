"""Column functions on texts, names and addresses. All are built-in expressions; a null text is null
unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: uuid5's namespace for addresses.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order, repeats included."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_question(text: Column) -> Column:
    """The key of a cache or of a set of questions; null counts as empty."""
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def normalise_answer(text: Column) -> Column:
    """For matching facts: lower case, one kind of dash for three, no commas, a hyphen between digit and
    letter is a space, single spaces (also at the ends)."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for mark, by in (("–", "-"), ("—", "-"), ("‑", "-"), (",", "")):  # translate() looks every character up
        plain = F.replace(plain, F.lit(mark), F.lit(by))
    return F.regexp_replace(F.regexp_replace(plain, "(?<=[0-9])-(?=[a-z])", " "), r"(?U)\s+", " ")


def normalise_url(url: Column) -> Column:
    return F.rtrim(F.lower(F.trim(F.coalesce(url, F.lit("")))), F.lit("/"))


def chunk_key(source: Column, text: Column, full: bool = False) -> Column:
    """A chunk's identity: its source and its first 200 characters, or the digest of all."""
    return F.concat(source, F.lit("::"), F.md5(text) if full else F.substring(text, 1, 200))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based identifier, in its usual form."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def slug(text: Column, most: int = 120) -> Column:
    """For file names; "untitled" if nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s,&-]", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(kept, r"(?U)\s+", "_"), 1, most), F.lit("")), F.lit("untitled"))


def url_slug(url: Column) -> Column:
    """The words of an address after its site."""
    path = F.regexp_replace(url, "^[a-z]+://[^/]*/?", "")
    return F.trim(F.regexp_replace(path, "[^A-Za-z0-9]+", " "))


def cited_urls(answer: Column) -> Column:
    """Addresses after the first "sources" of an answer (in all of it, if there is none)."""
    at = F.instr(F.lower(answer), "sources")
    scope = F.when(at > 0, answer.substr(at, F.length(answer))).otherwise(answer)
    return F.transform(F.regexp_extract_all(scope, F.lit(r"https?://[^\s)\]>\"]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;]+$", ""))


def history_view(answer: Column, most: int) -> Column:
    """An earlier answer as later turns see it: no closing list of sources, cut to length."""
    trimmed = lambda t: F.regexp_replace(t, r"(?U)\s+\z", "")
    stripped = trimmed(F.regexp_replace(answer, r"(?is)\n[ \t*#]*Sources[ \t*#]*:?.*\z", ""))
    cut = F.when(F.length(stripped) > most, F.concat(trimmed(F.substring(stripped, 1, most)), F.lit(" ..."))).otherwise(stripped)
    return F.when(stripped == "", F.substring(answer, 1, most)).otherwise(cut)


#: Who signs a page.
SIGNERS = ("Program Head", "Associate Dean", "Faculty", "Dean")
SIGNATURE = r"(?dm)^I verify that .*?(?:" + "|".join(SIGNERS) + r")\s+[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}\s*$"


def strip_signature(text: Column) -> Column:
    """Without the lines in which one of SIGNERS approves a page, with a date at their end."""
    return F.regexp_replace(text, SIGNATURE, "")


def replace_first(text: Column, what: Column, by: Column) -> Column:
    """text with its first occurrence of what replaced; both are taken literally."""
    at = F.position(what, text)
    return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), by, text.substr(at + F.length(what), F.length(text)))).otherwise(text)


def escape_regex(needle: Column) -> Column:
    return F.regexp_replace(needle, "([^a-z0-9 ])", r"\\$1")


def fact_in(fact: Column, answer: Column) -> Column:
    """Does a normalised answer have a fact at bounds of a-z and 0-9? A fact that ends in a digit may go
    on as an ordinal."""
    return at_bounds(normalise_answer(fact), normalise_answer(answer))


def at_bounds(needle: Column, answer: Column) -> Column:
    """fact_in() of what is normalised already. No pattern is made for a needle that isn't there at all."""
    tail = F.when(needle.rlike("[0-9]$"), "(st|nd|rd|th)?").otherwise("")
    found = F.regexp_count(answer, F.concat(F.lit("(?<![a-z0-9])"), escape_regex(needle), tail, F.lit("(?![a-z0-9])"))) > 0
    return (needle != "") & F.contains(answer, needle) & found


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once for a row: what stands in a lambda is made anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def message_text(parts: Column) -> Column:
    """The text of a message that is an array of parts (text, or null)."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit(""))), "")


def message_of_json(content: Column) -> Column:
    """The text of a message as JSON: a text, or a list of texts and of objects with a text."""
    one = lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.when(F.startswith(F.ltrim(p), F.lit("{")), F.lit("")).otherwise(p))
    parts = F.from_json(content, "array<string>")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.array_join(F.transform(parts, one), "")).otherwise(content)


#: Words of a capitalised run that name nothing.
NOISE = (
    "what which who whose when where how does do did is are the a an and or of for in at to i he she they "
    "teach teaches taught course courses class classes instructor instructors program programs"
).split()
#: A code of 2 to 4 letters and 4 or 5 characters that begin with a digit; a run of up to four capitalised words.
CODE = r"\b([A-Za-z]{2,4})\s*-?\s*([0-9][A-Za-z0-9]{3,4})\b"
NAME_RUN = r"\b([A-Z][a-z]+(?:[-'’][A-Za-z]+)*(?:\s+[A-Z][a-z]*\.?(?:[-'’][A-Za-z]+)*){0,3})"


def codes(text: Column) -> Column:
    """array<string>: the codes in a text as "DEPT NUM", in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), lambda c: F.upper(F.concat_ws(" ", F.regexp_extract(c, CODE, 1), F.regexp_extract(c, CODE, 2))))


def name_runs(text: Column, site: tuple[str, ...] = ()) -> Column:
    """array<array<string>>: the words of each capitalised run without NOISE (and the words of the site's
    own name)."""
    noise = F.array(*map(F.lit, (*NOISE, *site)))
    plain = lambda w: F.lower(F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.transform(F.regexp_extract_all(text, F.lit(NAME_RUN), F.lit(1)), lambda r: F.filter(F.split(r, r"\s+"), lambda w: ~F.array_contains(noise, plain(w))))


#: What joins questions.
JOINTS = (",", ";", " and ", " or ", " vs ", " versus ")


def is_simple_question(question: Column, most_words: int = 12) -> Column:
    """Fewer words than most_words, at most one question mark, nothing that joins questions."""
    plain = F.lower(F.regexp_replace(question, r"(?U)^\s+|\s+$", ""))
    joined = F.lit(False)
    for joint in JOINTS:
        joined = joined | plain.contains(joint)
    marks = F.length(plain) - F.length(F.replace(plain, F.lit("?"), F.lit("")))
    return (F.size(F.split(plain, r"(?U)\s+")) < most_words) & (marks <= 1) & ~joined


#: What isn't a concrete piece of missing information.
VAGUE = (
    "more information", "more info", "more detail", "more details", "additional information", "additional details", "further information",
    "details", "information", "data", "specifics", "context", "everything", "other courses", "other programs", "anything else", "the rest",
)


def is_concrete(missing: Column) -> Column:
    """Does any item name something: three characters or more, not vague, a digit or two words?"""
    item = lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.exists(missing, lambda x: (F.length(item(x)) >= 3) & ~item(x).isin(*VAGUE) & (item(x).rlike(r"\p{Nd}") | (F.size(F.split(item(x), r"(?U)\s+")) >= 2))), F.lit(False))
