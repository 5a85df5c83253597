"""Readers of what a crawl and a service leave, and its writers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RULE = "=" * 80
LEAST_BODY = 80


def corpus(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, category, filename, text) of all text files below path, without blank ones and NULs."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.translate("value", "\0", "").alias("text"))
    parts = F.split(F.replace("path", F.lit(path.rstrip("/") + "/"), F.lit("\1")), "\1")
    below = F.split(F.element_at(parts, -1), "/")
    category = F.when(F.size(below) > 1, below[0]).otherwise("general")
    return rows.select("path", category.alias("category"), F.element_at(below, -1).alias("filename"), "text").where(F.regexp_replace("text", r"(?U)\s+", "") != "")


def document(header: list[tuple[str, Column]], body: Column) -> Column:
    """The text of a corpus file; null for a body that is too short."""
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), value) for name, value in header))
    return F.when(F.length(body) >= LEAST_BODY, F.concat(lines, F.lit(f"\n\n{RULE}\n\n"), body))


def sitemap(xml: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(xml, F.lit("<loc>(.*?)</loc>"), F.lit(1)))


CATALOGUE = "struct<success: boolean, data: struct<courses: map<string, struct<code: string, subject: string, courses: map<string, array<struct<crn: string, name: string>>>>>>>"


def worklist(catalogues: DataFrame, least_term: str = "") -> DataFrame:
    """catalogues (term, json): -> (course, term, crn, name): each course's last term and its first section
    there. A catalogue that isn't marked as a success is skipped."""
    parsed = catalogues.select("term", F.from_json("json", CATALOGUE).alias("c")).where((F.col("term") >= least_term) & F.col("c.success"))
    subjects = parsed.select("term", F.explode("c.data.courses").alias("id", "s"))
    courses = subjects.select("term", "s.code", F.explode("s.courses").alias("num", "sections")).where(F.size("sections") > 0)
    last = courses.groupBy(F.concat_ws(" ", "code", "num").alias("course")).agg(F.max_by(F.struct("term", F.col("sections")[0].alias("s")), "term").alias("x"))
    return last.select("course", "x.term", "x.s.crn", "x.s.name")


def feedback(lines: DataFrame, marker: str = "feedback_log ") -> DataFrame:
    """lines (value): -> (ts, session_id, verdict, question) of the thumbs down; lines that aren't JSON after
    the marker are skipped."""
    at = F.instr("value", marker)
    found = lines.where(at > 0).select(F.from_json(F.col("value").substr(at + len(marker), F.length("value")), "ts string, session_id string, verdict string, question string").alias("x"))
    return found.select("x.*").where("verdict = 'down'")


GOLDEN = "id string, category string, question string, follow_up string, expected_urls string, key_facts string, must_not_contain string, expected_route string"
PEOPLE = "id string, type string, category string, question string, person string, teaches array<string>, code string, expect_name string, avoid_name string, url string"


def golden(spark: SparkSession, path: str, only: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Golden cases of a JSON lines file; lists stay JSON, for operators.evaluate.groups(). only: a part of
    the id; limit: so many cases of those that are left, in the file's order."""
    rows = spark.read.schema(GOLDEN).json(path).withColumn("seq", F.monotonically_increasing_id())
    return picked(rows, only, category, limit).withColumn("category", F.coalesce("category", F.lit("uncategorized")))


def picked(cases: DataFrame, only: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """cases (id, category, seq): -> without seq."""
    if only:
        cases = cases.where(F.contains("id", F.lit(only)))
    if category:
        cases = cases.where(F.col("category") == category)
    return (cases.orderBy("seq").limit(limit) if limit else cases).drop("seq")


def people(spark: SparkSession, *paths: str) -> DataFrame:
    """Cases about people of several JSON lines files; a case without a type is about what they teach."""
    rows = None
    for path in paths:
        part = spark.read.schema(PEOPLE).json(path)
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("type", F.coalesce("type", F.lit("teaches")))


def kept_urls(url: Column, wanted: str = "", skipped: tuple[str, ...] = ()) -> Column:
    """Does an address have what is wanted and nothing that is skipped?"""
    return F.contains(url, F.lit(wanted)) & ~F.exists(F.array(*map(F.lit, skipped)).cast("array<string>"), lambda s: F.contains(url, s))


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    """(course, term, crn, name) as write_worklist() leaves it."""
    return spark.read.schema("course string, term string, crn string, name string").json(path)


def write_worklist(worklist_: DataFrame, path: str) -> None:
    worklist_.write.mode("overwrite").json(path)


def crawl_report(documents: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (category), fetched (url, error): counts by category and in all (category null), and the
    lines of an error log."""
    return documents.rollup("category").agg(F.count(F.lit(1)).alias("n")), fetched.where("error is not null").select(F.concat_ws("\t", "url", "error").alias("value"))


FETCHED = "url string, body string, status int, tries int, error string"


def fetch(get: Callable[[str], tuple[int, str]], url: str, tries: int = 3, pause: Callable[[float], None] | None = None) -> dict:
    """get(url): -> (status, body), or raises. 404 is nothing at once; other failures are tried again
    after 2, 4, ... seconds, and the last one is recorded."""
    import time

    pause = pause or time.sleep
    for attempt in range(tries):
        try:
            status, body = get(url)
            if status == 404:
                return {"url": url, "body": None, "status": 404, "tries": attempt + 1, "error": None}
            if status >= 400:
                raise OSError(f"HTTP {status}")
            return {"url": url, "body": body, "status": status, "tries": attempt + 1, "error": None}
        except Exception as error:
            if attempt == tries - 1:
                return {"url": url, "body": None, "status": None, "tries": tries, "error": str(error)}
            pause(2**attempt * 2)


def fetch_all(urls: DataFrame, get: Callable[[str], tuple[int, str]], at_once: int = 3, delay: tuple[float, float] = (0.25, 0.45), tries: int = 3, pause: Callable[[float], None] | None = None) -> DataFrame:
    """urls (url): -> FETCHED, by at_once tasks, each with a pause before an address."""

    def run(batches):
        import random
        import time

        import pandas as pd

        for batch in batches:
            rows = []
            for url in batch["url"]:
                (pause or time.sleep)(random.uniform(*delay))
                rows.append(fetch(get, url, tries, pause))
            yield pd.DataFrame(rows, columns=["url", "body", "status", "tries", "error"]).astype({"status": "Int32", "tries": "int32"})

    return urls.select("url").repartition(at_once).mapInPandas(run, FETCHED)


def frames(stream: Column) -> Column:
    """array<struct<event, data>> of a text of server-sent events; what isn't complete is left out. The last
    event line names a frame, "message" if there is none; its data lines are one text; a frame whose data isn't
    JSON is skipped."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    after = lambda lines, name: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(name))), lambda x: trimmed(F.substr(x, F.lit(len(name) + 1))))

    def frame(block: Column) -> Column:
        lines = F.split(block, "\r?\n")
        names, data = after(lines, "event:"), after(lines, "data:")
        return F.struct(F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("message")).alias("event"), F.when(F.size(data) > 0, F.array_join(data, "\n")).alias("data"))

    blocks = F.split(stream, "\r?\n\r?\n")
    whole = F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))  # what comes last isn't complete
    return F.filter(F.transform(whole, frame), lambda f: F.try_parse_json(f["data"]).isNotNull())


# HTML

#: What is taken out of a page, by element, class and id; where its text is, the first that there is.
DROPPED = ["script", "style", "noscript", "svg", "iframe", "form", "nav", "header", "footer", "aside", "button"]
DROPPED_CLASSES = ["site-header", "site-footer", "page-hero__media", "breadcrumbs", "a11y-visual-hide", "skip-link", "social-share", "back-to-top", "sidebar", "site-alert", "cookie", "modal"]
DROPPED_IDS = ["site-header", "site-footer"]
MAIN = [("main", None), (None, "main-content"), ("article", None), ("body", None)]
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
HEADINGS = {"h1": "## ", "h2": "## ", "h3": "### ", "h4": "### ", "h5": "### "}
#: An opening tag of the key ends an open one of the values, up to an element of SCOPES.
BLOCKS = {*HEADINGS, "h6", "p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "nav", "header", "footer", "aside", "form", "pre", "blockquote", "hr", "address"}
ENDS = {**{b: {"p"} for b in BLOCKS}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "aside", "nav", "header", "footer", "form", "button"}


class _Element:
    def __init__(self, tag: str, attrs: dict[str, str | None], parent: _Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def all(self) -> Iterator[_Element]:
        """This element and those in it, in the page's order."""
        left = [self]
        while left:
            now = left.pop()
            yield now
            left += [c for c in reversed(now.children) if isinstance(c, _Element)]

    def texts(self) -> Iterator[str]:
        left: list = [self]
        while left:
            now = left.pop()
            if isinstance(now, _Element):
                left += reversed(now.children)
            else:
                yield now

    def text(self) -> str:
        """Its texts, stripped, with a space between any two."""
        return " ".join(t for t in map(str.strip, self.texts()) if t)


class _Page(HTMLParser):
    """Elements of a page, closed where their tags leave it out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = _Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends, at = ENDS.get(tag, ()), self.now
        while at.parent is not None and at.tag not in SCOPES:
            if at.tag in ends:
                self.now = at.parent
            at = at.parent
        element = _Element(tag, dict(attrs), self.now)
        self.now.children.append(element)
        if tag not in VOID:
            self.now = element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.now.tag == tag and tag not in VOID:
            self.now = self.now.parent

    def handle_endtag(self, tag):
        at = self.now
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.now = at.parent

    def handle_data(self, data):
        if self.now.tag not in ("script", "style"):
            self.now.children.append(data)


def _dropped(e: _Element) -> bool:
    return e.tag in DROPPED or e.attrs.get("id") in DROPPED_IDS or not set((e.attrs.get("class") or "").split()).isdisjoint(DROPPED_CLASSES)


def parse(html: str | None) -> _Element:
    """A page without what is dropped."""
    page = _Page()
    page.feed(html or "")
    page.close()
    for element in list(page.root.all()):
        element.children = [c for c in element.children if not (isinstance(c, _Element) and _dropped(c))]
    return page.root


def main_part(page: _Element) -> _Element | None:
    """The main element, else that of id main-content, else the first article, else the body."""
    found = list(page.all())
    return next((e for tag, id_ in MAIN for e in found if (e.tag == tag if tag else e.attrs.get("id") == id_)), page if page.children else None)


def element_lines(element: _Element) -> Iterator[str]:
    """Headings, paragraphs, list items, definitions and rows; what these hold is text of theirs, and text
    outside of them is lost."""
    tag = element.tag
    if tag in HEADINGS:
        yield HEADINGS[tag] + element.text()
    elif tag == "p":
        yield element.text()
    elif tag == "li":
        if text := element.text():
            yield f"- {text}"
    elif tag == "dt":
        after = element.parent.children
        after = after[after.index(element) + 1 :]
        told = next((c for c in after if isinstance(c, _Element) and c.tag == "dd"), None)
        yield f"{element.text()}: {told.text() if told else ''}"
    elif tag == "tr":
        yield " | ".join(t for t in (c.text() for c in element.all() if c.tag in ("th", "td")) if t)
    else:
        for child in element.children:
            if isinstance(child, _Element):
                yield from element_lines(child)


def page_text(html: str | None) -> str:
    """The lines of a page's main part from its first heading on (all, without a heading)."""
    part = main_part(parse(html))
    lines = [t for t in (re.sub("[ \t\xa0]+", " ", line).strip() for line in (element_lines(part) if part else ())) if t]
    first = next((i for i, line in enumerate(lines) if line.startswith("##")), 0)
    return re.sub("\n{3,}", "\n\n", "\n".join(lines[first:])).strip()


def html_text(html: Column) -> Column:
    """page_text() of whole pages."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([page_text(p) for p in pages.to_pylist()], pa.string())

    return run(html)


#: A character reference, or an ampersand that begins none.
REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def without_unclosed(html: str) -> str:
    """A page in which only references that end in a semicolon are left; other ampersands are text."""
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[0][1:]}", html)


def title_of(html: str | None) -> str:
    """Of a page without what is dropped: the text of the first h1, else the title up to a bar, else "Untitled"."""
    found = list(parse(html).all())
    h1 = next((e for e in found if e.tag == "h1"), None)
    if h1 is not None:
        return h1.text()
    title = next((e for e in found if e.tag == "title"), None)
    return "".join(title.texts()).split("|")[0].strip() if title is not None else "Untitled"


def page_title(html: Column, unclosed: bool = True) -> Column:
    """title_of() whole pages. unclosed: a reference without its semicolon counts, as for a browser (a text
    that was cut may end in one); else it stays as it is."""
    read = (lambda p: p) if unclosed else (lambda p: without_unclosed(p or ""))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([title_of(read(p)) for p in pages.to_pylist()], pa.string())

    return run(html)


def category(path: Column, prefixes: dict[str, str]) -> Column:
    """The category of the first prefix that a path begins with; null: not to be read."""
    out = None
    for prefix, name in prefixes.items():
        hit = F.startswith(path, F.lit(prefix))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
