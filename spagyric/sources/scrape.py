"""Entities out of pages: fields with selectors, their texts brought through a chain of steps.

The steps are those of a record: select, match or extract, process, drop nulls, first or all. Network access isn't
part of this package; pages come as a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spagyric.sources.dom import Node, cleaned, parse, select, text_of


@dataclass(frozen=True)
class Field:
    """kind: string, url, int, float, bool, datetime or an Entity."""

    selector: str
    kind: object = "string"
    match: str | None = None
    all: bool = False
    default: object = None
    lower: bool = False
    upper: bool = False
    strip_query: bool = False
    true: str = "true"
    steps: tuple[Callable, ...] = ()

    def cast(self, x: str):
        try:
            if self.kind in ("string", "url"):
                x = re.sub(r"\s+", " ", x).strip()
                if self.kind == "url" and self.strip_query:
                    u = urlsplit(x)
                    x = f"{u.scheme}://{u.netloc}{u.path}"
                return x.lower() if self.lower else x.upper() if self.upper else x
            if self.kind == "int":
                return int(x.strip())
            if self.kind == "float":
                return float(x.strip())
            if self.kind == "bool":
                return x.strip().lower() == self.true
            if self.kind == "datetime":
                return datetime.fromisoformat(x.strip())
        except ValueError:
            return None
        raise TypeError(self.kind)

    def scrape(self, root: Node):
        found = select(root, self.selector)
        if isinstance(self.kind, Entity):
            values = [self.kind.scrape(n) for n in found if isinstance(n, Node)]
        else:
            texts = [text_of(x) for x in found]
            if self.match:
                texts = [m[1] if m.re.groups else m[0] for t in texts if (m := re.search(self.match, t))]
            values = [self.cast(t) for t in texts]
        for step in self.steps:
            values = [step(v) if v is not None else None for v in values]
        values = [v for v in values if v is not None and v != ""]
        return values if self.all else values[0] if values else self.default

    def sql(self) -> str:
        one = "struct<" + self.kind.sql(": ") + ">" if isinstance(self.kind, Entity) else {"int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp"}.get(self.kind, "string")
        return f"array<{one}>" if self.all else one


@dataclass(frozen=True)
class Entity:
    fields: dict[str, Field] = field(default_factory=dict)

    def scrape(self, root: Node) -> dict:
        return {k: f.scrape(root) for k, f in self.fields.items()}

    def sql(self, sep: str = " ") -> str:
        return ", ".join(f"`{k}`{sep}{f.sql()}" for k, f in self.fields.items())


_M = lambda *names: ", ".join(f"meta[name=\"{n}\"]::attr(content)" for n in names)
#: The document entity that all publishers share; profiles replace single fields.
DOCUMENT = Entity({
    "doi": Field(_M("citation_doi", "dc.identifier"), match=r"(10\.\d+/\S+)"),
    "title": Field(_M("citation_title") + ", h1, title"),
    "authors": Field(_M("citation_author", "dc.creator"), all=True),
    "published_date": Field(_M("citation_publication_date", "citation_date")),
    "online_date": Field(_M("citation_online_date")),
    "journal": Field(_M("citation_journal_title")),
    "volume": Field(_M("citation_volume")),
    "issue": Field(_M("citation_issue")),
    "firstpage": Field(_M("citation_firstpage")),
    "lastpage": Field(_M("citation_lastpage")),
    "abstract": Field(_M("citation_abstract", "description")),
    "publisher": Field(_M("citation_publisher", "dc.publisher")),
    "issn": Field(_M("citation_issn")),
    "language": Field(_M("citation_language", "dc.language") + ", html::attr(lang)"),
    "copyright": Field(_M("dc.rights", "copyright")),
    "license": Field("a[rel=license]::attr(href)", kind="url"),
    "html_url": Field(_M("citation_fulltext_html_url"), kind="url"),
    "pdf_url": Field(_M("citation_pdf_url"), kind="url"),
    "landing_url": Field(_M("citation_abstract_html_url") + ", link[rel=canonical]::attr(href)", kind="url"),
    "supplement_urls": Field("a.supplement::attr(href), a[href*=\"suppdata\"]::attr(href)", kind="url", all=True),
})
JATS_DOCUMENT = Entity({
    "doi": Field("article-id[pub-id-type=doi]"),
    "title": Field("front article-title"),
    "authors": Field("contrib surname", all=True),
    "journal": Field("journal-title"),
    "volume": Field("article-meta volume"),
    "issue": Field("article-meta issue"),
    "firstpage": Field("article-meta fpage"),
    "lastpage": Field("article-meta lpage"),
    "publisher": Field("publisher-name"),
    "issn": Field("issn"),
    "abstract": Field("abstract"),
})


_PERSON = Entity({"first": Field("fnm, ce|given-name"), "last": Field("snm, ce|surname"), "email": Field("email, ce|e-address")})
#: The entities of single publishers: what differs from the common ones.
RSC_DOCUMENT = Entity(DOCUMENT.fields | {"title": Field(".title_heading, h1, meta[name=\"citation_title\"]::attr(content)"), "abstract": Field(".abstract, meta[name=\"citation_abstract\"]::attr(content)"), "headings": Field(".a_heading, .b_heading, h2, h3", all=True), "figures": Field(".image_title, figcaption", all=True)})
SPRINGER_DOCUMENT = Entity(DOCUMENT.fields | {"title": Field("meta[property=\"og:title\"]::attr(content), h1"), "abstract": Field("section.Abstract > p, div.AbstractSection > p"), "html_url": Field(_M("citation_fulltext_html_url", "citation_abstract_html_url"), kind="url")})
SPRINGER_XML = Entity({"doi": Field("doi, ArticleDOI"), "title": Field("ArticleTitle, article-title, atl"), "authors": Field("au, Author", kind=_PERSON, all=True), "journal": Field("JournalTitle, jtl"), "volume": Field("VolumeIDStart, vid"), "issue": Field("IssueIDStart, iid"), "abstract": Field("Abstract Para, abs p")})
ELSEVIER_DOCUMENT = Entity({"doi": Field("prism|doi, ce|doi"), "title": Field("dc|title, ce|title"), "authors": Field("ce|author", kind=_PERSON, all=True), "journal": Field("prism|publicationName"), "volume": Field("prism|volume"), "issue": Field("prism|number"), "firstpage": Field("prism|startingPage"), "lastpage": Field("prism|endingPage"), "published_date": Field("prism|coverDate"), "publisher": Field("prism|publisher"), "issn": Field("prism|issn"), "copyright": Field("prism|copyright, ce|copyright"), "abstract": Field("dc|description, ce|abstract-sec"), "headings": Field("ce|section-title", all=True)})
#: The entries of feeds and of result pages, the half of a search that needs no network.
FEED_ITEM = Entity({"title": Field("title"), "link": Field("link"), "doi": Field("prism|doi, dc|identifier", match=r"(10\.\d+/\S+)"), "published_date": Field("pubDate, prism|publicationDate, dc|date"), "description": Field("description")})


def feed_items(pages: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, fields of ``FEED_ITEM``) of every entry of RSS and Atom documents."""
    return scrape(pages, key, xml, FEED_ITEM, roots="item, entry", xml=True)


def scrape(pages: DataFrame, key: str, html: str, entity: Entity = DOCUMENT, roots: str | None = None, xml: bool = False, kill: tuple[str, ...] = ()) -> DataFrame:
    """(key, fields) of every page, or of every root selected in it. Null pages give no rows."""
    kind = pages.schema[key].dataType.simpleString()
    names = list(entity.fields)

    def run(batches):
        for b in batches:
            out = []
            for k, text in zip(b[key], b[html]):
                if text is None:
                    continue
                tree = parse(text, xml)
                tree = cleaned(tree, kill) if kill else tree
                for root in select(tree, roots) if roots else [tree]:
                    row = entity.scrape(root)
                    out.append((k, *(row[n] for n in names)))
            yield pd.DataFrame(out, columns=[key, *names], dtype=object)

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, {entity.sql()}")


def clean_html(c: Column, kill: tuple[str, ...] = ("script", "style", "noscript"), strip: tuple[str, ...] = (), allow: tuple[str, ...] | None = None, steps: tuple[Callable[[Node], None], ...] = ()) -> Column:
    """Markup without killed elements, of stripped or not allowed ones only the content. steps: changes to the tree before."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            tree = parse(text, False)
            for step in steps:
                step(tree)
            return "".join(x.html() if isinstance(x, Node) else x for x in cleaned(tree, kill, strip, allow).children)

        return s.map(lambda x: None if x is None else one(x))

    return run(c)


def strip_html(c: Column) -> Column:
    """The text of markup, white space brought to single blanks."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else text_of(cleaned(parse(x, False))))

    return run(c)
