"""Documents of many formats as element layers.

A reader is a profile: what its documents look like in their first bytes, and selectors of titles, headings,
paragraphs, tables, figures, references and metadata. Readers are tried in order, the first that recognises a
document and yields elements wins. Files are read by Spark (binaryFile) and parsed in Arrow batches.

Elements: (doc_id, el_idx, el_type, el_id, refs, text, label, links, grid); grid holds a table's rows. Documents
no reader recognises, and null contents, give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spagyric.sources.dom import Node, cleaned, parse, select, text_of

ELEMENT = "el_idx int, el_type string, el_id string, refs array<string>, text string, label string, links array<string>, grid array<array<string>>"
METADATA = ("title", "authors", "publisher", "journal", "volume", "issue", "firstpage", "lastpage", "doi", "language", "date", "pdf_url", "html_url")


@dataclass(frozen=True)
class Profile:
    name: str
    detect: tuple[str, ...] = ()  # regular expressions, one of which must be in the document
    extensions: tuple[str, ...] = ()
    xml: bool = False
    root: str = "body"
    title: str = "h1"
    heading: str = "h2, h3, h4, h5, h6"
    paragraph: str = "p, li, dd, dt, blockquote"
    table: str = "table"
    table_caption: str = "caption"
    table_row: str = "tr"
    table_cell: str = "th, td"
    footnote: str = "tfoot td"
    figure: str = "figure"
    figure_caption: str = "figcaption"
    figure_label: str = "figcaption .label"
    figure_link: str = "img::attr(src), a::attr(href)"
    citation: str = "cite, ol.references li, .references li"
    ignore: str = "nav, footer, header, script, style, aside"
    reference: str = "a[href^=\"#\"]"
    metadata: dict = field(default_factory=dict)
    mend: tuple[Callable[[Node], None], ...] = ()  # changes to the tree before it is read


_META = {
    "title": "meta[name=\"citation_title\"]::attr(content), meta[name=\"dc.title\"]::attr(content), title::text",
    "authors": "meta[name=\"citation_author\"]::attr(content), meta[name=\"dc.creator\"]::attr(content)",
    "publisher": "meta[name=\"citation_publisher\"]::attr(content), meta[name=\"dc.publisher\"]::attr(content)",
    "journal": "meta[name=\"citation_journal_title\"]::attr(content)",
    "volume": "meta[name=\"citation_volume\"]::attr(content)",
    "issue": "meta[name=\"citation_issue\"]::attr(content)",
    "firstpage": "meta[name=\"citation_firstpage\"]::attr(content)",
    "lastpage": "meta[name=\"citation_lastpage\"]::attr(content)",
    "doi": "meta[name=\"citation_doi\"]::attr(content)",
    "language": "meta[name=\"citation_language\"]::attr(content), html::attr(lang)",
    "date": "meta[name=\"citation_publication_date\"]::attr(content), meta[name=\"citation_date\"]::attr(content)",
    "pdf_url": "meta[name=\"citation_pdf_url\"]::attr(content)",
    "html_url": "meta[name=\"citation_fulltext_html_url\"]::attr(content), meta[name=\"citation_abstract_html_url\"]::attr(content)",
}
HTML = Profile("html", extensions=("html", "htm"), metadata=_META)
_JATS_META = {"title": "article-title::text", "authors": "contrib surname::text", "publisher": "publisher-name::text", "journal": "journal-title::text", "volume": "article-meta volume::text", "issue": "article-meta issue::text", "firstpage": "fpage::text", "lastpage": "lpage::text", "doi": "article-id[pub-id-type=doi]::text", "date": "pub-date year::text"}
XML = Profile("xml", extensions=("xml",), xml=True, root="*", title="title, article-title", heading="sec > title, head", paragraph="p, para", table="table-wrap, table", table_caption="caption", table_row="tr, row", table_cell="th, td, entry", figure="fig, figure", figure_caption="caption", figure_label="label", figure_link="graphic::attr(xlink:href)", citation="ref-list ref, reference", ignore="xref-nothing", reference="xref, ref-link", metadata=_JATS_META)
#: The readers in the order in which they are tried; generic ones and plain text come last.
READERS: list[Profile] = [
    replace(HTML, name="acs", detect=(r"(?i)<meta name=\"dc\.Identifier\"[^>]*content=\"10\.1021/",), title="h1.articleTitle, h1", heading="h2, h3, .title2, .title3", paragraph="p, div.NLM_p", figure="div.figure, figure", figure_caption=".caption, figcaption", citation=".reference, .cit"),
    replace(HTML, name="rsc", detect=(r"(?i)citation_doi\"\s+content=\"10\.1039", r"(?i)content=\"Royal Society of Chemistry\""), title="h1, .title_heading", heading="h2, h3, h4, .a_heading, .b_heading", paragraph="p, .otherpara", table="div.pnl--table table, table", table_caption=".table_caption, caption", figure="div.image_table, figure", figure_caption=".image_title, figcaption", citation=".ref-list li, cite"),
    replace(XML, name="nlm", detect=(r"-//NLM//DTD", r"ns/archiving"), root="article", title="front article-title", paragraph="body p, abstract p", citation="back ref"),
    replace(XML, name="uspto", detect=(r"<us-patent-grant",), root="us-patent-grant", title="invention-title", heading="heading", paragraph="description p, abstract p, claim-text", table="table", citation="us-citation", metadata={"title": "invention-title::text", "authors": "inventor last-name::text", "publisher": "assignee orgname::text", "date": "publication-reference date::text", "doi": "publication-reference doc-number::text"}),
    replace(HTML, name="cssp", detect=(r"(?i)content=\"ChemSpider SyntheticPages\"",), title="h1, .article-title", heading="h3, .section-title"),
    replace(XML, name="elsevier", detect=(r"elsevier\.com/xml/svapi/article",), root="*", title="ce|title, dc|title", heading="ce|section-title", paragraph="ce|para, ce|simple-para", table="ce|table", table_caption="ce|caption", table_row="row", table_cell="entry, ce|entry", figure="ce|figure", figure_caption="ce|caption", figure_label="ce|label", figure_link="none::attr(x)", citation="ce|bib-reference", metadata={"title": "dc|title::text", "authors": "dc|creator::text", "publisher": "prism|publisher::text", "journal": "prism|publicationName::text", "volume": "prism|volume::text", "issue": "prism|number::text", "firstpage": "prism|startingPage::text", "lastpage": "prism|endingPage::text", "doi": "prism|doi::text", "date": "prism|coverDate::text"}),
    replace(XML, name="springer_jats", detect=(r"dtd-version=\"1\.2\"",), root="article", title="front article-title", paragraph="body p, abstract p", citation="back ref"),
    replace(HTML, name="springer_materials", detect=(r"(?i)<title>[^<]*SpringerMaterials", r"(?i)materials\.springer\.com"), title="h1, .title", heading="h2, h3, .section__heading", paragraph="p, .description", table="table", table_caption="caption, .table__caption"),
    replace(HTML, name="springer", detect=(r"(?i)content=\"Springer", r"(?i)<(?:meta|link|base)\b[^<>]*springer(?:link)?\.com"), title="h1.ArticleTitle, h1", heading="h2.Heading, h2, h3", paragraph="p.Para, p", table="div.Table table, table", table_caption=".Caption, caption", figure="figure.Figure, figure", citation=".BibliographyWrapper li, .CitationContent"),
    XML,
    HTML,
]


#: The most columns that one cell spans: the limit of the HTML standard, which also bounds the work of broken markup.
WIDEST = 1000


def named_columns(table: Node) -> tuple[dict[str, int], dict[str, tuple[str, str]]]:
    """The positions of the columns that an XML table names, and the spans it names."""
    columns: dict[str, int] = {}
    at = -1
    for n in table.walk():
        if n.tag.rpartition(":")[2] == "colspec":
            at = int(n.attrs["colnum"]) - 1 if n.attrs.get("colnum", "").isdigit() else at + 1
            columns.setdefault(n.attrs.get("colname", f"#{at}"), at)
    spans = {n.attrs["spanname"]: (n.attrs.get("namest", ""), n.attrs.get("nameend", "")) for n in table.walk() if n.tag.rpartition(":")[2] == "spanspec" and "spanname" in n.attrs}
    return columns, spans


def grid_of(table: Node, p: Profile) -> list[list[str]]:
    """A table's rows with spans written out, ragged rows padded, empty ones left out. Spans are counted in rows and columns,
    or go from one named column to another, which also places a cell behind columns left out."""
    rows: list[list[str]] = []
    columns, spans = named_columns(table)
    open_: dict[int, tuple[int, str]] = {}  # column -> rows still to fill, text

    def number(c: Node, name: str, default: int = 1) -> int:
        return int(c.attrs[name]) if c.attrs.get(name, "").isdigit() else default

    for tr in select(table, p.table_row):
        below = {at: (n - 1, text) for at, (n, text) in open_.items() if n > 1}
        row = {at: text for at, (_, text) in open_.items()}
        at = 0
        for c in select(tr, p.table_cell):
            first, last = spans.get(c.attrs.get("spanname", ""), (c.attrs.get("namest", c.attrs.get("colname", "")), c.attrs.get("nameend", "")))
            if first in columns:
                at = max(at, columns[first])
            while at in row:
                at += 1
            wide = columns[last] - columns[first] + 1 if first in columns and last in columns else min(number(c, "colspan"), WIDEST)
            down = number(c, "morerows", 0) + 1 if "morerows" in c.attrs else number(c, "rowspan")
            text = text_of(c)
            for _ in range(max(1, wide)):
                if down > 1:
                    below[at] = (down - 1, text)
                row[at] = text
                at += 1
        open_ = below
        rows.append([row.get(i, "") for i in range(max(row, default=-1) + 1)])
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows if any(r)]


# --- trees of single publishers, mended before they are read -----------------------------------------------------------------


def captions_into_tables(tree: Node) -> None:
    """A caption that stands in front of its table's wrapper goes into the table."""
    for n in list(tree.walk()):
        if "table_caption" in n.attrs.get("class", "").split() and n.parent is not None:
            around = n.parent.elements()
            i = next(i for i, x in enumerate(around) if x is n)
            if i + 1 < len(around) and "rtable__wrapper" in around[i + 1].attrs.get("class", "").split():
                n.parent.children = [x for x in n.parent.children if x is not n]
                into = next((x for x in around[i + 1].walk() if x.tag == "table"), around[i + 1])
                n.tag, n.parent = "caption", into
                into.children.insert(0, n)


def blanks_dropped(tree: Node) -> None:
    """Line breaks in texts are blanks, and texts of nothing but white space go, except in bold type."""
    for n in tree.walk():
        if n.tag != "b":
            n.children = [c if isinstance(c, Node) else c.replace("\n", " ") for c in n.children if isinstance(c, Node) or not c.isspace()]


def images_as_characters(tree: Node) -> None:
    """Images of single characters, named by their code points, become the characters."""
    for n in tree.walk():
        for i, c in enumerate(n.children):
            if isinstance(c, Node) and c.tag == "img" and (m := re.search(r"/images/entities/(?:\w+_)*char_([0-9a-f]{4})(?:_([0-9a-f]{4}))?\.gif", c.attrs.get("src", ""))):
                n.children[i] = "".join(chr(int(x, 16)) for x in m.groups() if x)


def references_spaced(tree: Node) -> None:
    """A raised reference link is followed by a blank, so that words stay apart when it goes."""
    for n in list(tree.walk()):
        if n.tag == "a" and n.parent is not None and any("sup_ref" in x.attrs.get("class", "").split() for x in n.walk()):
            siblings = n.parent.children
            i = next(i for i, x in enumerate(siblings) if x is n)
            if i + 1 < len(siblings) and isinstance(siblings[i + 1], str) and siblings[i + 1][:1] not in ("", ")", ",", " ", "."):
                siblings[i + 1] = " " + siblings[i + 1]


def elements_of(text: str, p: Profile) -> list[tuple]:
    """(el_type, el_id, refs, text, label, links, grid) in document order."""
    tree = parse(text, p.xml)
    for step in p.mend:
        step(tree)
    roots = [r for r in select(tree, p.root)][:1] if p.root != "*" else [tree]
    root = cleaned(roots[0] if roots else tree, kill=tuple(x.strip() for x in p.ignore.split(",")))
    kinds: dict[int, str] = {}
    for kind in ("paragraph", "heading", "title", "citation", "footnote", "figure", "table"):  # the last wins
        for n in select(root, getattr(p, kind)):
            kinds[id(n)] = kind
    holding: set[int] = set()  # what has an element of some kind in it
    for n in root.walk():
        if id(n) in kinds:
            up = n
            while up is not None and id(up) not in holding:
                holding.add(id(up))
                up = up.parent
    out: list[tuple] = []
    loose: list[str] = []

    def flush() -> None:
        for part in "".join(loose).split("\n\n\x00"):
            text = re.sub(r"\s+", " ", part).strip()
            if text:
                out.append(("Paragraph", None, [], text, None, [], None))
        loose.clear()

    def walk(node: Node) -> None:
        for c in node.children:
            if not isinstance(c, Node):
                loose.append(c)
                continue
            kind = kinds.get(id(c))
            if c.tag == "br":
                loose.append("\n\n\x00")
            elif kind is None:
                block = c.tag in ("div", "section", "article", "body", "sec", "ul", "ol", "front", "back", "abstract") or id(c) in holding
                if block:
                    flush()
                walk(c)
                if block:
                    flush()
            else:
                flush()
                refs = [n.attrs.get("href", "").lstrip("#") or n.attrs.get("rid", "") or n.attrs.get("idref", "") for n in select(c, p.reference)]
                common = (c.attrs.get("id"), [r for r in refs if r])
                if kind == "table":
                    caption = " ".join(text_of(n) for n in select(c, p.table_caption)[:1])
                    label = next((text_of(n) for n in select(c, "label")), None)
                    out.append(("Table", *common, caption, label, [], grid_of(c, p)))
                elif kind == "figure":
                    caption = " ".join(text_of(n) for n in select(c, p.figure_caption)[:1])
                    label = next((text_of(n) for n in select(c, p.figure_label)), None)
                    out.append(("Figure", *common, caption, label, [x for x in select(c, p.figure_link)], None))
                else:
                    pieces: list[list[str]] = [[]]

                    def gather(n: Node) -> None:
                        for x in n.children:
                            if not isinstance(x, Node):
                                pieces[-1].append(x)
                            elif x.tag == "br":
                                pieces.append([])
                            else:
                                gather(x)

                    gather(c)
                    for piece in pieces:
                        text = re.sub(r"\s+", " ", "".join(piece)).strip()
                        if text:
                            out.append((kind.capitalize(), *common, text, None, [], None))

    walk(root)
    flush()
    return out


READERS = [replace(p, mend=(captions_into_tables, blanks_dropped, images_as_characters, references_spaced)) if p.name == "rsc" else replace(p, footnote="tfoot entry, table tfoot, tfoot td", mend=()) if p.name == "uspto" else p for p in READERS]


def metadata_of(text: str, p: Profile) -> dict:
    """The fields of METADATA; authors is a list, the others are the first text found, or None."""
    tree = parse(text, p.xml)
    out = {}
    for name in METADATA:
        found = [text_of(x) for css in re.split(r",(?![^\[(]*[\])])", p.metadata.get(name, "none")) for x in select(tree, css)]
        found = [x for x in found if x]
        out[name] = found if name == "authors" else (found[0] if found else None)
    return out


def decoded(content: bytes | str | None) -> str | None:
    """UTF-8 if it is that, a declared encoding, else Windows-1252."""
    if content is None or isinstance(content, str):
        return content
    try:
        return bytes(content).decode("utf-8-sig")
    except UnicodeDecodeError:
        m = re.search(rb"(?:charset|encoding)=[\"']?([\w-]+)", bytes(content))
        for name in ([m[1].decode()] if m else []) + ["cp1252", "latin-1"]:
            try:
                return bytes(content).decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
    return None


def reader_for(text: str, name: str | None = None, readers: list[Profile] | None = None) -> Profile | None:
    """The first reader that recognises a document; None means plain text."""
    ext, marked = (name or "").rpartition(".")[2].lower(), "<" in text  # a marker may stand behind any length of scripts
    for p in READERS if readers is None else readers:
        if p.detect:
            if marked and any(re.search(d, text) for d in p.detect):
                return p
        elif ext in p.extensions or not name and marked and re.search(r"(?i)<html|<!doctype html|<body" if not p.xml else r"^\s*<\?xml", text):
            return p
    return None


def plain_elements(text: str) -> list[tuple]:
    parts = re.split(r"\r?\n[ \t]*\r?\n|\r[ \t]*\r", text)
    return [("Paragraph", None, [], t, None, [], None) for t in (x.strip() for x in parts) if t]


#: From the bytes of a document in a binary format to its text, or to its elements.
Decoder = Callable[[bytes], "str | list[tuple]"]


def elements(docs: DataFrame, key: str = "doc_id", content: str = "content", name: str | None = None, readers: list[Profile] | None = None, decoders: dict[bytes, Decoder] | None = None) -> DataFrame:
    """The element layer of documents held as text or bytes. name: a column of file names. decoders: for binary formats,
    by the bytes with which they begin (b'%PDF'); without one such documents have no elements. A decoder gives a
    text, which is then read like any other, or elements as tuples in the order of ``ELEMENT`` without the index; one that
    fails leaves the document without elements."""
    kind = docs.schema[key].dataType.simpleString()
    columns = [key, content, *([name] if name else [])]

    def run(batches):
        for b in batches:
            out = []
            for row in zip(*(b[c] for c in columns)):
                raw = row[1].encode() if isinstance(row[1], str) else b"" if row[1] is None else bytes(row[1])
                decoder = next((f for magic, f in (decoders or {}).items() if raw.startswith(magic)), None)
                if decoder is not None:
                    try:
                        made = decoder(raw)
                    except Exception:  # whatever a foreign decoder raises
                        continue
                    if not isinstance(made, str):
                        out += [(row[0], i, *e) for i, e in enumerate(made or ())]
                        continue
                    row = (row[0], made, *row[2:])
                text = decoded(row[1])
                if not text or text.startswith("%PDF"):
                    continue
                file = row[2] if name else None
                profile = reader_for(text, file, readers)
                found = plain_elements(text) if profile is None else elements_of(text, profile)
                out += [(row[0], i, *e) for i, e in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "el_idx", "el_type", "el_id", "refs", "text", "label", "links", "grid"])

    return docs.select(*columns).mapInPandas(run, f"`{key}` {kind}, {ELEMENT}")


def metadata(docs: DataFrame, key: str = "doc_id", content: str = "content", name: str | None = None) -> DataFrame:
    """One row of metadata for every document in markup."""
    kind = docs.schema[key].dataType.simpleString()
    columns = [key, content, *([name] if name else [])]
    schema = f"`{key}` {kind}, " + ", ".join(f"{m} {'array<string>' if m == 'authors' else 'string'}" for m in METADATA)

    def run(batches):
        for b in batches:
            out = []
            for row in zip(*(b[c] for c in columns)):
                text = decoded(row[1])
                profile = reader_for(text, row[2] if name else None) if text else None
                if profile is not None:
                    out.append({key: row[0], **metadata_of(text, profile)})
            yield pd.DataFrame(out, columns=[key, *METADATA])

    return docs.select(*columns).mapInPandas(run, schema)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(doc_id, name, content) of files; doc_id is a hash of the path, name the path."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("name"), "content")


def tagged_corpus(spark: SparkSession, path: str, form: str = "slash") -> DataFrame:
    """(name, sent_idx, tokens ARRAY<STRUCT<text, tag>>) of corpora of tagged words. form: 'slash' has one sentence a line, its
    words as word/TAG; 'columns' one word a line, word and tag parted by a tab or blanks, sentences by empty lines; 'brackets'
    has trees, of which the leaves '(TAG word)' are taken, sentences parted by empty lines."""
    texts = read_files(spark, path).select("name", F.col("content").cast("string").alias("text"))
    block = r"\r?\n" if form == "slash" else r"\r?\n\s*\r?\n"
    rows = texts.select("name", F.posexplode(F.split("text", block)).alias("sent_idx", "line")).where(F.trim("line") != "")
    pair = {"slash": r"(\S+)/([^\s/]+)", "columns": r"(?m)^(\S+)[\t ]+(\S+)", "brackets": r"\(([^\s()]+) ([^\s()]+)\)"}[form]
    first, second = (F.regexp_extract_all("line", F.lit(pair), F.lit(i)) for i in ((2, 1) if form == "brackets" else (1, 2)))
    return rows.select("name", "sent_idx", F.arrays_zip(first.alias("text"), second.alias("tag")).alias("tokens"))


def annotated_corpus(spark: SparkSession, texts: str, annotations: str) -> DataFrame:
    """(id, section, start, end, text, kind) of tab-separated annotations (id, section, start, end, text, kind) that fit the texts
    (id, title, abstract) they refer to."""
    docs = spark.read.csv(texts, sep="\t", quote="", schema="id string, title string, abstract string")
    notes = spark.read.csv(annotations, sep="\t", quote="", schema="id string, section string, start int, end int, text string, kind string")
    body = F.when(F.col("section") == "T", F.col("title")).otherwise(F.col("abstract"))
    return notes.join(docs, "id").where(F.substring(body, F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).select(*notes.columns)


def csv_tables(spark: SparkSession, path: str) -> DataFrame:
    """(name, grid) of CSV files, each one table, its lines in order."""
    files = read_files(spark, path, "*.csv")

    def run(batches):
        import csv
        import io

        for b in batches:
            grids = [list(csv.reader(io.StringIO(decoded(c) or ""))) for c in b["content"]]
            yield pd.DataFrame({"name": b["name"], "grid": grids})

    return files.select("name", "content").mapInPandas(run, "name string, grid array<array<string>>")
