"""Bibliographic sources: BibTeX entries, names of people, XMP metadata."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spagyric.functions.text import _latex

# --- BibTeX ------------------------------------------------------------------------------------------------------------

#: Other names of keys.
_KEYS = {"keyw": "keyword", "keywords": "keyword", "authors": "author", "editors": "editor", "url": "link", "urls": "link", "links": "link"}
_MONTHS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), "January February March April May June July August September October November December".split()))


def _value(s: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """One value: parts in braces or quotes, numbers and names of strings, joined by #."""
    out = ""
    while at < len(s):
        while at < len(s) and s[at].isspace():
            at += 1
        if at < len(s) and s[at] in "{\"":
            close, depth, start = ("}" if s[at] == "{" else '"'), 0, at + 1
            at += 1
            while at < len(s) and (depth or s[at] != close):
                depth += (s[at] == "{") - (s[at] == "}")
                at += 1
            out += s[start:at]
            at += 1
        else:
            m = re.compile(r"[^\s,#}]+").match(s, at)
            if not m:
                break
            out += strings.get(m[0].lower(), m[0])
            at = m.end()
        m = re.compile(r"\s*#").match(s, at)
        if not m:
            break
        at = m.end()
    return out, at


def bibtex(text: str) -> list[dict]:
    """Entries as {type, key, fields, authors}: values without braces and LaTeX, authors as 'First Last'."""
    strings, out = dict(_MONTHS), []
    for m in re.finditer(r"@\s*(\w+)\s*[{(]", text):
        kind, at = m[1].lower(), m.end()
        if kind in ("comment", "preamble"):
            continue
        if kind == "string":
            n = re.compile(r"\s*(\w+)\s*=").match(text, at)
            if n:
                strings[n[1].lower()] = _value(text, n.end(), strings)[0]
            continue
        k = re.compile(r"\s*([^,\s}]*)\s*,").match(text, at)
        if not k:
            continue
        fields, at = {}, k.end()
        while n := re.compile(r"\s*,?\s*([\w-]+)\s*=").match(text, at):
            value, at = _value(text, n.end(), strings)
            name = _KEYS.get(n[1].lower(), n[1].lower())
            fields[name] = value if name in ("author", "editor") else re.sub(r"\s+", " ", _latex(value)).strip()
        authors = [person(a, bibtex=True)["fullname"] for a in _people(fields.pop("author", ""))]
        if "editor" in fields:
            fields["editor"] = " and ".join(person(a, bibtex=True)["fullname"] for a in _people(fields["editor"]))
        if "pages" in fields:
            fields["pages"] = re.sub(r"\s*[-–—]+\s*", "-", fields["pages"])
        out.append({"type": kind, "key": k[1], "fields": fields, "authors": authors})
    return out


def _people(text: str) -> list[str]:
    """Parts at 'and' outside braces."""
    parts, depth, last = [], 0, 0
    for m in re.finditer(r"[{}]|\s+and\s+", text):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif depth == 0:
            parts.append(text[last : m.start()])
            last = m.end()
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def bibtex_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entry_idx, type, entry_key, fields MAP, authors ARRAY), one row for each entry."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [(k, i, e["type"], e["key"], e["fields"], e["authors"]) for k, t in zip(b[key], b[text]) if t is not None for i, e in enumerate(bibtex(t))]
            yield pd.DataFrame(out, columns=[key, "entry_idx", "type", "entry_key", "fields", "authors"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, entry_idx int, type string, entry_key string, fields map<string,string>, authors array<string>")


# --- names of people ---------------------------------------------------------------------------------------------------

#: Fixed values.
_PREFIXES = "dr prof professor sir dame lord lady mr mrs ms miss rev herr frau mx".split()
_SUFFIXES = "jr sr i ii iii iv v phd md bsc msc mba esq frs obe cbe".split()
_PARTICLES = "van von der den de di da del della dos du la le ter ten zu vom af al bin ibn st y e und".split()


def person(name: str, bibtex: bool = False) -> dict:
    """Parts of a name: prefix, firstname, middlename, nickname, lastname (with particles), suffix, fullname."""
    s = re.sub(r"\s+", " ", _latex(name) if bibtex else name).strip()
    nick = re.search(r"[\"“'‘(]([^\"”'’)]+)[\"”'’)](?=\s|,|$)", s)
    if nick and nick.start() > 0 and s[nick.start() - 1] == " ":
        s = re.sub(r"\s+", " ", s[: nick.start()] + s[nick.end() :]).strip()
    else:
        nick = None
    bare = lambda w: w.lower().strip(".").replace(".", "")
    parts = [p.strip() for p in s.split(",") if p.strip()]
    suffix = []
    while len(parts) > 1 and all(bare(w) in _SUFFIXES for w in parts[-1].split()):
        suffix.insert(0, parts.pop())
    if len(parts) > 1:
        last, first = parts[0].split(), " ".join(parts[1:]).split()
    else:
        ws = parts[0].split() if parts else []
        while len(ws) > 2 and bare(ws[-1]) in _SUFFIXES:
            suffix.insert(0, ws.pop())
        lead = 0
        while lead < len(ws) and bare(ws[lead]) in _PREFIXES:
            lead += 1
        start = next((i for i in range(max(lead + 1, 1), len(ws) - 1) if bare(ws[i]) in _PARTICLES and bare(ws[i]) not in ("y", "e", "und")), None)
        if start is None and len(ws) > 1 and bare(ws[lead]) in _PARTICLES and lead < len(ws) - 1 and lead == 0 and ws[0][0].islower():
            start = 0
        if start is None:
            joined = next((i for i in range(lead + 1, len(ws) - 1) if ws[i] in ("y", "e", "und")), None)
            start = joined - 1 if joined is not None and joined - 1 > lead else max(len(ws) - 1, lead)
        first, last = ws[:start], ws[start:]
    prefix = []
    while first and bare(first[0]) in _PREFIXES:
        prefix.append(first.pop(0))
    out = {"prefix": " ".join(prefix), "firstname": " ".join(first[:1]), "middlename": " ".join(first[1:]), "nickname": nick[1] if nick else "", "lastname": " ".join(last), "suffix": " ".join(suffix)}
    shown = [out["prefix"], out["firstname"], out["middlename"], f"“{out['nickname']}”" if nick else "", out["lastname"]]
    out["fullname"] = " ".join(x for x in shown if x) + (f", {out['suffix']}" if suffix else "")
    return {k: v or None for k, v in out.items()}


def _plain(s: str | None) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c))
    return re.sub(r"[^a-z ]", "", s.lower()).strip()


def could_be(a: str, b: str) -> bool:
    """Whether two names may be one person's: equal family names, and given names that don't differ, an initial
    standing for any name that begins so. Missing parts don't speak against it."""
    x, y = person(a), person(b)
    if _plain(x["lastname"]) != _plain(y["lastname"]):
        return False
    for part in ("firstname", "middlename", "suffix"):
        p, q = _plain(x[part]), _plain(y[part])
        if not p or not q:
            continue
        nick = {_plain(x["nickname"]), _plain(y["nickname"])}
        if not (p.startswith(q) if len(q) == 1 else q.startswith(p) if len(p) == 1 else p == q) and not (part == "firstname" and nick & {p, q} - {""}):
            return False
    return True


PERSON = T.StructType([T.StructField(k, T.StringType()) for k in ("prefix", "firstname", "middlename", "nickname", "lastname", "suffix", "fullname")])


@F.pandas_udf(PERSON)
def person_struct(s: pd.Series) -> pd.DataFrame:
    rows = [person(x) if x else dict.fromkeys(PERSON.names) for x in s]
    return pd.DataFrame(rows, columns=PERSON.names)


@F.pandas_udf(T.BooleanType())
def could_be_same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else could_be(x, y) for x, y in zip(a, b)], dtype="boolean")


# --- XMP -----------------------------------------------------------------------------------------------------------------

#: Prefixes of the namespaces of XMP.
_SPACES = {
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf", "http://purl.org/dc/elements/1.1/": "dc", "http://ns.adobe.com/xap/1.0/": "xap", "http://ns.adobe.com/pdf/1.3/": "pdf",
    "http://ns.adobe.com/xap/1.0/mm/": "xapmm", "http://ns.adobe.com/pdfx/1.3/": "pdfx", "http://prismstandard.org/namespaces/basic/2.0/": "prism", "http://crossref.org/crossmark/1.0/": "crossmark",
    "http://ns.adobe.com/xap/1.0/rights/": "rights", "http://www.w3.org/XML/1998/namespace": "xml",
}


def xmp(text: str) -> dict[str, object]:
    """'prefix:name' -> text, list (sequences and bags) or map (alternatives by language) of an XMP packet."""
    start, end = text.find("<x:xmpmeta"), text.rfind("</x:xmpmeta>")
    body = text[start : end + len("</x:xmpmeta>")] if start >= 0 and end > start else text
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return {}
    rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"

    def name(tag: str) -> str:
        space, _, local = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
        return f"{_SPACES.get(space, space)}:{local}" if space else local

    out: dict[str, object] = {}
    for d in root.iter(rdf + "Description"):
        out |= {name(k): v for k, v in d.attrib.items() if not k.startswith(rdf)}
        for c in d:
            listed = [li for kind in ("Seq", "Bag") for x in c.findall(rdf + kind) for li in x.findall(rdf + "li")]
            alternatives = [li for x in c.findall(rdf + "Alt") for li in x.findall(rdf + "li")]
            if listed:
                out[name(c.tag)] = [(li.text or "").strip() for li in listed]
            elif alternatives:
                out[name(c.tag)] = {li.attrib.get("{http://www.w3.org/XML/1998/namespace}lang", "x-default"): (li.text or "").strip() for li in alternatives}
            elif c.text and c.text.strip():
                out[name(c.tag)] = c.text.strip()
    return out


def xmp_column(c: Column) -> Column:
    """MAP<STRING,STRING> of a column of packets; lists and alternatives as JSON."""
    import json

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in xmp(x).items()})

    return run(c)
