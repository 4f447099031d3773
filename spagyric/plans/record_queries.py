"""Queries over readers, extraction, resolving, relations and evaluation, with the SQL they are held against.

Text is rendered from typed columns and read back; the SQL computes the answer from the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spagyric.operators import evaluate as E
from spagyric.operators import extract as X
from spagyric.operators import grammar as G
from spagyric.operators import resolve as R
from spagyric.operators.parsers import PatternParser
from spagyric.operators.relations import Snowball, cosine_column, relations
from spagyric.operators.tagging import Perceptron, clauses, name_dictionary, regex_tagger
from spagyric.operators.tokens import section_filter, sentences
from spagyric.session import shared_folder, table
from spagyric.sources import biblio as B
from spagyric.sources.readers import elements, metadata
from spagyric.sources.scrape import DOCUMENT, Entity, Field, scrape
from spagyric.spec.models import COMPOUND, CURIE_TEMPERATURE, ELECTROCHEMICAL_POTENTIAL, FLUORESCENCE_LIFETIME, MELTING_POINT, NEEL_TEMPERATURE, NMR_SPECTRUM, QUANTUM_YIELD, UVVIS_SPECTRUM, Model
from spagyric.spec.models import Field as ModelField
from spagyric.streaming.documents import counts_by_window

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _number(c: str) -> Column:
    return F.col(c).cast("string")


# --- readers ---------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    n, r = F.col("n_name"), F.col("n_regionkey")
    html = text(
        "<!DOCTYPE html><html lang=\"en\"><head><title>x</title><meta name=\"citation_title\" content=\"On ", n, "\"><meta name=\"citation_author\" content=\"A. ", n, "\"><meta name=\"citation_author\" content=\"B. Other\">",
        "<meta name=\"citation_doi\" content=\"10.5555/", F.col("n_nationkey"), "\"><script>var p = '<p>no</p>';</script></head><body><nav><p>menu</p></nav><article><h1>On ", n, "</h1><h2 id=\"s1\">Results</h2><p>First <b>", n, "</b> line<br>Second line <a href=\"#t1\">1</a>",
        "<p>Unclosed &amp; plain<table id=\"t1\"><caption>Table of ", n, "</caption><tr><th>Key<th colspan=2>Region</tr><tr><td rowspan=2>", F.col("n_nationkey"), "<td>", r, "<td>a</tr><tr><td>", r, "<td>b</tr></table>",
        "<figure id=\"f1\"><img src=\"", n, ".png\"><figcaption>Map of ", n, "</figcaption></figure></article></body></html>",
    )
    return table(spark, d, "nation").select("n_nationkey", html.alias("content"), "n_name")


@query("""
select n_nationkey, el_idx, el_type, t as text from nation, lateral (values (0, 'Title', 'On ' || n_name), (1, 'Heading', 'Results'), (2, 'Paragraph', 'First ' || n_name || ' line'), (3, 'Paragraph', 'Second line 1'), (4, 'Paragraph', 'Unclosed & plain'), (5, 'Table', 'Table of ' || n_name), (6, 'Figure', 'Map of ' || n_name)) as v(el_idx, el_type, t)
""")
def html_elements(spark: SparkSession, d: str) -> DataFrame:
    return elements(_pages(spark, d), "n_nationkey").select("n_nationkey", "el_idx", "el_type", "text")


@query("""
select n_nationkey, [['Key', 'Region', 'Region'], [cast(n_nationkey as varchar), cast(n_regionkey as varchar), 'a'], [cast(n_nationkey as varchar), cast(n_regionkey as varchar), 'b']] as grid, 't1' as el_id from nation
""")
def html_table_spans(spark: SparkSession, d: str) -> DataFrame:
    return elements(_pages(spark, d), "n_nationkey").where("el_type = 'Table'").select("n_nationkey", "grid", "el_id")


@query("select n_nationkey, n_name || '.png' as link, 'f1' as figure, ['t1'] as refs from nation")
def html_figures_and_references(spark: SparkSession, d: str) -> DataFrame:
    els = elements(_pages(spark, d), "n_nationkey")
    refs = els.where("size(refs) > 0").groupBy("n_nationkey").agg(F.array_distinct(F.flatten(F.collect_list("refs"))).alias("refs"))
    return els.where("el_type = 'Figure'").select("n_nationkey", F.get(F.col("links"), F.lit(0)).alias("link"), F.col("el_id").alias("figure")).join(refs, "n_nationkey")


@query("select n_nationkey, 'On ' || n_name as title, ['A. ' || n_name, 'B. Other'] as authors, '10.5555/' || n_nationkey as doi, 'en' as language from nation")
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    return metadata(_pages(spark, d), "n_nationkey").select("n_nationkey", "title", "authors", "doi", "language")


@query("select n_nationkey, 'On ' || n_name as title, len(['A. ' || n_name, 'B. Other']) as authors, '10.5555/' || n_nationkey as doi from nation")
def scraped_entities(spark: SparkSession, d: str) -> DataFrame:
    return scrape(_pages(spark, d), "n_nationkey", "content", DOCUMENT).select("n_nationkey", "title", F.size("authors").cast("bigint").alias("authors"), "doi")


@query("select n_nationkey, cast(n_nationkey as varchar) as first, cast(n_regionkey as bigint) as region from nation where true union all select n_nationkey, cast(n_regionkey as varchar), null from nation")
def scraped_rows(spark: SparkSession, d: str) -> DataFrame:
    row = Entity({"first": Field("td:first-child"), "region": Field("td[rowspan] + td", kind="int")})
    return scrape(_pages(spark, d), "n_nationkey", "content", row, roots="tr").where("first is not null").select("n_nationkey", "first", "region")


@query("""
select r_regionkey, el_idx, el_type, t as text from region, lateral (values (0, 'Title', r_name), (1, 'Paragraph', 'Abstract of ' || r_name), (2, 'Heading', 'Methods'), (3, 'Paragraph', 'We did it.'), (4, 'Citation', 'Someone 2001')) as v(el_idx, el_type, t)
""")
def jats_elements(spark: SparkSession, d: str) -> DataFrame:
    xml = text("<?xml version=\"1.0\"?><!DOCTYPE article PUBLIC \"-//NLM//DTD Journal\"><article><front><article-meta><title-group><article-title>", F.col("r_name"), "</article-title></title-group><abstract><p>Abstract of ", F.col("r_name"), "</p></abstract></article-meta></front><body><sec><title>Methods</title><p>We <italic>did</italic> it.</p></sec></body><back><ref-list><ref><mixed-citation>Someone 2001</mixed-citation></ref></ref-list></back></article>")
    return elements(table(spark, d, "region").select("r_regionkey", xml.alias("content")), "r_regionkey").select("r_regionkey", "el_idx", "el_type", "text")


@query("select n_nationkey, n_name as heading, 'kept' as text from nation where n_regionkey <> 1")
def section_gates(spark: SparkSession, d: str) -> DataFrame:
    els = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.struct(F.lit(0).alias("el_idx"), F.lit("Heading").alias("el_type"), F.when(F.col("n_regionkey") == 1, "References").otherwise(F.col("n_name")).alias("text")), F.struct(F.lit(1).alias("el_idx"), F.lit("Paragraph").alias("el_type"), F.lit("kept").alias("text")))).alias("e")).select(F.col("n_nationkey").alias("doc_id"), "e.*")
    return section_filter(els, skip="references").where("el_type = 'Paragraph'").select(F.col("doc_id").alias("n_nationkey"), "heading", "text")


# --- bibliography ------------------------------------------------------------------------------------------------------


@query("""
select n_nationkey, e as entry_idx, 'K' || n_nationkey || case e when 0 then 'a' else 'b' end as entry_key, case e when 0 then 'On ' || n_name else 'Second' end as title, case e when 0 then ['Ann Lee', 'Bo van Dyk'] else ['Only One'] end as authors, case e when 0 then '1693-1697' end as pages from nation, range(2) t(e)
""")
def bibtex_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    bib = text("@Article{K", k, "a, title = {On {", F.col("n_name"), "}},\n author = \"Lee, Ann and van Dyk, Bo\", pages=\"1693--1697\", year = 2001}\n@comment{x}\n@book{K", k, "b, title=\"Sec\" # \"ond\", author={Only One}}")
    out = B.bibtex_entries(table(spark, d, "nation").select("n_nationkey", bib.alias("bib")), "n_nationkey", "bib")
    return out.select("n_nationkey", F.col("entry_idx").cast("bigint").alias("entry_idx"), "entry_key", F.col("fields")["title"].alias("title"), "authors", F.col("fields")["pages"].alias("pages"))


@query("select s_suppkey, 'Sup' || s_suppkey as last, 'Ludwig' as first, 'van' is not null as same, false as other from supplier")
def person_names(spark: SparkSession, d: str) -> DataFrame:
    last = text("Sup", F.col("s_suppkey"))
    p = B.person_struct(F.concat(last, F.lit(", Ludwig M.")))
    return table(spark, d, "supplier").select("s_suppkey", p["lastname"].alias("last"), p["firstname"].alias("first"), B.could_be_same(F.concat(last, F.lit(", Ludwig M.")), F.concat(F.lit("L. "), last)).alias("same"), B.could_be_same(F.concat(last, F.lit(", Ludwig")), F.concat(F.lit("Karl "), last)).alias("other"))


@query("select r_regionkey, r_name as title, '[\"A\", \"B\"]' as creators from region")
def xmp_packets(spark: SparkSession, d: str) -> DataFrame:
    packet = text("<?xpacket?><x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><rdf:Description xmlns:pdf='http://ns.adobe.com/pdf/1.3/' xmlns:dc='http://purl.org/dc/elements/1.1/'><pdf:Title>", F.col("r_name"), "</pdf:Title><dc:creator><rdf:Seq><rdf:li>A</rdf:li><rdf:li>B</rdf:li></rdf:Seq></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>")
    return table(spark, d, "region").select("r_regionkey", B.xmp_column(packet).alias("m")).select("r_regionkey", F.col("m")["pdf:Title"].alias("title"), F.col("m")["dc:creator"].alias("creators"))


# --- extraction ----------------------------------------------------------------------------------------------------------


def _payload(df: DataFrame, *fields: str) -> DataFrame:
    return df.select("*", *(F.get_json_object("payload", f"$.{f}").alias(f.rpartition(".")[2].partition("[")[0]) for f in fields))


@query("select p_partkey, cast(p_size as varchar) || '–' || (p_size + 5) as raw_value, '°C' as raw_units, 'melting point' as specifier, 'Celsius^(1.0)' as units, round(p_size + 273.15, 6) as low, round(p_size + 278.15, 6) as high from part")
def auto_sentence_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sentences rendered from parts, melting ranges read back and brought to kelvin."""
    part = table(spark, d, "part").select("p_partkey", text(F.col("p_name"), " has a melting point of ", F.col("p_size"), "–", F.col("p_size") + 5, " °C.").alias("text"))
    out = _payload(X.records(part, ["p_partkey"], [MELTING_POINT]), "raw_value", "raw_units", "specifier", "units")
    from spagyric.functions.quantity import values

    v = F.transform(values(F.col("raw_value")), lambda x: F.round(x + 273.15, 6))
    return out.select("p_partkey", "raw_value", "raw_units", "specifier", "units", F.get(v, F.lit(0)).alias("low"), F.get(v, F.lit(1)).alias("high"))


@query("select p_brand, count(*) as n, round(avg(p_size + 273.15), 4) as kelvin from part group by p_brand")
def melting_range_by_brand(spark: SparkSession, d: str) -> DataFrame:
    found = auto_sentence_roundtrip(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return found.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("low"), 4).alias("kelvin"))


@query("""
select p_partkey, i as form, cast(p_size as varchar) as raw_value, 'K' as raw_units, 'melting point' as specifier, '2-chloro' || case p_size % 2 when 0 then 'benzamide' else 'phenol' end as name from part, range(4) as t(i)
""")
def template_orderings_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = text("2-chloro", F.when(F.col("p_size") % 2 == 0, "benzamide").otherwise("phenol"))
    v = F.col("p_size")
    forms = F.array(text(n, " with a melting point of ", v, " K was used"), text("A melting point of ", v, " K in ", n), text(v, " K, corresponding to the melting point of ", n), text("The melting point for ", n, " is ", v, " K."))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(forms).alias("form", "text"))
    out = _payload(X.records(rows, ["p_partkey", "form"], [MELTING_POINT]), "raw_value", "raw_units", "specifier", "compound.names[0]")
    return out.select("p_partkey", F.col("form").cast("bigint").alias("form"), "raw_value", "raw_units", "specifier", F.get_json_object("payload", "$.compound.names[0]").alias("name"))


@query("""
select p_partkey, v as raw_value, n as name from part, lateral (values (cast(p_size as varchar), 'ethanol'), (cast(p_size + 7 as varchar), 'toluene')) as x(v, n)
""")
def paired_lists_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    s = text("The melting points of ethanol and toluene are ", F.col("p_size"), " K and ", F.col("p_size") + 7, " K, respectively.")
    out = X.records(table(spark, d, "part").select("p_partkey", s.alias("text")), ["p_partkey"], [MELTING_POINT])
    return out.select("p_partkey", F.get_json_object("payload", "$.raw_value").alias("raw_value"), F.get_json_object("payload", "$.compound.names[0]").alias("name"))


_PROPERTIES = """
select p_partkey, m as model, v as raw_value, case p_size % 3 when 0 then 'BiFeO3' when 1 then 'barium titanate' else 'MnO' end as name from part,
lateral (values ('NeelTemperature', cast(p_size as varchar)), ('CurieTemperature', cast(p_size + 400 as varchar))) as x(m, v)
"""


@query(_PROPERTIES)
def two_properties_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Two properties stated in one sentence, in six forms: every value goes to its own property."""
    size = F.col("p_size")
    n = F.when(size % 3 == 0, "BiFeO3").when(size % 3 == 1, "barium titanate").otherwise("MnO")
    t, c = size, size + 400
    forms = [
        text(n, " has TN of ", t, " K and Tc of ", c, " K."), text("The Curie and Neel temperatures of ", n, " are ", c, " K and ", t, " K, respectively."), text("For ", n, " we found a Neel temperature of ", t, " K; its Curie temperature is ", c, " K in ", n, "."),
        text("A TN of ", t, " K and a Tc of ", c, " K were measured for ", n, " at 5 bar."), text("The Neel temperature (", t, " K) and the Curie temperature (", c, " K) of ", n, " differ."), text(n, " shows Neel and Curie temperatures of ", t, " and ", c, " K."),
    ]
    form = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    out = X.records(table(spark, d, "part").select("p_partkey", form.alias("text")), ["p_partkey"], [CURIE_TEMPERATURE, NEEL_TEMPERATURE])
    return out.select("p_partkey", "model", F.get_json_object("payload", "$.raw_value").alias("raw_value"), F.get_json_object("payload", "$.compound.names[0]").alias("name"))


@query("""
select p_partkey, cast(v as varchar) as raw_value, n as name from part,
lateral (select unnest(case p_partkey % 6 when 0 then [p_size + 1, p_size + 2] when 1 then [p_size + 1, p_size + 2, p_size + 3] when 2 then [p_size + 1, p_size + 2, p_size + 3] when 3 then [p_size + 1, p_size + 2] when 4 then [p_size + 1] else [p_size + 1, p_size + 2] end) as v,
unnest(case p_partkey % 6 when 0 then ['MnO', 'MnO'] when 1 then ['MnO', 'FeO', 'CoO'] when 2 then ['MnO', 'FeO', 'CoO'] when 3 then ['MnO', 'FeO'] when 4 then ['MnO'] else ['MnO', 'FeO'] end) as n) as x(v, n)
""")
def entity_shapes_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The shapes of statements with several entities: one compound with several values, lists of compounds in front of and
    behind their values, values beside their compounds, a value among others that are none, separate statements."""
    a, b, c = (F.col("p_size") + i for i in (1, 2, 3))
    forms = [
        text("The Curie temperature of MnO was ", a, " K and ", b, " K."), text("The Curie temperatures of MnO, FeO and CoO are ", a, ", ", b, " and ", c, " K, respectively."), text("MnO, FeO and CoO have Curie temperatures of ", a, " K, ", b, " K and ", c, " K."),
        text("The Curie temperature rises from ", a, " K in MnO to ", b, " K in FeO."), text("At 300 K the Curie temperature of MnO was measured as ", a, " K."), text("MnO has a Curie temperature of ", a, " K, while FeO has a Curie temperature of ", b, " K."),
    ]
    form = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    out = X.records(table(spark, d, "part").select("p_partkey", form.alias("text")), ["p_partkey"], [CURIE_TEMPERATURE])
    return out.select("p_partkey", F.get_json_object("payload", "$.raw_value").alias("raw_value"), F.get_json_object("payload", "$.compound.names[0]").alias("name"))


@query("""
select p_partkey, case p_size % 3 when 0 then 'QuantumYield' when 1 then 'FluorescenceLifetime' else 'ElectrochemicalPotential' end as model,
case p_size % 3 when 0 then '0.' || p_size when 1 then p_size || '.5' else '-0.' || p_size end as value, case p_size % 3 when 0 then null when 1 then 'ns' else 'V' end as units, 'ferrocene' as name from part
""")
def models_without_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Models whose fields have patterns and that are no quantities."""
    k = F.col("p_size")
    s = F.when(k % 3 == 0, text("The quantum yield of ferrocene was 0.", k, " in ethanol.")).when(k % 3 == 1, text("For ferrocene a lifetime of ", k, ".5 ns was found.")).otherwise(text("The reduction potential of ferrocene is -0.", k, " V."))
    out = X.records(table(spark, d, "part").select("p_partkey", s.alias("text")), ["p_partkey"], [QUANTUM_YIELD, FLUORESCENCE_LIFETIME, ELECTROCHEMICAL_POTENTIAL])
    return _payload(out, "value", "units").select("p_partkey", "model", "value", "units", F.get_json_object("payload", "$.compound.names[0]").alias("name"))


_YIELD = Model("Yield", (ModelField("value", required=True), ModelField("units"), ModelField("remarks", ("list", "string")), ModelField("compound", COMPOUND, contextual=True)))


@query("""
select p_partkey, cast(p_size as varchar) as value, '%' as units, case p_size % 3 when 0 then ['crude'] when 1 then ['isolated', 'pure'] end as remarks, case p_size % 2 when 0 then 'ferrocene' else 'potassium bromide' end as name from part where p_size % 5 > 0
""")
def pattern_parser(spark: SparkSession, d: str) -> DataFrame:
    """A parser of a model of one's own: a pattern of words, tags and repetitions, run over the tagged words of every sentence,
    its named nodes read as fields. Sentences in which only the words differ give nothing."""
    cem = (G.Tag("B-CM") + G.some(G.Tag("I-CM"))).named("names").then(G.join)
    remark = (G.IWord("crude") | G.IWord("isolated") | G.IWord("pure")).named("remarks")
    number = (G.Regex(r"^\d+$") & ~G.Word("100")).named("value")
    root = G.Group(cem).named("compound") + G.Word("was").hidden() + G.SkipTo(number).hidden() + number + G.Word("%").named("units") + G.maybe(G.Word("yield").hidden() + G.Word("(").hidden() + G.many(remark + G.some(G.Word(",").hidden())) + G.Word(")").hidden()) + (G.End() ^ G.Word(".")).hidden()
    k = F.col("p_size")
    n = F.when(k % 2 == 0, "ferrocene").otherwise("potassium bromide")
    tail = F.when(k % 3 == 0, " yield (crude)").when(k % 3 == 1, " yield (isolated, pure)").otherwise("")
    s = F.when(k % 5 == 0, text(n, " will be made in ", k, " minutes.")).otherwise(text("Then ", n, " was obtained in ", k, " %", tail, "."))
    out = X.records(table(spark, d, "part").select("p_partkey", s.alias("text")), ["p_partkey"], [], parsers=[PatternParser(_YIELD, root, trigger=("%",))])
    p = F.from_json("payload", "value string, units string, remarks array<string>, compound struct<names: array<string>>").alias("p")
    return out.select("p_partkey", p).select("p_partkey", "p.value", "p.units", "p.remarks", F.get(F.col("p.compound.names"), F.lit(0)).alias("name"))


@query("""
select p_partkey, case s when 0 then cast(p_size + 300 as varchar) when 1 then cast(p_size + 400 as varchar) else cast(p_size + 500 as varchar) end as raw_value,
case s when 0 then ['4-bromotoluene'] when 1 then case p_size % 2 when 0 then ['DMP', 'dimethylphenol'] else ['dimethylphenol'] end else ['2-chlorobenzamide'] end as names from part, range(3) t(s) where not (s = 2 and p_size % 3 = 0)
""")
def rendered_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages rendered from parts and taken through all of the pipeline: a value under the heading that names its compound, one
    under the abbreviation that another section defines, one in a table, and one in the references, which are skipped."""
    from spagyric.api import extract

    k = F.col("p_size")
    short = F.when(k % 2 == 0, "We used dimethylphenol (DMP) throughout.").otherwise("We used it throughout.")
    name = F.when(k % 2 == 0, "DMP").otherwise("dimethylphenol")
    cells = F.when(k % 3 == 0, "").otherwise(text("<table><caption>Data</caption><tr><th>Compound<th>mp (K)</tr><tr><td>2-chlorobenzamide<td>", k + 500, "</tr></table>"))
    page = text(
        "<html><head><title>x</title></head><body><h1>Report ", F.col("p_partkey"), "</h1><h2>Preparation of 4-bromotoluene</h2><p>It was heated. The melting point was ", k + 300, " K.</p><h2>Methods</h2><p>", short, "</p><p>The melting point of ", name, " was ", k + 400, " K.</p>",
        cells, "<h2>References</h2><p>A melting point of 7 K was found for toluene.</p></body></html>",
    )
    docs = table(spark, d, "part").select("p_partkey", page.alias("content"))
    out = extract(docs, [MELTING_POINT, COMPOUND], "p_partkey", skip_section="^references$").where("model = 'MeltingPoint'")
    p = F.from_json("payload", "raw_value string, compound struct<names: array<string>>").alias("p")
    return out.select("p_partkey", p).select("p_partkey", "p.raw_value", F.col("p.compound.names").alias("names"))


@query("""
select rec_id, doc_id, cast(row_number() over (partition by doc_id order by coalesce(list_min(list_filter(map_values(confidence), lambda x: x is not null)), 0) desc, el_idx, sent_idx, rec_idx, rec_id) as integer) as rank
from (select distinct on (rec_id) * from mp_records) qualify rank <= 2
""")
def surest_records(spark: SparkSession, d: str) -> DataFrame:
    """The two surest records of every document."""
    from spagyric.api import ranked

    mp = table(spark, d, "mp_records").dropDuplicates(["rec_id"]).select("rec_id", "doc_id", "el_idx", "sent_idx", F.struct("rec_idx", "rec_id").alias("rec_idx"), "confidence")
    return ranked(mp, ["doc_id"], 2).select("rec_id", "doc_id", "rank")


@query("select p_partkey, '4-bromotoluene' as name, p_size || 'b' as label, 'product' as role from part")
def compound_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", text("We isolated the product 4-bromotoluene (", F.col("p_size"), "b) in good yield.").alias("text"))
    out = X.records(rows, ["p_partkey"], [COMPOUND])
    return out.select("p_partkey", F.get_json_object("payload", "$.names[0]").alias("name"), F.get_json_object("payload", "$.labels[0]").alias("label"), F.get_json_object("payload", "$.roles[0]").alias("role"))


@query("select p_partkey, 'Tz' as specifier, cast(p_size + 300 as varchar) as raw_value from part")
def forward_definitions(spark: SparkSession, d: str) -> DataFrame:
    """A symbol that one sentence defines is understood in the next ones of the document, not before."""
    s = F.array(text("Tz of it was 7 K."), text("We studied the Curie temperature, Tz, of it."), text("Tz was ", F.col("p_size") + 300, " K."))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(s).alias("sent_idx", "text"))
    rows = X.with_definitions(rows, "p_partkey", ["sent_idx"], [CURIE_TEMPERATURE])
    out = X.records(rows, ["p_partkey", "sent_idx"], [CURIE_TEMPERATURE], specifiers="specifiers")
    return out.select("p_partkey", F.get_json_object("payload", "$.specifier").alias("specifier"), F.get_json_object("payload", "$.raw_value").alias("raw_value"))


@query("select distinct unnest([lower(p_brand) || '-oxide', replace(lower(p_brand) || '-oxide', '-', ' ')]) as phrase from part")
def dictionary_of_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.explode(F.array(text("(", F.col("p_brand"), "-Oxide)"), text(F.col("p_brand"), "-oxide  [USP]"), F.lit("12"), F.lit("solution"))).alias("name"))
    return name_dictionary(names, "name")


_PEAKS = """
with clean as (select rec_id, list_filter(peaks, lambda p: p is not null and regexp_matches(p.shift, '^-?[0-9]+\\.[0-9]+$')) as ps from (select distinct on (rec_id) * from nmr_records)),
found as (select rec_id, ps from clean where len(ps) > 0)
"""


@query(_PEAKS + "select rec_id, list_transform(ps, lambda p: p.shift) as shifts, cast(len(ps) as bigint) as n, '1H' as nucleus, '400' as frequency, 'DMSO' as solvent from found")
def nmr_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Spectra rendered from the peaks of the records and read back."""
    clean = F.filter("peaks", lambda p: p.isNotNull() & p["shift"].rlike(r"^-?[0-9]+\.[0-9]+$"))
    rows = table(spark, d, "nmr_records").dropDuplicates(["rec_id"]).select("rec_id", clean.alias("ps")).where("size(ps) > 0")
    shown = F.transform("ps", lambda p: F.concat(p["shift"], F.lit(" (d, J = 9.3 Hz, 1H)")))
    s = F.concat(F.lit("1H NMR (400 MHz, DMSO) δ "), F.array_join(shown, ", "), F.lit("."))
    out = X.records(rows.select("rec_id", s.alias("text")), ["rec_id"], [NMR_SPECTRUM])
    p = F.from_json("payload", "nucleus string, frequency string, solvent string, peaks array<struct<shift: string, multiplicity: string, number: string>>").alias("p")
    return out.select("rec_id", p).select("rec_id", F.col("p.peaks.shift").alias("shifts"), F.size(F.filter("p.peaks", lambda x: (x["multiplicity"] == "d") & (x["number"] == "1H"))).cast("bigint").alias("n"), "p.nucleus", "p.frequency", "p.solvent")


@query("select p_partkey, [cast(200 + p_size as varchar), cast(400 + p_size as varchar)] as peaks, 'water' as solvent from part")
def uvvis_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    s = text("UV-vis (water) λmax/nm ", F.col("p_size") + 200, " (12000) and ", F.col("p_size") + 400, ".")
    out = X.records(table(spark, d, "part").select("p_partkey", s.alias("text")), ["p_partkey"], [UVVIS_SPECTRUM])
    p = F.from_json("payload", "solvent string, peaks array<struct<value: string>>")
    return out.select("p_partkey", p.alias("p")).select("p_partkey", F.col("p.peaks.value").alias("peaks"), "p.solvent")


@query("""
select r_regionkey, n_nationkey, cast(100 + n_nationkey as varchar) as raw_value, '°C' as raw_units from nation join region on n_regionkey = r_regionkey
""")
def table_records(spark: SparkSession, d: str) -> DataFrame:
    """Tables rendered from nations, one row for each, a record for each row with the unit of the header."""
    rows = F.array_sort(F.collect_list(F.array(F.concat(F.lit("compound-"), _number("n_nationkey")), _number("n_regionkey"), (F.col("n_nationkey") + 100).cast("string"))))
    grids = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(rows.alias("body"))
    grids = grids.select("r_regionkey", F.concat(F.array(F.array(F.lit("Compound"), F.lit("Region"), F.lit("mp (°C)"))), "body").alias("grid"))
    out = X.table_records(grids, ["r_regionkey"], "grid", [MELTING_POINT])
    name = F.get_json_object("payload", "$.compound.names[0]")
    return out.select("r_regionkey", F.regexp_extract(name, r"(\d+)", 1).cast("int").alias("n_nationkey"), F.get_json_object("payload", "$.raw_value").alias("raw_value"), F.get_json_object("payload", "$.raw_units").alias("raw_units"))


@query("select n_regionkey as r_regionkey, n_name as row_cat, 'Key' as col_cat, cast(n_nationkey as varchar) as data from nation")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    grids = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.array("n_name", _number("n_nationkey")))).alias("body"))
    grids = grids.select("r_regionkey", F.concat(F.array(F.array(F.lit("Name"), F.lit("Key"))), "body").alias("grid"))
    return X.cells(grids, ["r_regionkey"], "grid").select("r_regionkey", F.get(F.col("row_cats"), F.lit(0)).alias("row_cat"), F.get(F.col("col_cats"), F.lit(0)).alias("col_cat"), "data")


# --- resolving ---------------------------------------------------------------------------------------------------------


@query("""
select o_orderkey, cast(100 + o_orderkey % 200 as varchar) as raw_value, case when o_orderkey % 3 = 0 then null else '4-bromotoluene' end as name, case when o_orderkey % 3 = 0 then null else (o_orderkey % 9 + 1) || 'a' end as label from orders
""")
def contextual_merge_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The compound is named in one sentence, its melting point stated in the next one; the document joins them."""
    k = F.col("o_orderkey")
    first = F.when(k % 3 == 0, F.lit("Nothing was isolated here.")).otherwise(text("We obtained 4-bromotoluene (", k % 9 + 1, "a)."))
    docs = table(spark, d, "orders").select("o_orderkey", F.lit(0).alias("el_idx"), F.concat(first, text(" The melting point was ", k % 200 + 100, " K.")).alias("t"))
    found = X.records(sentences(docs, ["o_orderkey", "el_idx"], "t"), ["o_orderkey", "el_idx", "sent_idx"], [MELTING_POINT]).unionByName(X.records(sentences(docs, ["o_orderkey", "el_idx"], "t"), ["o_orderkey", "el_idx", "sent_idx"], [COMPOUND]))
    out = R.resolve(found, [MELTING_POINT, COMPOUND], "o_orderkey").where("model = 'MeltingPoint'")
    get = lambda p: F.get_json_object("payload", p)
    return out.select("o_orderkey", get("$.raw_value").alias("raw_value"), get("$.compound.names[0]").alias("name"), get("$.compound.labels[0]").alias("label"))


_PARTIAL = """
with r as (select distinct l_orderkey, case when l_linenumber % 2 = 0 then l_returnflag end as a, case when l_linenumber % 3 > 0 then l_linestatus end as b, case when l_linenumber % 4 = 1 then cast(l_suppkey % 5 as varchar) end as c from lineitem)
"""


@query(_PARTIAL + """
select r.* from r where not exists (select 1 from r q where q.l_orderkey = r.l_orderkey and (r.a is null or r.a = q.a) and (r.b is null or r.b = q.b) and (r.c is null or r.c = q.c) and (case when q.a is null then 0 else 1 end + case when q.b is null then 0 else 1 end + case when q.c is null then 0 else 1 end) > (case when r.a is null then 0 else 1 end + case when r.b is null then 0 else 1 end + case when r.c is null then 0 else 1 end))
""")
def subset_removal(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    li = table(spark, d, "lineitem").select("l_orderkey", F.when(n % 2 == 0, F.col("l_returnflag")).alias("a"), F.when(n % 3 > 0, F.col("l_linestatus")).alias("b"), F.when(n % 4 == 1, (F.col("l_suppkey") % 5).cast("string")).alias("c"))
    return R.without_subsets(li, ["l_orderkey"], ["a", "b", "c"])


@query("""
with x as (select doc_id, compound.names as n, compound.labels as l from mp_records where doc_id is not null)
select doc_id, coalesce(list_sort(list_filter(list_distinct(flatten(list(n) filter (n is not null))), lambda v: v is not null)), []) as names, coalesce(list_sort(list_filter(list_distinct(flatten(list(l) filter (l is not null))), lambda v: v is not null)), []) as labels from x group by doc_id
""")
def compound_union(spark: SparkSession, d: str) -> DataFrame:
    mp = table(spark, d, "mp_records").where("doc_id is not null").select("doc_id", F.col("compound.names").alias("names"), F.col("compound.labels").alias("labels"))
    return R.union_of(mp, ["doc_id"], ["names", "labels"])


@query("select rec_id, list_min(map_values(confidence)) as pooled, confidence['raw_value'] as own from mp_records")
def confidence_pooling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mp_records").select("rec_id", R.pooled_confidence(F.col("confidence")).alias("pooled"), F.col("confidence")["raw_value"].alias("own"))


# --- relations, tagging and evaluation -----------------------------------------------------------------------------------


@query("""
with x as (select p_partkey, list_distinct(string_split(lower(p_name || ' of the ' || p_type), ' ')) as a, ['of', 'the', 'steel', 'brass'] as b from part)
select p_partkey, round(len(list_intersect(a, b)) / sqrt(len(a) * 4), 9) as score from x
""")
def phrase_similarity(spark: SparkSession, d: str) -> DataFrame:
    a = F.split(F.lower(text(F.col("p_name"), " of the ", F.col("p_type"))), " ")
    return table(spark, d, "part").select("p_partkey", F.round(cosine_column(a, F.array(*map(F.lit, ("of", "the", "steel", "brass")))), 9).alias("score"))


@query("select p_partkey, 'x' || p_partkey as name, cast(p_size as varchar) as value from part where p_size % 2 = 0")
def snowball_relations(spark: SparkSession, d: str) -> DataFrame:
    """A model learned from one sentence finds the same relation where the words between are the same."""
    model = Snowball(("name", "value"), tc=0.9, tsim=0.9)
    model.learn("the Curie temperature of MnO is 120 K ,".split(), [("MnO", "name", 4, 5), ("120", "value", 6, 7)])
    even = F.col("p_size") % 2 == 0
    ws = F.array(*map(F.lit, ("the", "Curie", "temperature", "of")), text("x", F.col("p_partkey")), F.when(even, "is").otherwise("exceeds"), _number("p_size"), F.lit("K"), F.lit(","))
    entity = lambda t, kind, a: F.struct(t.alias("text"), F.lit(kind).alias("tag"), F.lit(a).alias("start"), F.lit(a + 1).alias("end"))
    rows = table(spark, d, "part").select("p_partkey", ws.alias("ws"), F.array(entity(text("x", F.col("p_partkey")), "name", 4), entity(_number("p_size"), "value", 6)).alias("es"))
    out = relations(rows, ["p_partkey"], "ws", "es", model)
    pick = lambda t: F.get(F.filter("entities", lambda e: e["tag"] == t), F.lit(0))["text"]
    return out.select("p_partkey", pick("name").alias("name"), pick("value").alias("value"))


@query("""
with g as (select o_custkey % 50 as k, o_orderpriority as v, count(*) as n from orders where o_orderkey % 2 = 0 group by all),
f as (select o_custkey % 50 as k, o_orderpriority as v, count(*) as n from orders where o_orderkey % 2 = 1 group by all),
j as (select coalesce(g.k, f.k) as k, coalesce(g.n, 0) as g, coalesce(f.n, 0) as f from g full join f on g.k = f.k and g.v = f.v)
select k, sum(least(g, f))::bigint as tp, sum(greatest(f - g, 0))::bigint as fp, sum(greatest(g - f, 0))::bigint as fn from j group by k
""")
def multiset_score(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderpriority").alias("v"), (F.col("o_orderkey") % 2).alias("odd"))
    out = E.multiset_scores(o.where("odd = 0").select("k", "v"), o.where("odd = 1").select("k", "v"), ["k", "v"], ["k"])
    return out.select("k", "tp", "fp", "fn")


@query("select method, count(raw_units is not null) as n, count(*) filter (raw_units is not null) as right, count(*) filter (raw_units is not null) / count(*) as precision from mp_records group by method")
def precision_by_method(spark: SparkSession, d: str) -> DataFrame:
    return E.precision_by_method(table(spark, d, "mp_records").select("method", F.col("raw_units").isNotNull().alias("correct")))


@query("select p_partkey, 2 as clauses, case p_size % 2 when 0 then 'ethanol boils' else 'toluene boils' end as second from part")
def coordinated_clauses(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s):
        return s.map(lambda x: [" ".join(x.split()[i] for i in c) for c in clauses(x.split())])

    s = F.when(F.col("p_size") % 2 == 0, "toluene and ethanol boils").otherwise("ethanol and toluene boils")
    return table(spark, d, "part").select("p_partkey", run(s).alias("c")).select("p_partkey", F.size("c").alias("clauses"), F.get(F.col("c"), F.lit(1)).alias("second"))


@query()
def perceptron_tags(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names tagged by a perceptron that learned from 200 sentences tagged by rules."""
    sample = [r[0].split() for r in table(spark, d, "part").orderBy("p_partkey").select(F.concat_ws(" ", F.lit("The"), "p_name", F.lit("costs"), "p_size")).limit(200).collect()]  # the bound is the sample's size
    model = Perceptron().train([(ws, regex_tagger()(ws)) for ws in sample], rounds=3).dumps()

    def run(batches):
        import pandas as pd

        tag = Perceptron.loads(model)
        for b in batches:
            yield pd.DataFrame([(k, i, w, t) for k, ws in zip(b["p_partkey"], b["t"]) for i, (w, t) in enumerate(zip(ws.split(), tag(ws.split())))], columns=["p_partkey", "tok_idx", "word", "tag"])

    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.lit("The"), "p_name", F.lit("costs"), "p_size").alias("t"))
    return rows.mapInPandas(run, "p_partkey bigint, tok_idx int, word string, tag string")


@query()
def document_records(spark: SparkSession, d: str) -> DataFrame:
    """Melting points and compounds of all documents, their paragraphs and sentences, resolved by document."""
    from spagyric.api import extract

    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return extract(docs, [MELTING_POINT, COMPOUND, NMR_SPECTRUM, UVVIS_SPECTRUM], skip_section="^references$")


@query()
def sentence_records(spark: SparkSession, d: str) -> DataFrame:
    """Melting points of all cited sentences."""
    return X.records(table(spark, d, "sentences").select("doc_id", "el_idx", "sent_idx", "text"), ["doc_id", "el_idx", "sent_idx"], [MELTING_POINT])


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by all")
def streamed_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream, counted by hour; the result of all data available."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = counts_by_window(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", "10 minutes").select(F.col("window.start").alias("start"), "event_type", "n")
    name = f"streamed_{abs(hash((d, id(schema))))}"
    where = shared_folder(spark, "streams")
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{where}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
