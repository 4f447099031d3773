"""Queries over text functions, layers and quantities, each with the SQL it is held against.

Where the tables hold no such text, it is rendered from typed columns and must be read back; the SQL then computes
the answer from the columns and never parses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spagyric.functions import quantity as Q
from spagyric.functions import text as S
from spagyric.operators.grammar import Every, IWord, Not, Regex
from spagyric.operators.resolve import carried_forward, nearest_fill
from spagyric.operators.tagging import WORD_FORMS, dictionary_matches, mentions, regex_tag, tag_dictionary
from spagyric.operators.tokens import paragraphs, sentences, spans_between, tokens, with_heading, with_neighbours
from spagyric.session import table
from spagyric.spec import units as U

ORACLE: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- scalars ---------------------------------------------------------------------------------------------------------


@query("select p_partkey, cast(levenshtein(p_name, p_type) as integer) as distance from part")
def levenshtein_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.levenshtein(F.col("p_name"), F.col("p_type")).alias("distance"))


@query("select p_partkey, cast(0 as integer) as inside, cast(1 as integer) as off_by_one from part")
def levenshtein_substring(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("whole", F.concat(F.lit("<< "), "p_name", F.lit(" >>")))
    return part.select("p_partkey", S.levenshtein_within("p_name", "whole").alias("inside"), S.levenshtein_within(F.concat("p_name", F.lit("~")), F.col("whole")).alias("off_by_one"))


@query(r"""
with w as (select unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) as w from part),
t as (select list_aggregate(list_transform(range(1, length(w) + 1), lambda i: case when regexp_matches(substr(w, i, 1), '[0-9]') then 'd' when regexp_matches(substr(w, i, 1), '[A-Z]') then 'X' when regexp_matches(substr(w, i, 1), '[a-z]') then 'x' when regexp_matches(substr(w, i, 1), '[,$&-]') then substr(w, i, 1) when substr(w, i, 1) = '.' then '.' else '*' end), 'string_agg', '') as s from w where w <> '')
select regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'd{3,}', 'ddd', 'g'), 'x{3,}', 'xxx', 'g'), 'X{3,}', 'XXX', 'g'), '\*{3,}', '***', 'g') as shape, count(*) as n from t group by 1
""")
def word_shape_histogram(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ")).alias("w")).where("w <> ''")
    return words.groupBy(S.word_shape(F.col("w")).alias("shape")).agg(F.count("*").alias("n"))


@query(r"select doc_id, length(regexp_replace(text, '[^(\[{]', '', 'g')) - length(regexp_replace(text, '[^)\]}]', '', 'g')) as level from documents where text is not null")
def bracket_balance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.bracket_level(F.col("text")).cast("bigint").alias("level"))


@query(r"""
with e as (select doc_id, unnest(regexp_extract_all(text || ' ' || lower(coalesce(source, 'x')) || cast(doc_id as varchar) || '@mail.example.org.', '([A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})', 1)) as email from documents)
select doc_id, email from e
""")
def email_mentions(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" "), F.lower(F.coalesce("source", F.lit("x"))), F.col("doc_id").cast("string"), F.lit("@mail.example.org."))
    return table(spark, d, "documents").select("doc_id", F.explode(S.emails(text)).alias("email"))


@query("select c_custkey, 'http://shop.example.org/c/' || c_custkey as url, true as is_url from customer")
def url_querystring_strip(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("http://shop.example.org/c/"), F.col("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", S.strip_querystring(F.concat(base, F.lit("?q="), F.col("c_name"), F.lit("#top"))).alias("url"), S.like_url(base).alias("is_url"))


@query(r"""
with w as (select lang, unnest(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')) as w from documents where text is not null),
b as (select lang, replace(replace(w, ',', ''), '.', '') as w from w where w <> '')
select lang, count(*) as words, sum(case when regexp_matches(w, '^(?:\p{Nd}+|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|trillion)(?:/(?:\p{Nd}+|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|trillion))?$') then 1 else 0 end)::bigint as numbers
from b group by lang
""")
def like_number_rate(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("lang", F.explode(F.split(F.regexp_replace("text", r"[\t\n\f\r ]+", " "), " ")).alias("w")).where("w <> ''")
    return words.groupBy("lang").agg(F.count("*").alias("words"), F.count_if(S.like_number(F.col("w"))).alias("numbers"))


@query(r"select lang, count(*) as n, sum(case when regexp_matches(text, '^[\x00-\x7f]*$') then 1 else 0 end)::bigint as ascii, sum(case when regexp_matches(text, '^\p{P}*$') then 1 else 0 end)::bigint as punct from documents where text is not null group by lang")
def ascii_ratio_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(S.is_ascii(F.col("text"))).alias("ascii"), F.count_if(S.is_punct(F.col("text"))).alias("punct"))


@query("select p_partkey, cast(p_size as double) as plain, p_size + 0.25 as quarter, cast(p_size * 1000 + 500 as double) as grouped, cast(p_size as double) * 1e-3 as scientific, cast(null as double) as nothing from part")
def tolerant_floats(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    render = {"plain": F.concat(F.lit("~"), n, F.lit("(3)")), "quarter": F.concat(n, F.lit(".25 ± 0.5,")), "grouped": F.concat(n, F.lit(",500;")), "scientific": F.concat(n, F.lit(" × 10^-3")), "nothing": F.concat(F.lit("about"), n)}
    return table(spark, d, "part").select("p_partkey", *(S.to_double(c).alias(k) for k, c in render.items()))


@query("""
with k as (select p_partkey, p_partkey + 100000 as b from part),
c as (select p_partkey, b, list_sum(list_transform(range(1, length(cast(b * 100 + 42 as varchar)) + 1), lambda i: i * cast(substr(reverse(cast(b * 100 + 42 as varchar)), i, 1) as integer))) % 10 as digit from k)
select p_partkey, cast(b as varchar) || '-42-' || cast(digit as integer) as cas, cast(2 as bigint) as loose from c
""")
def cas_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A valid number and one with a wrong check digit in one sentence; the strict form finds the first."""
    part = table(spark, d, "part").withColumn("b", F.col("p_partkey") + 100000)
    digits = F.reverse((F.col("b") * 100 + 42).cast("string"))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + i * F.substring(digits, i, F.lit(1)).cast("int"))
    part = part.withColumn("check", total % 10)
    cas = lambda c: F.concat(F.col("b").cast("string"), F.lit("-42-"), c.cast("string"))
    text = F.concat_ws(" ", F.lit("see"), cas(F.col("check")), F.lit("and"), cas((F.col("check") + 1) % 10), F.lit("12-3"))
    return part.select("p_partkey", F.get(S.cas_numbers(text, strict=True), F.lit(0)).alias("cas"), F.size(S.cas_numbers(text)).cast("bigint").alias("loose"))


@query("select n_nationkey, 1 as inchikeys, 1 as inchis, 2 as smiles from nation")
def chemical_identifiers(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", F.lit("LFQSCWFLJHTTHZ-UHFFFAOYSA-N InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3 CC(=O)Oc1ccccc1C(=O)O c1ccccc1 (C"), "n_name")
    return table(spark, d, "nation").select("n_nationkey", F.size(S.inchikeys(text)).alias("inchikeys"), F.size(S.inchis(text)).alias("inchis"), F.size(F.filter(S.smiles(text), lambda x: x.rlike("[=c]"))).alias("smiles"))


@query("select p_partkey, lower(p_name) || ' sulfate of caesium aluminium' as chem, replace(lower(p_name), ' ', '') || '(x(' as excess from part")
def normalised_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower("p_name")
    return table(spark, d, "part").select("p_partkey", S.chem_normalize(F.concat(F.lit("  "), name, F.lit("  SULPHate  of Cesium Aluminum "))).alias("c"), S.excess_normalize(F.concat(name, F.lit(" [X]"))).alias("excess")).select("p_partkey", F.lower("c").alias("chem"), "excess")


@query("select s_suppkey, 'S. ' || s_name || ' and co' as chained from supplier")
def processor_chain(spark: SparkSession, d: str) -> DataFrame:
    step = S.chain(S.left_strip("Dr. ", "Mr. "), S.right_strip("'s"), S.unapostrophe, S.discard("nothing"), S.left_add("S. "), S.right_add(" & CO"), S.substitute((r"\s+&\s+co", " and co")))
    return table(spark, d, "supplier").select("s_suppkey", step(F.concat(F.lit("Dr. "), "s_name", F.lit("'s"))).alias("chained"))


@query("""
select p_brand as text, lower(p_brand) as lower, substr(p_brand, 1, 1) as first, right(p_brand, 3) as suffix, length(p_brand) as length,
length(regexp_replace(p_brand, '[^A-Z]', '', 'g')) as upper_count, length(regexp_replace(p_brand, '[^0-9]', '', 'g')) as digit_count, contains(p_brand, '-') as is_hyphenated, count(*) as n from part group by all
""")
def lexeme_features(spark: SparkSession, d: str) -> DataFrame:
    f = S.lexeme(F.col("p_brand"))
    names = ("text", "lower", "first", "suffix", "length", "upper_count", "digit_count", "is_hyphenated")
    return table(spark, d, "part").select(f.alias("f")).select(*(F.col(f"f.{n}").cast("bigint") if n in ("length", "upper_count", "digit_count") else F.col(f"f.{n}") for n in names)).toDF(*names).groupBy(*names).agg(F.count("*").alias("n"))


@query("select n_nationkey, 'é' || n_name || ' α–β ß' as unicode from nation")
def latex_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.latex_to_unicode(F.concat(F.lit("\\'{e}"), "n_name", F.lit(" $\\alpha$--{\\beta} {\\ss}"))).alias("unicode"))


# --- layers ----------------------------------------------------------------------------------------------------------


@query(r"""
with p as (select doc_id, unnest(string_split_regex(text || chr(10) || '  ' || chr(10) || coalesce(lang, '?') || chr(10), '\r?\n[ \t]*\r?\n|\r[ \t]*\r')) as p from documents where text is not null)
select doc_id, count(*) as paragraphs from p where regexp_replace(p, '[\s\p{Z}\x85\x1c-\x1f\x0b]+', '', 'g') <> '' group by doc_id
""")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("text", F.concat("text", F.lit("\n  \n"), F.coalesce("lang", F.lit("?")), F.lit("\n")))
    return paragraphs(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@query("""
select o_orderkey, i as sent_idx, case i when 0 then 'Order ' || o_orderkey || ' was placed by Dr. Smith (Fig. 2).' when 1 then 'It has the status ' || o_orderstatus || ' now.' else 'Was it paid?' end as text from orders, range(3) as t(i)
""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" was placed by Dr. Smith (Fig. 2). It has the status "), "o_orderstatus", F.lit(" now. Was it paid?"))
    return sentences(table(spark, d, "orders").select("o_orderkey", text.alias("t")), ["o_orderkey"], "t").select("o_orderkey", F.col("sent_idx").cast("bigint").alias("sent_idx"), "text")


@query(r"select p_partkey, len(regexp_extract_all(p_name || ' (' || p_brand || ')', '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]')) as n from part")
def fine_tokens(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("t", F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
    return tokens(part, ["p_partkey"], "t", "fine").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("select p_partkey, [cast(p_size as varchar), '°C', 'for', cast(p_size as varchar), 'h', ',', '2,4-dinitro(phenyl)amine', '(', p_size || 'b', ')'] as words from part")
def chemical_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    part = table(spark, d, "part").withColumn("t", F.concat(n, F.lit("°C for "), n, F.lit(" h, 2,4-dinitro(phenyl)amine ("), n, F.lit("b)")))
    return tokens(part, ["p_partkey"], "t").groupBy("p_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "text"))), lambda x: x["text"]).alias("words"))


@query("select n_nationkey, string_split(n_name, 'A') as parts from (select n_nationkey, regexp_replace(regexp_replace(n_name, 'A+', 'A', 'g'), '^A|A$', '', 'g') as n_name from nation)")
def spans_between_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", spans_between(F.col("n_name"), "A+").alias("parts"))


@query("""
select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events
""")
def section_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id")).withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return carried_forward(e, ["user_id"], "at", "last_purchase").select("event_id", "last_purchase")


@query("""
select doc_id, el_idx, sent_idx, coalesce(list(text) over (w rows between 1 preceding and 1 preceding), []) as preceding, coalesce(list(text) over (w rows between 1 following and 2 following), []) as following from sentences window w as (partition by doc_id order by el_idx, sent_idx)
""")
def neighbour_sentences(spark: SparkSession, d: str) -> DataFrame:
    out = with_neighbours(table(spark, d, "sentences"), ["doc_id"], ["el_idx", "sent_idx"], after=2)
    return out.select("doc_id", "el_idx", "sent_idx", "preceding", "following")


@query("""
with e as (select event_id, user_id, ts, case when event_id % 7 = 0 then 'Heading' else 'Paragraph' end as t from events)
select event_id, last_value(case when t = 'Heading' then 'H' || event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as heading from e
""")
def heading_for_element(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, "Heading").otherwise("Paragraph").alias("el_type"), F.concat(F.lit("H"), F.col("event_id")).alias("text"))
    return with_heading(e, "user_id", "event_id").select("event_id", "heading")


@query("""
with e as (select user_id, event_id, case when event_id % 5 = 0 then value end as v, value from events),
b as (select e.*, last_value(case when v is not null then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as p,
last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as pv,
first_value(case when v is not null then event_id end ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) as f,
first_value(v ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) as fv from e)
select event_id, case when p is not null and (f is null or event_id - p <= f - event_id) then case when event_id - p < 400 then pv end when f - event_id < 400 then fv end as v from b
""")
def nearest_contextual_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("v"))
    return nearest_fill(e, ["user_id"], "event_id", "v", 400).select("event_id", "v")


# --- patterns and tags -------------------------------------------------------------------------------------------------


@query(r"""
with w as (select unnest(string_split(p_name || ' ' || p_type, ' ')) as w from part)
select w, (lower(w) = 'steel' or regexp_matches(w, '^[A-Z].*L$')) and not regexp_matches(w, 'NI') as hit, count(*) as n from w where w <> '' group by all
""")
def token_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = Every((IWord("steel") | Regex("^[A-Z].*L$"), Not(Regex("NI"))))
    words = table(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w")).where("w <> ''")
    return words.select("w", p.column(F.col("w")).alias("hit")).groupBy("w", "hit").agg(F.count("*").alias("n"))


@query(r"""
with w as (select unnest(string_split(p_name || ' ' || p_type || ' ' || p_size, ' ')) as w from part)
select case when regexp_matches(w, '^-?\d+(?:[.,]\d+)*$') then 'CD' when w in ('The','the','A','a','An','an') then 'DT' when regexp_matches(w, '.*able$') then 'JJ' when regexp_matches(w, '.*ness$') then 'NN' when regexp_matches(w, '.*ly$') then 'RB' when regexp_matches(w, '.*s$') then 'NNS' when regexp_matches(w, '.*ing$') then 'VBG' when regexp_matches(w, '.*ed$') then 'VBD' when regexp_matches(w, '^[^A-Za-z0-9_\s]+$') then '.' else 'NN' end as tag, count(*) as n from w where w <> '' group by 1
""")
def regex_tags(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_size"), " ")).alias("w")).where("w <> ''")
    return words.groupBy(regex_tag(F.col("w"), WORD_FORMS).alias("tag")).agg(F.count("*").alias("n"))


@query("""
with t as (select p_partkey, string_split(p_name || ' ' || lower(p_brand) || ' of ' || p_type, ' ') as ws from part),
w as (select p_partkey, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from t),
dict as (select distinct lower(p_brand) || ' of' as phrase from part where p_size % 2 = 0)
select a.p_partkey, a.i as start_idx, lower(a.w || ' ' || b.w) as phrase from w a join w b on a.p_partkey = b.p_partkey and b.i = a.i + 1 join dict on dict.phrase = lower(a.w || ' ' || b.w)
""")
def dictionary_phrases(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    phrases = part.where("p_size % 2 = 0").select(F.concat(F.lower("p_brand"), F.lit(" of")).alias("phrase"))
    text = F.concat("p_name", F.lit(" "), F.lower("p_brand"), F.lit(" of "), "p_type")
    toks = part.select("p_partkey", F.posexplode(F.split(text, " ")).alias("tok_idx", "text"))
    return dictionary_matches(toks, phrases, ["p_partkey"], 3).select("p_partkey", F.col("start_idx").cast("bigint").alias("start_idx"), "phrase")


@query("""
with c as (select 'w' || l_partkey % 11 as word, case when l_partkey % 11 < 4 then 'X' else l_returnflag end as tag, count(*) as n from lineitem group by all),
g as (select word, sum(n) as t, max(n) as m, arg_max(tag, n) as tag from c group by word)
select word, tag from g where t >= 20 and m >= 0.97 * t
""")
def single_tag_words(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 11
    li = table(spark, d, "lineitem").select(F.concat(F.lit("w"), k).alias("word"), F.when(k < 4, "X").otherwise(F.col("l_returnflag")).alias("tag"))
    return tag_dictionary(li, "word", "tag")


@query("select s_suppkey, 'differential scanning calorimetry' as long, 'DSC' as text from supplier")
def abbreviation_definitions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Samples of "), "s_name", F.lit(" were run by differential scanning calorimetry (DSC) again.")).alias("text"))
    return mentions(s, ["s_suppkey"]).where("kind = 'ABBR'").select("s_suppkey", "long", "text")


@query("""
select s_suppkey, case s_suppkey % 5 when 0 then 'differential scanning calorimetry' when 1 then 'nuclear magnetic resonance' when 2 then 'potassium bromide' end as long,
case s_suppkey % 5 when 0 then 'DSC' when 1 then 'NMR' when 2 then 'PTB' end as text from supplier where s_suppkey % 5 < 3
""")
def varied_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """Definitions in three forms, a bracket whose letters don't fit and a sentence without any."""
    k, n = F.col("s_suppkey"), F.col("s_name")
    s = (
        F.when(k % 5 == 0, F.concat(F.lit("Samples of "), n, F.lit(" were run by differential scanning calorimetry (DSC) again.")))
        .when(k % 5 == 1, F.concat(F.lit("The NMR (nuclear magnetic resonance) of "), n, F.lit(" was taken.")))
        .when(k % 5 == 2, F.concat(F.lit("In all pellets PTB = potassium bromide , as sold by "), n, F.lit(" .")))
        .when(k % 5 == 3, F.concat(F.lit("Dried over magnesium sulfate (XYZ) from "), n, F.lit(".")))
        .when(k % 5 == 4, F.concat(n, F.lit(" (see below) was used.")))
    )
    return mentions(table(spark, d, "supplier").select("s_suppkey", s.alias("text")), ["s_suppkey"]).where("kind = 'ABBR'").select("s_suppkey", "long", "text")


@query("""
select p_partkey, case p_partkey % 6 when 0 then 1 when 1 then 1 when 2 then 1 else 0 end as inchis, case p_partkey % 6 when 3 then 1 when 4 then 1 else 0 end as smiles, case when p_partkey % 2 = 0 then 1 else 0 end as keys from part
""")
def varied_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """InChI with and without prefix and layers, strings that only begin like one, SMILES with rings and charges, and keys of
    right and wrong length."""
    k = F.col("p_partkey")
    forms = ["InChI=1S/CH4/h1H4", "1/C8H8O3/c1-6(9)11-8/h2-5H,1H3/t7-/m0/s1", "InChI=1S/p+1", "[O-][N+](=O)c1ccc(Br)cc1", "C1CC(=O)N[C@@H]1C", "InChI=1S/C2H6O/z9 CC(C 123"]
    key = F.when(k % 2 == 0, "LFQSCWFLJHTTHZ-UHFFFAOYSA-N").otherwise("LFQSCWFLJHTTH-UHFFFAOYSA-N")
    t = F.concat_ws(" ", F.lit("see"), F.element_at(F.array(*map(F.lit, forms)), (k % 6 + 1).cast("int")), key)
    found = F.filter(S.smiles(t), lambda x: x.rlike("[=(\\[]"))
    return table(spark, d, "part").select("p_partkey", F.size(S.inchis(t)).alias("inchis"), F.size(found).alias("smiles"), F.size(S.inchikeys(t)).alias("keys"))


@query("""
with x as (select p_partkey, substr(p_name, 1, 5) as a, p_type as b from part)
select p_partkey, cast(min(levenshtein(a, substr(b, cast(i as integer), cast(j as integer)))) as integer) as least from x, range(1, 40) as t(i), range(0, 11) as u(j) group by p_partkey
""")
def levenshtein_window(spark: SparkSession, d: str) -> DataFrame:
    """Least edit distance between the begin of a name and any part of another text."""
    return table(spark, d, "part").select("p_partkey", S.levenshtein_within(F.substring("p_name", 1, 5), F.col("p_type")).alias("least"))


@query("""
select s_suppkey, 'Sup' || s_suppkey as last, case s_suppkey % 4 when 3 then 'L' else 'Ludwig' end as first, s_suppkey % 4 < 3 or s_suppkey % 2 = 1 as fits from supplier
""")
def varied_persons(spark: SparkSession, d: str) -> DataFrame:
    """Names in four orders, with titles, particles and initials, against one person of that name."""
    from spagyric.sources import biblio as B

    k, last = F.col("s_suppkey"), F.concat(F.lit("Sup"), F.col("s_suppkey").cast("string"))
    forms = F.array(F.concat(last, F.lit(", Ludwig M.")), F.concat(F.lit("Ludwig "), last), F.concat(F.lit("Dr. Ludwig Max "), last), F.concat(F.lit("L. "), last))
    name = F.element_at(forms, (k % 4 + 1).cast("int"))
    p = B.person_struct(name)
    return table(spark, d, "supplier").select("s_suppkey", p["lastname"].alias("last"), F.regexp_replace(p["firstname"], r"\.$", "").alias("first"), B.could_be_same(name, F.concat(F.lit("Ludwig "), last)).alias("fits"))


# --- quantities --------------------------------------------------------------------------------------------------------


@query("""
select p_partkey, [cast(p_size as double), p_size + 5.5] as dashed, [cast(-p_size - 1 as double), cast(p_size as double)] as worded, [cast(p_size as double) / 4] as fraction, [cast(p_size * 1000 + 600 as double) + 0.8] as grouped, [p_size + 0.8] as decimal_comma, cast([] as double[]) as none from part
""")
def value_range_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    s = lambda *x: F.concat(*(c.cast("string") if not isinstance(c, str) else F.lit(c) for c in x))
    render = {"dashed": s(n, "–", n + 5, ".5"), "worded": s("−", n + 1, " to ", n), "fraction": s(n, "/4"), "grouped": s(n, ",600.8"), "decimal_comma": s(n, ",8"), "none": s(n, "/0")}
    return table(spark, d, "part").select("p_partkey", *(Q.values(c).alias(k) for k, c in render.items()))


@query("select p_partkey, cast(p_size as double) as plus, cast(0.2 as double) as bracket, cast(2 as double) as whole, round(cast(0.0002 as double), 9) as small, cast(null as double) as none from part")
def error_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    render = {"plus": F.concat(n, F.lit("0.4±"), n), "bracket": F.concat(n, F.lit(".4(2)")), "whole": F.concat(n, F.lit("600(2)")), "small": F.lit("0.0002(2)"), "none": n}
    return table(spark, d, "part").select("p_partkey", *(F.round(Q.error(c), 9).alias(k) for k, c in render.items()))


@query("select p_partkey, cast(p_size as double) * 1000 as up, cast(p_size as double) / 100 as down from part")
def scientific_notation_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    first = lambda c: F.round(F.get(Q.values(c), F.lit(0)), 6)
    return table(spark, d, "part").select("p_partkey", first(F.concat(n, F.lit(" × 10^3"))).alias("up"), first(F.concat(n, F.lit("×10−2"))).alias("down"))


@query("""
select p_partkey, round(p_size + 273.15, 6) as c_to_k, round((p_size + 459.67) * 5 / 9, 6) as f_to_k, round(p_size * 1.8 + 32, 6) as c_to_f, round(p_size / 1000.0, 6) as mm_to_m, round(p_size * 1000 / 3600.0, 6) as kmh_to_ms, round(p_size * 5 / 9.0, 6) as error_f from part
""")
def temperature_convert(spark: SparkSession, d: str) -> DataFrame:
    v, u = F.col("p_size"), U.parse_unit
    pairs = {"c_to_k": ("°C", "K"), "f_to_k": ("°F", "K"), "c_to_f": ("Celsius", "Fahrenheit"), "mm_to_m": ("mm", "m"), "kmh_to_ms": ("km/h", "m/s")}
    speed = U.LENGTH / U.TIME
    dims = {"mm_to_m": U.LENGTH, "kmh_to_ms": speed}
    out = {k: U.convert(v, u(a, dims.get(k, U.TEMPERATURE)), u(b, dims.get(k, U.TEMPERATURE))) for k, (a, b) in pairs.items()}
    out["error_f"] = U.convert_error(v, u("°F", U.TEMPERATURE), u("K", U.TEMPERATURE))
    return table(spark, d, "part").select("p_partkey", *(F.round(c, 6).alias(k) for k, c in out.items()))


@query("""
select p_partkey, case p_partkey % 4 when 0 then 'Kelvin^(1.0)' when 1 then 'Celsius^(1.0)' when 2 then '(10^-3.0) * Kelvin^(1.0)' else null end as unit, case p_partkey % 4 when 0 then cast(p_size as double) when 1 then round(p_size + 273.15, 6) when 2 then round(p_size / 1000.0, 6) end as kelvin from part
""")
def distinct_unit_parsing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    part = table(spark, d, "part").withColumn("u", F.when(k == 0, "K").when(k == 1, "°C").when(k == 2, "mK").otherwise("furlong"))
    known = F.broadcast(U.parsed_units(part, "u", U.TEMPERATURE))  # as many as there are spellings that are units
    return part.join(known, "u", "left").select("p_partkey", "unit", F.round(F.col("p_size") * F.col("scale") + F.col("offset"), 6).alias("kelvin"))


@query("select p_partkey, (p_size <= 25 and 20 <= p_size + 5) as same, [p_size * 2.0::double, (p_size + 5) * 2.0::double] as scaled, [cast(p_size * p_size as double), cast((p_size + 5) * (p_size + 5) as double)] as squared from part")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = F.array(F.col("p_size").cast("double"), F.col("p_size") + F.lit(5.0))
    return table(spark, d, "part").select("p_partkey", U.overlaps(F.col("p_size"), F.col("p_size") + 5, F.lit(20), F.lit(25)).alias("same"), U.multiply(a, F.array(F.lit(2.0))).alias("scaled"), U.multiply(a, a).alias("squared"))
