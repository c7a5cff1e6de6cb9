"""Queries of validators, context rules and the candidate chain, on texts written from keys."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import context, validators
from veil.operators import candidates, model
from veil.operators.rules import Config

from .registry import cases, cases_sql, documents, place_of, query, table

CONFIG = Config(as_of="2024-06-30")

# Dates in all layouts

_LAYOUTS = [("%d/%m/%Y", "dd/MM/yyyy"), ("%d-%m-%Y", "dd-MM-yyyy"), ("%Y-%m-%d", "yyyy-MM-dd"), ("%-d %B %Y", "d MMMM yyyy"), ("%B %-d, %Y", "MMMM d, yyyy"), ("%-d %b %Y", "d MMM yyyy"), ("%d/%m/%y", None)]
_DAY = "DATE '1970-01-01' + CAST(o_orderkey % 18000 AS INT)"


@query("WITH d AS (SELECT o_orderkey, " + _DAY + " AS day, CASE o_custkey % 7 " + " ".join(f"WHEN {n} THEN strftime({_DAY}, '{f}')" for n, (f, _) in enumerate(_LAYOUTS)) + """ END AS said, o_custkey % 7 AS layout FROM orders)
    SELECT o_orderkey, said, day AS parsed FROM d""")
def parse_layouts(spark, sf_dir):
    """Days of 1970 to 2019; two-digit years from 69 on are of the last century."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("o_orderkey") % 18000).cast("int"))
    short = F.concat(F.date_format(day, "dd/MM/"), F.substring(F.date_format(day, "yyyy"), 3, 2))
    said = F.lit(None).cast("string")
    for n, (_, f) in enumerate(_LAYOUTS):
        said = F.when(F.col("o_custkey") % 7 == n, F.date_format(day, f) if f else short).otherwise(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", "said", validators.parse_date(F.col("said")).alias("parsed"))


_SCALARS = [
    # ssn, card digits, ip: values and whether they hold
    ("219-09-9998", True, "4111111111111111", True, "10.0.0.1", True),
    ("000-09-9998", False, "4111111111111", True, "256.0.0.1", False),
    ("666-09-9998", False, "411111111111111", False, "1.2.3", False),
    ("900-09-9998", False, "2221000000000009", True, "::1", True),
    ("219-00-9998", False, "2720990000000000", True, "::", False),
    ("219-09-0000", False, "2721000000000000", False, "1::2::3", False),
    ("21909999", False, "378282246310005", True, "1:2:3:4:5:6:7:8", True),
    ("899 99 9999", True, "38520000023237", True, "1:2:3:4:5:6:7:8:9", False),
    ("", False, "3528000000000007", True, "01.2.3.4", False),
    ("abc", False, "6500000000000002", True, "fe80::g", False),
]


@query(f"SELECT doc_id, ssn_ok, scheme_ok, ip_ok FROM {cases_sql(_SCALARS, ('ssn', 'ssn_ok', 'card', 'scheme_ok', 'ip', 'ip_ok'))}")
def value_checks(spark, sf_dir):
    d = cases(spark, sf_dir, _SCALARS, ("ssn", "ssn_ok", "card", "scheme_ok", "ip", "ip_ok"))
    return d.select("doc_id", validators.ssn_valid(F.col("ssn")).alias("ssn_ok"), validators.card_scheme_match(F.col("card")).alias("scheme_ok"), validators.ip_valid(F.col("ip")).alias("ip_ok"))


@query("""
    WITH d AS (SELECT o_orderkey, DATE '1880-01-01' + CAST(o_orderkey % 60000 AS INT) AS born FROM orders)
    SELECT o_orderkey, year(born) >= 1900 AND date_sub('year', born, DATE '2024-06-30') BETWEEN 0 AND 120 AND born <= DATE '2024-06-30' AS plausible FROM d""")
def plausible_births(spark, sf_dir):
    born = F.date_add(F.lit("1880-01-01").cast("date"), (F.col("o_orderkey") % 60000).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", validators.plausible_birth(born, F.lit("2024-06-30").cast("date")).alias("plausible"))


# What stands to the left

_LABELS = [
    ("Invoice No. ", "invoice", True),
    ("ticket #", "ticket", True),
    ("Date of birth: ", "date of birth", False),
    ("born no ", "born", False),
    ("reorder ", None, False),
    ("order was ", None, False),
    ("GSTIN - ", "gstin", True),
    ("client id/", "client id", True),
    ("ref. nos. ", "nos", True),
    ("", None, False),
    ("the DP ID number: ", "number", True),
    ("the DP ID: ", "dp id", True),
]


@query(f"SELECT doc_id, label, reference FROM {cases_sql(_LABELS, ('lead', 'label', 'reference'))}")
def preceding_labels(spark, sf_dir):
    d = cases(spark, sf_dir, _LABELS, ("lead", "label", "reference")).select("doc_id", F.concat("lead", F.lit("4711")).alias("text"), F.length("lead").alias("at"))
    return d.select("doc_id", context.preceding_label(F.col("text"), F.col("at")).alias("label"), context.is_reference(F.col("text"), F.col("at")).alias("reference"))


_AROUND = [
    ("Signed by the managing director", "Asha Menon", "of the firm", True),
    ("It was told to", "Asha Menon", "by all", False),
    ("Thanks,", "Asha Menon", "Company Secretary", True),
    ("one\ntwo", "Asha Menon", "three\nfour", False),
    ("Shri", "Asha Menon", "", True),
]


@query(f"""
    SELECT doc_id, cue, replace(substr(lead || ' ' || value || ' ' || tail, greatest(length(lead) + 1 - 40, 0) + 1, length(lead) + 1 + length(value) + 40 - greatest(length(lead) + 1 - 40, 0)), chr(10), ' ') AS snippet
    FROM {cases_sql(_AROUND, ('lead', 'value', 'tail', 'cue'))}""")
def person_cues(spark, sf_dir):
    d = cases(spark, sf_dir, _AROUND, ("lead", "value", "tail", "cue")).select("doc_id", F.concat_ws(" ", "lead", "value", "tail").alias("text"), (F.length("lead") + 1).alias("a"), (F.length("lead") + 1 + F.length("value")).alias("b"))
    return d.select("doc_id", context.has_person_cue(F.col("text"), F.col("a"), F.col("b")).alias("cue"), context.snippet(F.col("text"), F.col("a"), F.col("b")).alias("snippet"))


# Candidates of a model: a text, a span in it, its label, and why it goes or null if it stays

_JUDGED = [
    ("Our chairman Asha Menon spoke", "Asha Menon", "PERSON", None),
    ("It was Asha Menon again", "Asha Menon", "PER", None),
    ("It was Asha again", "Asha", "PERSON", "no person evidence"),
    ("Mr. Asha spoke", "Asha", "PERSON", None),
    ("x, - then", "-", "PERSON", "trivial"),
    ("the Contact Person: none", "Contact Person:", "PERSON", "label"),
    ("RISK AND OTHER MATTERS\nmore of it.", "OTHER MATTERS", "ORG", "heading"),
    ("see the Red Herring Prospectus for it now and then, all of it is there.", "Red Herring Prospectus", "ORG", "defined term"),
    ("on 12 March 1980 they met", "12 March 1980", "DATE", "no birth cue"),
    ("born on 12 March 1980 here", "12 March 1980", "DATE", None),
    ("we met Orchid Mills there", "Orchid Mills", "ORG", "no company evidence"),
    ("we met Orchid Mills Ltd there", "Orchid Mills Ltd", "ORG", None),
    ("Email of the desk\nwe met Orchid there", "Orchid", "ORG", "lone word"),
    ("Email of the desk\nwe met Orchid, that is Orchid Mills Limited of old", "Orchid", "ORG", None),
    ("in Pune they met", "Pune", "GPE", "bare place"),
    ("in Pune 411001 they met", "Pune 411001", "GPE", None),
    ("by the Asha Menon fund", "the Asha Menon", "PERSON", "determiner"),
    ("so Green Hill it is: green hill, green hill and green hill", "Green Hill", "PERSON", "common words"),
    ("Asha Menon, director", "Asha Menon", "PERSON", None),
    ("a Monday in the MONEY market", "MONEY", "MONEY", "unmapped"),
]
_JUDGED_NAMES = ("text", "value", "label", "rejected")


def judged_docs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = cases(spark, sf_dir, _JUDGED, _JUDGED_NAMES)
    at = place_of("value")
    return d.select("doc_id", "text"), d.select("doc_id", at.alias("start"), (at + F.length("value")).cast("int").alias("end"), "label")


@query(f"""
    SELECT doc_id, CASE label WHEN 'PERSON' THEN 'FULL_NAME' WHEN 'PER' THEN 'FULL_NAME' WHEN 'ORG' THEN 'COMPANY' WHEN 'DATE' THEN 'DOB' ELSE 'ADDRESS' END AS pii_type,
      CAST(strpos(text, value) - 1 AS BIGINT) AS span_start, value, rejected
    FROM {cases_sql(_JUDGED, _JUDGED_NAMES)} WHERE label <> 'MONEY'""")
def judged_candidates(spark, sf_dir):
    docs, raw = judged_docs(spark, sf_dir)
    return candidates.judged(docs, raw, CONFIG).select("doc_id", "pii_type", F.col("start").cast("long").alias("span_start"), F.col("text").alias("value"), "rejected")


_AGREED = [("It was Asha Menon again", "Asha Menon", "PERSON", None), ("Mr. Asha spoke", "Asha", "PERSON", "no agreement"), ("Fax of the desk\nwe met Orchid Mills there", "Orchid Mills", "ORG", "no agreement"), ("we met Orchid Mills LLP there", "Orchid Mills LLP", "ORG", None)]


@query(f"SELECT doc_id, value, rejected FROM {cases_sql(_AGREED, _JUDGED_NAMES)}")
def agreement_mode(spark, sf_dir):
    d = cases(spark, sf_dir, _AGREED, _JUDGED_NAMES)
    at = place_of("value")
    raw = d.select("doc_id", at.alias("start"), (at + F.length("value")).cast("int").alias("end"), "label")
    return candidates.judged(d.select("doc_id", "text"), raw, replace(CONFIG, agreement=True)).select("doc_id", F.col("text").alias("value"), "rejected")


_PIECES = [
    ("Asha Menon\n  Tara Velloor ", "Asha Menon|Tara Velloor", "Asha Menon|Tara Velloor"),
    ("Asha Menon / Tara Velloor", "Asha Menon / Tara Velloor", "Asha Menon|Tara Velloor"),
    ("Asha Menon & Tara; Omar", "Asha Menon & Tara; Omar", "Asha Menon|Tara|Omar"),
    ("\n \nAsha", "Asha", "Asha"),
    ("A&B Mills", "A&B Mills", "A&B Mills"),
]


@query(f"SELECT doc_id, by_line, by_person FROM {cases_sql(_PIECES, ('text', 'by_line', 'by_person'))}")
def span_pieces(spark, sf_dir):
    d = cases(spark, sf_dir, _PIECES, ("text", "a", "b"))
    text, end = F.col("text"), F.length("text")
    said = lambda x: F.array_join(F.transform(x, lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"])), "|")  # noqa: E731  by offsets
    people = F.flatten(F.transform(candidates.clip_lines(text, F.lit(0), end), lambda p: candidates.split_people(text, p["start"], p["end"])))
    return d.select("doc_id", said(candidates.clip_lines(text, F.lit(0), end)).alias("by_line"), said(people).alias("by_person"))


_LEXICAL = [
    # text, field label, defined term, heading, determiner, title tokens
    ("E-Mail:", True, False, False, False, 0),
    ("Equity Shares", False, True, True, False, 2),
    ("the Offer", False, True, True, True, 1),
    ("GENERAL INFORMATION", False, False, True, False, 0),
    ("Asha Menon", False, False, False, False, 2),
    ("Each of them.", False, False, False, True, 1),
    ("The Offers of the bank and of others too.", False, True, False, True, 2),
    ("registered   office", True, False, False, False, 0),
]


@query(f"SELECT doc_id, field_label, defined, heading, determiner, titles FROM {cases_sql(_LEXICAL, ('text', 'field_label', 'defined', 'heading', 'determiner', 'titles'))}")
def lexical_tests(spark, sf_dir):
    d, t = cases(spark, sf_dir, _LEXICAL, ("text", "a", "b", "c", "e", "f")), F.col("text")
    return d.select("doc_id", candidates.is_field_label(t).alias("field_label"), candidates.is_stopword(t).alias("defined"), candidates.is_heading(t).alias("heading"), candidates.starts_with_determiner(t).alias("determiner"), candidates.title_tokens(t).cast("long").alias("titles"))


_EVIDENCE = [
    ("The director is Asha Menon, or Tara Velloor\nand Omar Farooqui", "asha menon|tara velloor", ""),
    ("Signed by Nisha Bhatt, for Orchid Mills Private Limited", "nisha bhatt|orchid mills private limited", "mills|orchid"),
    ("nothing here {n}", "", ""),
    ("Equity Shares of the director, and Kestrel Foods LLP", "kestrel foods", "foods|kestrel"),
]


@query(f"SELECT doc_id, people, firms FROM {cases_sql(_EVIDENCE, ('text', 'people', 'firms'))}")
def document_evidence(spark, sf_dir):
    d = cases(spark, sf_dir, _EVIDENCE, ("text", "a", "b")).select("doc_id", "text")
    of = lambda x, c, n: x.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(c)), "|").alias(n))
    d = d.select("doc_id").join(of(candidates.gazetteer(d), "name", "people"), "doc_id", "left").join(of(candidates.company_tokens(d), "token", "firms"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("people", F.lit("")).alias("people"), F.coalesce("firms", F.lit("")).alias("firms"))


@query(r"""
    WITH k AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> ''),
    s AS (SELECT doc_id, list_transform(ls, lambda x, i: CASE WHEN i < len(ls) THEN x || chr(10) ELSE x END) AS ls FROM k),
    f AS (SELECT doc_id, list_reduce(list_transform(ls, lambda x: [x]), lambda acc, x: CASE
        WHEN length(acc[-1]) + length(x[1]) - CASE WHEN x[1][-1:] = chr(10) THEN 1 ELSE 0 END <= 500 THEN list_concat(acc[1:len(acc) - 1], [acc[-1] || x[1]]) ELSE list_concat(acc, x) END) AS cs FROM s),
    u AS (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM f)
    SELECT doc_id, CAST(coalesce(list_sum(list_transform(cs[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS chunk_start, CAST(length(cs[i]) AS BIGINT) AS chars FROM u WHERE length(cs[i]) > 0""")
def text_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).where("text is not null")
    d = d.select("doc_id", F.explode(candidates.chunks(F.col("text"), 500)).alias("c"))
    return d.select("doc_id", F.col("c.start").cast("long").alias("chunk_start"), F.length("c.text").cast("long").alias("chars"))


@query(r"""
    WITH c AS (SELECT c_custkey AS doc_id, 'Then Asha Menon met Blue Harbour Ltd' AS text FROM customer), p AS (SELECT doc_id, text, unnest(['Then Asha Menon', 'Blue Harbour Ltd']) AS value FROM c)
    SELECT doc_id, CAST(strpos(text, value) - 1 AS BIGINT) AS span_start, CAST(strpos(text, value) - 1 + length(value) AS BIGINT) AS span_end, CASE WHEN value LIKE '%Ltd' THEN 'ORG' ELSE 'PERSON' END AS label FROM p""")
def model_spans(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Then Asha Menon met Blue Harbour Ltd").alias("text"))
    found = model.raw_spans(d, model.TITLE_CASE)
    return found.select("doc_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "label")


@query("SELECT c_custkey AS doc_id, 'a b c d e f g h' || CAST(c_custkey AS VARCHAR) AS plain FROM customer")
def plain_spaces(spark, sf_dir):
    text = F.concat(F.lit("a b c d e f g h"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), candidates.normalise_spaces(text).alias("plain"))


@query(r"""
    WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), u AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
    c AS (SELECT doc_id, i, regexp_matches(ls[i], '(?i)\b(?:e-?mail|telephone|tel\.?|phone|fax|website|address|contact\s+person|registered\s+office|corporate\s+office)\b') AS hit FROM u)
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS block, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS contact FROM c""")
def contact_lines(spark, sf_dir):
    return candidates.lines_of(documents(spark, sf_dir)).select("doc_id", F.col("block").cast("long").alias("block"), "contact")
