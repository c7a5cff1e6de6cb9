"""From a model's raw spans to accepted entities, all relational.

The model is a seam: anything that yields (doc_id, start, end, label) rows over texts whose
exotic spaces were normalised.  Evidence is gathered per document from the document itself
(its lower-case vocabulary, its named people and companies) and joined in; every test is a
column, so rejected spans can be counted by reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions import context
from veil.functions.lexicon import DETERMINERS, EXOTIC_SPACES, FIELD_LABELS, LABEL_MAP, ORG_STOPWORDS, PRIORITY_NER
from veil.functions.text import cut_out, spans, squeeze, strings

from .rules import Config
from .spans import blocks_of

SOURCE = "ner:model"
COMMON_AT_LEAST = 2

# Patterns of evidence.
PERSON_LINE = r"(?iU)\b(?:director|signator(?:y|ies)?|signed\s+by|managing\s+director|independent\s+director|non-executive\s+director|chairman|company\s+secretary|compliance\s+officer|authorised\s+signatory|authorized\s+signatory)\b"
CONTACT_LINE = r"(?iU)\b(?:e-?mail|telephone|tel\.?|phone|fax|website|address|contact\s+person|registered\s+office|corporate\s+office)\b"
LEGAL_FORM = r"(?iU)\b(?:pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|limited|llp|inc\.?)\b"
NAMED_COMPANY = r"(?U)((?:[A-Z][\w&.\-]*(?:[ \t]+|$)){1,6}?)(?:Pvt\.?[ \t]*Ltd\.?|Private[ \t]+Limited|Limited|Ltd\.?|LLP|Inc\.?)\b"
TITLE_NAME = r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b"
TITLE_TOKEN = r"(?<![A-Za-z'’\-])(?:[A-Z][a-z'’\-]*[a-z][a-z'’\-]*|[A-Z])(?![A-Za-z'’\-])"
LETTER_TOKEN = r"[A-Za-z][A-Za-z'’\-]*"
LOWER_TOKEN = r"(?<![A-Za-z'’\-])[a-z][a-z'’\-]+"
NOT_PROSE = r"(?U)[\w.+-]+@[\w.-]+\.\w+|https?://\S+|www\.\S+"
STOP_PHRASE = r"(?U)(?<!\w)(?:" + "|".join(sorted((w.replace("-", r"\-") for w in ORG_STOPWORDS), key=lambda w: (-len(w), w))) + r")s?(?!\w)"


def normalise_spaces(text: Column) -> Column:
    """Exotic spaces as plain ones; no offset changes."""
    return F.translate(text, EXOTIC_SPACES, " " * len(EXOTIC_SPACES))


def chunks(text: Column, most: int = 80_000) -> Column:
    """Array of (start, text): whole lines packed up to a number of characters; a longer line is one chunk."""
    lines = F.split(text, r"(?<=\n)")
    size = lambda x: F.length(x) - F.endswith(x, F.lit("\n")).cast("int")  # noqa: E731  a line end in the last place does not count
    one = lambda start, t: F.struct(start.cast("int").alias("start"), t.alias("text"))

    def pack(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one(last["start"], F.concat(last["text"], x))))
        return F.when(F.size(acc) == 0, F.array(one(F.lit(0), x))).when(F.length(last["text"]) + size(x) <= most, longer).otherwise(F.array_append(acc, one(last["start"] + F.length(last["text"]), x)))

    return F.filter(F.aggregate(lines, F.array().cast("array<struct<start:int,text:string>>"), pack), lambda c: F.length(c["text"]) > 0)


def pieces_of(text: Column, start: Column, end: Column, separator: str) -> Column:
    """Array of (start, end, text): the trimmed, non-blank pieces of text[start:end] between separators."""
    part = cut_out(text, start, end)
    pieces = F.arrays_zip(F.split(part, separator, -1).alias("piece"), F.regexp_extract_all(part, F.lit(separator), F.lit(0)).alias("sep"))
    walked = F.aggregate(
        pieces,
        F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"]) + F.coalesce(F.length(p["sep"]), F.lit(0))).alias("at"),
            F.concat(acc["out"], F.array(trimmed(p["piece"], acc["at"]))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.filter(walked, lambda p: F.length(p["text"]) > 0)


def trimmed(piece: Column, at: Column) -> Column:
    lead = F.length(F.regexp_extract(piece, r"(?U)^(\s*)", 1))
    bare = F.regexp_replace(piece, r"(?U)^\s+|\s+$", "")
    return F.struct((at + lead).alias("start"), (at + lead + F.length(bare)).alias("end"), bare.alias("text"))


def clip_lines(text: Column, start: Column, end: Column) -> Column:
    return pieces_of(text, start, end, "\n")


def split_people(text: Column, start: Column, end: Column) -> Column:
    return pieces_of(text, start, end, r"(?U)\s*[/;]\s*|\s+&\s+")


def is_field_label(value: Column) -> Column:
    return F.array_contains(strings(FIELD_LABELS), F.trim(F.regexp_replace(squeeze(value), ":+$", "")))


def is_stopword(value: Column) -> Column:
    """A defined term: the whole value or a phrase in it, with or without a plural s."""
    return squeeze(value).rlike(STOP_PHRASE)


def is_heading(line: Column) -> Column:
    """All capitals, or a short line without sentence end that holds a defined term."""
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    caps = bare.rlike(r"\p{L}") & ~bare.rlike(r"[\p{L}&&[^\p{Lu}]]")
    short = (F.size(F.split(bare, r"(?U)\s+")) <= 6) & (F.length(bare) <= 60) & ~bare.rlike(r"[.?!]$")
    return bare.rlike(r"\p{L}") & (caps | (short & is_stopword(bare)))


def title_tokens(value: Column) -> Column:
    return F.size(F.regexp_extract_all(value, F.lit(TITLE_TOKEN), F.lit(0)))


def letter_tokens(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(LETTER_TOKEN), F.lit(0))


def starts_with_determiner(value: Column) -> Column:
    return F.coalesce(F.array_contains(strings(DETERMINERS), F.lower(F.get(letter_tokens(value), F.lit(0)))), F.lit(False))


def lower_vocabulary(docs: DataFrame, at_least: int = COMMON_AT_LEAST, key: str = "doc_id") -> DataFrame:
    """(key, token): tokens that the document writes in lower case often enough, outside addresses."""
    prose = F.regexp_replace(normalise_spaces(F.col("text")), NOT_PROSE, " ")
    d = docs.select(key, F.explode_outer(F.regexp_extract_all(prose, F.lit(LOWER_TOKEN), F.lit(0))).alias("token")).where("token is not null")
    return d.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).select(key, "token")


def lines_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks_of() with heading, person line, and contact (own or a neighbouring line)."""
    d = blocks_of(docs.withColumn("text", normalise_spaces(F.col("text"))), key)
    near = Window.partitionBy(key).orderBy("block").rowsBetween(-1, 1)
    return d.select("*", is_heading(F.col("text")).alias("heading"), F.col("text").rlike(PERSON_LINE).alias("people"), F.max(F.col("text").rlike(CONTACT_LINE)).over(near).alias("contact"))


def gazetteer(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name): title-case sequences on lines about directors and signatories, lower-cased."""
    d = docs.select(key, F.explode(F.split(normalise_spaces(F.coalesce("text", F.lit(""))), "\n")).alias("line")).where(F.col("line").rlike(PERSON_LINE))
    d = d.select(key, F.explode_outer(F.regexp_extract_all("line", F.lit(TITLE_NAME), F.lit(1))).alias("name")).where("name is not null")
    d = d.where(~is_stopword(F.col("name")) & ~is_field_label(F.col("name")) & (title_tokens(F.col("name")) >= 2))
    return d.select(key, F.lower("name").alias("name")).distinct()


def company_tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token): letters of names that the document writes with a legal form."""
    found = F.regexp_extract_all(normalise_spaces(F.coalesce("text", F.lit(""))), F.lit(NAMED_COMPANY), F.lit(1))
    d = docs.select(key, F.explode_outer(found).alias("name")).where("name is not null")
    d = d.select(key, F.explode_outer(F.regexp_extract_all("name", F.lit(r"\p{L}{3,}"), F.lit(0))).alias("token")).where("token is not null")
    return d.select(key, F.lower("token").alias("token")).distinct()


def candidate_pieces(docs: DataFrame, raw: DataFrame, config: Config, key: str = "doc_id") -> DataFrame:
    """(key, pii_type, start, end, text) of mapped and enabled labels, clipped to lines, people apart."""
    kinds = F.create_map(*[F.lit(x) for pair in LABEL_MAP.items() for x in pair])
    d = raw.withColumn("pii_type", kinds[F.col("label")]).where(F.array_contains(strings(list(config.enabled_types)), F.col("pii_type")))
    d = d.join(docs.select(key, F.col("text").alias("_doc")), key)
    d = d.withColumn("p", F.explode(clip_lines(F.col("_doc"), F.col("start"), F.col("end"))))
    people = F.when(F.col("pii_type") == "FULL_NAME", split_people(F.col("_doc"), F.col("p.start"), F.col("p.end"))).otherwise(F.array("p"))
    return d.withColumn("p", F.explode(people)).select(key, "pii_type", "p.*", "_doc")


def judged(docs: DataFrame, raw: DataFrame, config: Config, key: str = "doc_id") -> DataFrame:
    """Pieces with the reason of their rejection, or null where they stand."""
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    d = candidate_pieces(docs, raw, config, key)
    lines = lines_of(docs, key).select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), "heading", "contact")
    d = d.join(lines, (F.col(key) == F.col("_k")) & (start >= F.col("_s")) & (start <= F.col("_e")), "left").drop("_k", "_s", "_e")
    names = gazetteer(docs, key).withColumn("known", F.lit(True)).withColumnRenamed("name", "_low")
    d = d.withColumn("_low", F.lower(text)).join(names, [key, "_low"], "left")
    firms = company_tokens(docs, key).withColumn("firm", F.lit(True)).withColumnRenamed("token", "_bare")
    d = d.withColumn("_bare", F.regexp_replace(F.lower(text), r"(?U)[^\w]", "")).join(firms, [key, "_bare"], "left")
    # anti join by counting: a piece whose tokens are all common has no token left
    place = [key, "pii_type", "start", "end"]
    tokens = d.select(*place, F.explode(F.array_distinct(F.transform(letter_tokens(text), F.lower))).alias("token"))
    rare = tokens.join(lower_vocabulary(docs, key=key), [key, "token"], "left_anti").select(*place).distinct().withColumn("rare", F.lit(True))
    d = d.join(rare, place, "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    kind = F.col("pii_type")
    lone = F.size(F.split(text, r"(?U)\s+")) <= 1
    lexical = kind.isin("FULL_NAME", "COMPANY", "ADDRESS")
    reason = (
        F.when((F.length(text) < 2) | text.rlike(r"(?U)^[\W_]+$"), "trivial")
        .when(is_field_label(text), "label")
        .when(F.coalesce("heading", F.lit(False)), "heading")
        .when((kind == "DOB") & ~context.has_birth_cue(F.col("_doc"), start), "no birth cue")
        .when(kind.isin("COMPANY", "FULL_NAME") & is_stopword(text), "defined term")
        .when((kind == "FULL_NAME") & (title_tokens(text) < 2) & ~context.has_person_cue(F.col("_doc"), start, end) & no(F.col("known")), "no person evidence")
        .when((kind == "COMPANY") & ~text.rlike(LEGAL_FORM) & no(F.col("contact")), "no company evidence")
        .when((kind == "COMPANY") & lone & no(F.col("firm")), "lone word")
        .when((kind == "ADDRESS") & ~text.rlike(r"(?U)\d"), "bare place")
    )
    if config.agreement:
        reason = reason.when((kind == "FULL_NAME") & (title_tokens(text) < 2), "no agreement").when((kind == "COMPANY") & ~text.rlike(LEGAL_FORM), "no agreement")
    reason = reason.when(lexical & starts_with_determiner(text), "determiner").when(lexical & text.rlike("[A-Za-z]") & no(F.col("rare")), "common words")
    return d.select(key, kind, start, end, text, reason.alias("rejected"))


def accepted(docs: DataFrame, raw: DataFrame, config: Config, key: str = "doc_id") -> DataFrame:
    """(key, entities): arrays of accepted entities per document, ready for the engine."""
    d = judged(docs, raw, config, key).where("rejected is null")
    one = F.struct("start", "end", F.lit(SOURCE).alias("source"), "pii_type", "text", F.lit(1.0).alias("confidence"), F.lit(PRIORITY_NER).alias("priority"))
    return d.groupBy(key).agg(F.array_sort(F.collect_set(one)).alias("entities"))


def title_case_model(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A stand-in for a model: title-case sequences as PERSON, those with a legal form as ORG."""
    found = spans(normalise_spaces(F.coalesce("text", F.lit(""))), TITLE_NAME)
    d = docs.select(key, F.explode_outer(found).alias("s")).where("s is not null")
    return d.select(key, "s.start", "s.end", F.when(F.col("s.text").rlike(LEGAL_FORM), "ORG").otherwise("PERSON").alias("label"))
