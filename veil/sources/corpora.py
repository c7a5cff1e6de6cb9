"""Labelled corpora and floors as JSON, one object a file.

A corpus object has a source, a version, a fingerprint of version and text, the text and the
entities (id, type, text, start, end).  A floors object has suites with least rates, in total
and by type.  Both are read by Spark's JSON reader with a fixed schema; an object without
entities, or without suites, raises.

sample() and pages() make two corpora of invented people, written piece by piece so that
offsets cannot be wrong: a short one of nine types, and six pages like those of an offer
document.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.lexicon import PRIORITY_REGEX

CORPUS = "source_document string, extraction_version string, extraction_fingerprint string, extracted_text string, entities array<struct<id:string,pii_type:string,text:string,start:int,end:int,note:string>>"
RATES = "struct<min_precision:double,min_recall:double>"
FLOORS = f"description string, seed int, policy string, suites array<struct<id:string,corpus:string,use_ner:boolean,min_micro_precision:double,min_micro_recall:double,min_micro_f1:double,per_type:map<string,{RATES}>>>"

Piece = str | tuple[str, str]


def corpus(name: str, pieces: list[Piece], version: str = "1") -> dict:
    """A corpus object from plain strings and (type, text) pairs."""
    text, entities = "", []
    for p in pieces:
        if isinstance(p, tuple):
            kind, said = p
            entities.append({"id": f"{name}-{len(entities) + 1:03d}", "pii_type": kind, "text": said, "start": len(text), "end": len(text) + len(said), "note": "invented"})
            text += said
        else:
            text += p
    mark = "sha256:" + hashlib.sha256(f"{version}\n{text}".encode()).hexdigest()
    return {"source_document": f"synthetic://{name}", "extraction_version": version, "extraction_fingerprint": mark, "extracted_text": text, "entities": entities}


def sample() -> dict:
    """Twelve labels of nine types; the name is one that rules alone do not find."""
    return corpus("sample", [
        "Visitor log, invented for measurements.\n\nAsk for Ms. ", ("FULL_NAME", "Tara Velloor"), ", mail ", ("EMAIL", "tvelloor@postbox.example.com"), ", or ring ", ("PHONE", "+91 90123 45678"),
        ".\nBackup mail: ", ("EMAIL", "desk.two+night@mail.hostel.co.in"), ".\n\nSSN noted: ", ("SSN", "219-09-9998"), ".\nPaid by card ", ("CREDIT_CARD", "5555 5555 5555 4444"),
        ".\nTerminals: ", ("IP_ADDRESS", "172.16.4.20"), " and ", ("IP_ADDRESS", "2001:db8::42"), ".\n\nDate of birth ", ("DOB", "7 July 1979"), ", as told.\nLives at ", ("ADDRESS", "48 Temple Street, Kochi 682011"),
        ".\n\nSent by ", ("COMPANY", "Meridian Looms Pvt Ltd"), ".\nNight desk: ", ("PHONE", "(555) 765-4321"), ".\nInvoice No. 123-45-6789, ticket 9876543210, version 10.1.2.3.\n",
    ])


_PEOPLE = ["Asha Menon", "Vikram Sethi", "Leela Krishnan", "Omar Farooqui", "Nisha Bhatt", "Rohan Desai", "Meera Joshi", "Kabir Anand", "Divya Pillai", "Arjun Kapoor", "Sunita Rao", "Farhan Qureshi", "Ira Sen", "Manoj Tiwari", "Kiran Shetty", "Anil Gokhale"]
_FIRMS = ["Sunrise Ceramics Private Limited", "Harbour Gate Advisors LLP", "Silver Birch Textiles Limited", "Kestrel Registry Services Private Limited", "Blue Lagoon Foods Limited"]


def pages() -> dict:
    """Forty-nine labels over six pages: 16 names, 10 firms, 9 addresses of mail, 7 telephones, 6 places, 1 site.

    Six names stand without a label beside them, so only a model can find them.
    """
    pieces: list[Piece] = []
    for n in range(6):
        a, b, c = _PEOPLE[n], _PEOPLE[6 + n], _PEOPLE[12 + n] if n < 4 else None
        firm, other = _FIRMS[n % 5], _FIRMS[(n + 2) % 5]
        slug = firm.split()[0].lower()
        pieces += [f"PAGE {n + 1}\n\nThe objects of the offer are set out below and bidders should read the section on risks.\nIssued by ", ("COMPANY", firm), "\n"]
        if n < 4:
            pieces += ["Lead adviser ", ("COMPANY", other), "\n"]
        pieces += ["Registered office at ", ("ADDRESS", f"{n + 11} Marine Road, Mumbai 40002{n}"), "\n"]
        pieces += ["Contact Person: ", ("FULL_NAME", a), "\nEmail: ", ("EMAIL", f"investors@{slug}.example.com"), "\nTelephone: ", ("PHONE", f"+91 22 4000 10{n}{n}"), "\n"]
        if n < 3:
            pieces += ["Write also to ", ("EMAIL", f"{a.split()[0].lower()}.{n}@{slug}.example.com"), "\n"]
        if n == 5:
            pieces += ["Fax or telephone ", ("PHONE", "+91 22 4999 8877"), "\nWebsite: ", ("DOMAIN", "www.bluelagoon.example.org"), "\n"]
        if c:
            pieces += ["Compliance Officer: ", ("FULL_NAME", c), "\n"]
        pieces += ["The board is chaired by our director, ", ("FULL_NAME", b), ", who joined in the year 2011.\nThe allotment will be made in consultation with the designated exchange.\n\n"]
    return corpus("pages", pieces)


def floors() -> dict:
    """Least rates of rules alone over sample(), and of rules and the model of spelling over pages()."""
    sure = {"min_precision": 0.98, "min_recall": 0.98}
    return {"description": "least rates", "seed": 0, "policy": "relaxed", "suites": [
        {"id": "sample_rules", "corpus": "sample", "use_ner": False, "min_micro_precision": 0.98, "min_micro_recall": 0.9, "min_micro_f1": 0.94,
         "per_type": {t: sure for t in ("EMAIL", "PHONE", "ADDRESS", "SSN", "CREDIT_CARD", "DOB", "IP_ADDRESS")}},
        {"id": "pages_model", "corpus": "pages", "use_ner": True, "min_micro_precision": 0.95, "min_micro_recall": 0.93, "min_micro_f1": 0.95,
         "per_type": {"EMAIL": sure, "PHONE": sure, "DOMAIN": sure, "ADDRESS": {"min_precision": 0.98, "min_recall": 0.95}, "FULL_NAME": {"min_precision": 0.9, "min_recall": 0.85}, "COMPANY": {"min_precision": 0.9, "min_recall": 0.9}}},
    ]}


def write(folder: str) -> None:
    """Both corpora and the floors as files of a local folder."""
    os.makedirs(folder, exist_ok=True)
    for name, data in (("sample", sample()), ("pages", pages()), ("floors", floors())):
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as f:
            json.dump(data, f, indent=1, ensure_ascii=False)


def parsed(objects: DataFrame, column: str, schema: str, needed: str) -> DataFrame:
    """A JSON column as columns of a schema; an object without the needed key raises."""
    d = objects.withColumn("_x", F.from_json(column, schema))
    return d.withColumn("_x", F.when(F.col(f"_x.{needed}").isNotNull(), F.col("_x")).otherwise(F.raise_error(F.lit(f"an object has no {needed}")).cast(d.schema["_x"].dataType)))


def read_corpora(spark: SparkSession, path: str) -> DataFrame:
    """(source_document, extraction_version, extraction_fingerprint, text, entities) of corpus files."""
    d = parsed(spark.read.text(path, wholetext=True), "value", CORPUS, "entities").select("_x.*")
    return d.withColumnRenamed("extracted_text", "text")


def truth(corpora: DataFrame, key: str = "source_document") -> DataFrame:
    """(key, start, end, pii_type, text, source, confidence, priority): labels as entities."""
    d = corpora.select(key, F.explode("entities").alias("e"))
    return d.select(key, "e.start", "e.end", "e.pii_type", "e.text", F.concat(F.lit("truth:"), F.col("e.id")).alias("source"), F.lit(1.0).alias("confidence"), F.lit(PRIORITY_REGEX).alias("priority"))


def read_floors(spark: SparkSession, path: str) -> DataFrame:
    """(suite, pii_type or null, metric, minimum) of a floors file."""
    return floor_rows(parsed(spark.read.text(path, wholetext=True), "value", FLOORS, "suites").select(F.explode("_x.suites").alias("s")).select("s.*"))


def floor_rows(suites: DataFrame) -> DataFrame:
    """Suites as one row a floor."""
    one = lambda kind, metric, least: F.struct(kind.alias("pii_type"), F.lit(metric).alias("metric"), least.alias("minimum"))
    null = F.lit(None).cast("string")
    micro = F.array(*[one(null, m, F.col(f"min_micro_{m}")) for m in ("precision", "recall", "f1")])
    types = F.flatten(F.transform(F.map_entries("per_type"), lambda e: F.array(one(e["key"], "precision", e["value"]["min_precision"]), one(e["key"], "recall", e["value"]["min_recall"]))))
    d = suites.select(F.col("id").alias("suite"), F.explode(F.concat(micro, F.coalesce(types, F.array().cast("array<struct<pii_type:string,metric:string,minimum:double>>")))).alias("f"))
    return d.select("suite", "f.*").where("minimum is not null")
