"""Queries of span algebra, leak checks, scoring and audits, on spans and texts written from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.lexicon import PII_TYPES
from veil.operators import audit, scoring, spans, verify
from veil.operators.rules import ENTITY, REGISTRY, Config, detect, explode_entities
from veil.store import cut

from .engine import Engine
from .registry import cases, cases_sql, documents, place_of, query, table

AS_OF = "2024-06-30"
CONFIG = Config(as_of=AS_OF)
ENTITIES = f"array<{ENTITY}>"


def entity(start, end, source, kind, text, confidence=1.0, priority=20):
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(source).alias("source"), F.lit(kind).alias("pii_type"), text.alias("text"), F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority")).cast(ENTITY)


# Whole texts of several kinds: the pieces and where they stand

_PARTS = [
    ("FULL_NAME", "Contact Person: ", "Ravi Kumar", "\n"), ("EMAIL", "write ", "u{n}@mail.org", " or "), ("PHONE", "", "+91 98{n}12", "; "), ("SSN", "id, ", "219-09-9998", ". "), ("CREDIT_CARD", "card ", "4111 1111 1111 1111", ", "),
    ("DOB", "born ", "12/03/1980", ". "), ("IP_ADDRESS", "host ", "10.20.30.40", " up\n"), ("ADDRESS", "at ", "48 Temple Street, Kochi 682011", "\n"), ("COMPANY", "with ", "Blue Harbour Private Limited", " and "), ("DOMAIN", "", "www.site{n}.com", " end"),
]
_WHOLE = "".join(a + v + b for _, a, v, b in _PARTS)


def whole_texts(spark, sf_dir) -> DataFrame:
    return cases(spark, sf_dir, [(_WHOLE,)], ("text",))


def _parts_sql() -> str:
    """(doc_id, pii_type, s, value): where each value stands, from the lengths before it."""
    rows, at = [], 0
    for kind, a, v, b in _PARTS:
        size = lambda x: len(x.replace("{n}", "000000"))
        rows.append(f"('{kind}', {at + size(a)}, '{v}')")
        at += size(a) + size(v) + size(b)
    return f"(SELECT c_custkey AS doc_id, pii_type, s, replace(v, '{{n}}', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS value FROM customer, (VALUES {', '.join(rows)}) x(pii_type, s, v))"


@query(f"SELECT doc_id, pii_type, CAST(s AS BIGINT) AS span_start, CAST(s + length(value) AS BIGINT) AS span_end, value FROM {_parts_sql()}")
def resolve_all(spark, sf_dir):
    d = explode_entities(Engine(CONFIG).detect(whole_texts(spark, sf_dir)), "doc_id")
    return d.select("doc_id", "pii_type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.col("text").alias("value"))


# All rules find the ten values; the telephone rule also finds the card's first digits, and its own form of the SSN and the address's number
@query(f"SELECT doc_id, pii_type, CAST(s AS BIGINT) AS span_start, value FROM {_parts_sql()} WHERE pii_type NOT IN ('PHONE')")
def detect_all(spark, sf_dir):
    d = explode_entities(detect(whole_texts(spark, sf_dir), CONFIG), "doc_id").where("pii_type <> 'PHONE'")
    return d.select("doc_id", "pii_type", F.col("start").cast("long").alias("span_start"), F.col("text").alias("value"))


@query(f"SELECT pii_type, count(*) AS n FROM {_parts_sql()} GROUP BY pii_type")
def counts_by_type(spark, sf_dir):
    return spans.counts_by_type(explode_entities(Engine(CONFIG).detect(whole_texts(spark, sf_dir)), "doc_id"))


@query("SELECT count(*) AS rules, CAST(10 AS BIGINT) AS types, 'credit_card,dob,ip_address,ssn,address,contact_person,domain,email,legal_entity,phone' AS names FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) v(x)")
def rule_registry(spark, sf_dir):
    rules = REGISTRY.enabled(CONFIG)
    return spark.range(1).select(F.lit(len(rules)).cast("long").alias("rules"), F.lit(len({r.pii_type for r in rules})).cast("long").alias("types"), F.lit(",".join(r.name for r in rules)).alias("names"))


@query(r"""
    WITH e AS (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n_mails FROM documents)
    SELECT doc_id, sha256(coalesce(text, '')) AS restored, CAST(coalesce(n_mails, 0) AS BIGINT) AS n_mails, true AS changed FROM e""")
def rewrite_documents(spark, sf_dir):
    """Whole documents rewritten, and put back by their spans: the text again, so nothing else changed."""
    d = cut(Engine(CONFIG).rewrite(documents(spark, sf_dir)).select("doc_id", "text", "rewritten", "assigned"))
    es = F.array_sort("assigned")
    # each replacement begins where the ones before it have moved it
    moved = lambda i: F.aggregate(F.slice(es, F.lit(1), i), F.lit(0), lambda a, e: a + F.length(e["replacement"]) - (e["end"] - e["start"]))
    back = F.transform(es, lambda e, i: F.struct((e["start"] + moved(i)).alias("start"), (e["start"] + moved(i) + F.length(e["replacement"])).alias("end"), e["text"].alias("replacement")))
    restored = spans.apply(F.coalesce("rewritten", F.lit("")), back)
    n = F.size(F.filter("assigned", lambda e: e["pii_type"] == "EMAIL"))
    changed = (F.size("assigned") == 0) | (F.col("text") != F.col("rewritten"))
    return d.select("doc_id", F.sha2(restored, 256).alias("restored"), n.cast("long").alias("n_mails"), F.coalesce(changed, F.lit(True)).alias("changed"))


# Algebra


_REPEATS = [
    # text, the detected value, other places of it
    ("a Ravi Kumar, b Ravi  Kumar, c RAVI KUMAR", "Ravi Kumar", 2),
    ("Orchid, Orchids, xOrchid", "Orchid", 3),
    ("Abc Abc", "Abc", 1),
    ("New Delhi\nNew\nDelhi", "New Delhi", 1),
]


@query(f"SELECT doc_id, n FROM {cases_sql(_REPEATS, ('text', 'value', 'n'))}")
def expand_values(spark, sf_dir):
    d = cases(spark, sf_dir, _REPEATS, ("text", "value", "m"))
    at = place_of("value")
    d = d.withColumn("entities", F.array(entity(at, at + F.length("value"), "t", "FULL_NAME", F.col("value"))))
    return d.select("doc_id", F.size(spans.expand(F.col("text"), F.col("entities"))).cast("long").alias("n"))


@query("""
    WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_partkey % 200 AS INT) AS s, CAST(l_partkey % 200 + l_quantity + 1 AS INT) AS e FROM lineitem)
    SELECT doc_id, s AS span_start, e AS span_end FROM s WHERE s // 40 = (e - 1) // 40 AND e <= (s // 40 + 1) * 40 - 1""")
def drop_cross_block(spark, sf_dir):
    """Blocks of 39 characters with a separator after each."""
    start = (F.col("l_partkey") % 200).cast("int")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + F.col("l_quantity").cast("int") + 1).alias("end")).distinct()
    blocks = s.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("b")).select("doc_id", (F.col("b") * 40).alias("start"), (F.col("b") * 40 + 39).alias("end"))
    return spans.drop_cross_block(s, blocks).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


_BROKEN = [("abcdef", 0, 3, "abc", None), ("abcdef", 0, 3, "abd", "slice"), ("abcdef", 2, 2, "", "shape"), ("abcdef", 0, 4, "abc", "shape"), ("abcdef", 4, 6, "ef", None)]


@query(f"SELECT doc_id, broken FROM {cases_sql(_BROKEN, ('text', 'a', 'b', 'value', 'broken'))} WHERE broken IS NOT NULL")
def span_violations(spark, sf_dir):
    d = cases(spark, sf_dir, _BROKEN, ("text", "a", "b", "value", "x"))
    s = d.select("doc_id", F.lit("EMAIL").alias("pii_type"), F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end"), F.col("value").alias("text"), F.lit(1.0).alias("confidence"))
    return spans.violations(s, d.select("doc_id", "text")).select("doc_id", "broken")


# Leaks

_LEAKS = [
    # text, rewritten, the value, its replacement, kind of leak
    ("mail jane@x.org now", "mail alba@x.net now", "jane@x.org", "alba@x.net", None),
    ("mail jane@x.org now", "mail alba@x.net now, jane@x.org", "jane@x.org", "alba@x.net", "rendered"),
    ("mail jane@x.org now", "mail jane@x.org now", "jane@x.org", "jane@x.org", "span"),
    ("mail jane@x.org, jane@x.org", "mail alba@x.net, jane@x.org", "jane@x.org", "alba@x.net", "expected"),
    ("call Tom now", "call Tim now, Tom", "Tom", "Tim", None),
    ("mail jane@x.org now", "mail mary.jane@x.org now", "jane@x.org", "mary.jane@x.org", None),
]


def leak_texts(spark, sf_dir) -> DataFrame:
    d = cases(spark, sf_dir, _LEAKS, ("text", "rewritten", "value", "replacement", "kind"))
    at = place_of("value")
    return d.withColumn("assigned", F.array(entity(at, at + F.length("value"), "t", "EMAIL", F.col("value")).withField("replacement", F.col("replacement"))))


@query(f"SELECT doc_id, 'EMAIL' AS pii_type, kind FROM {cases_sql(_LEAKS, ('text', 'rewritten', 'value', 'replacement', 'kind'))} WHERE kind IS NOT NULL")
def rewriting_leaks(spark, sf_dir):
    return verify.leaks(leak_texts(spark, sf_dir))


@query(f"SELECT pii_type, count(*) AS n FROM (SELECT 'EMAIL' AS pii_type FROM {cases_sql(_LEAKS, ('text', 'rewritten', 'value', 'replacement', 'kind'))} WHERE kind IS NOT NULL) GROUP BY pii_type")
def worst_leak(spark, sf_dir):
    found = verify.worst(verify.leaks(leak_texts(spark, sf_dir)))
    return spark.range(1).where(F.lit(found is not None)).select(F.lit(found[0] if found else "").alias("pii_type"), F.lit(found[1] if found else 0).cast("long").alias("n"))


@query(f"SELECT doc_id, 'EMAIL' AS pii_type FROM {cases_sql([(*r, i % 2 == 0) for i, r in enumerate(_LEAKS)], ('text', 'rewritten', 'value', 'replacement', 'kind', 'held'))} WHERE held AND length(value) >= 5 AND strpos(replacement, value) = 0")
def package_leaks(spark, sf_dir):
    """Every second document's package still has the value in a part that is not shown."""
    d = leak_texts(spark, sf_dir)
    extra = F.when(F.col("doc_id") % len(_LEAKS) % 2 == 0, F.concat(F.lit("<x>"), F.col("value"), F.lit("</x>"))).otherwise(F.lit("<x/>"))
    parts = d.select("doc_id", F.explode(F.array(F.lit("<y/>"), extra)).alias("text"))
    return verify.package_leaks(d, parts)


_RECALL = [("mail jane@x.org or 10.1.2.3", "mail jane@x.org or 10.9.9.9", "jane@x.org", "EMAIL"), ("mail jane@x.org", "mail alba@x.net", None, None), ("host 10.20.30.40 up", "host 10.20.30.40 up", "10.20.30.40", "IP_ADDRESS")]


@query(f"SELECT doc_id, value, pii_type FROM {cases_sql(_RECALL, ('text', 'rewritten', 'value', 'pii_type'))} WHERE value IS NOT NULL")
def rule_recall(spark, sf_dir):
    return verify.rule_recall(cases(spark, sf_dir, _RECALL, ("text", "rewritten", "a", "b")), CONFIG)


@query(f"SELECT doc_id, pii_type, value FROM {_parts_sql()} WHERE pii_type <> 'PHONE'")
def rule_values(spark, sf_dir):
    return verify.rule_values(whole_texts(spark, sf_dir), CONFIG).where("pii_type <> 'PHONE'")


# Scoring


def conflicts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each line of an order: a label, and two predictions that overlap it and the next label by more or less."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    at = (F.col("l_linenumber") * 30).cast("int")
    kind = F.when(F.col("s") % 7 == 0, "PHONE").otherwise("EMAIL")
    truth = d.select("doc_id", at.alias("start"), (at + 20).alias("end"), F.lit("EMAIL").alias("pii_type"))
    a = d.select("doc_id", (at - F.col("p") % 15).cast("int").alias("start"), (at + 20 - F.col("p") % 15).cast("int").alias("end"), kind.alias("pii_type"))
    b = d.select("doc_id", (at + 1 + F.col("p") % 11).cast("int").alias("start"), (at + 21 + F.col("p") % 11).cast("int").alias("end"), F.lit("EMAIL").alias("pii_type"))
    return truth, a.unionByName(b).distinct()


_CONFLICTS = """
    k AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
    t AS (SELECT doc_id, n * 30 AS s, n * 30 + 20 AS e, 'EMAIL' AS kind FROM k),
    p AS (SELECT doc_id, n * 30 - p % 15 AS s, n * 30 + 20 - p % 15 AS e, CASE WHEN s % 7 = 0 THEN 'PHONE' ELSE 'EMAIL' END AS kind FROM k UNION SELECT doc_id, n * 30 + 1 + p % 11, n * 30 + 21 + p % 11, 'EMAIL' FROM k),
    tn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, kind) AS i FROM t), pn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, kind) AS j FROM p),
    c AS (SELECT tn.doc_id, i, j, tn.kind <> pn.kind AS wrong, tn.kind AS tk, pn.kind AS pk, least(tn.e, pn.e) - greatest(tn.s, pn.s) AS o FROM tn JOIN pn ON tn.doc_id = pn.doc_id AND least(tn.e, pn.e) > greatest(tn.s, pn.s)),
    l AS (SELECT doc_id, list({'i': i, 'j': j, 'wrong': wrong} ORDER BY o DESC, wrong, i, j) AS xs FROM c GROUP BY doc_id),
    f AS (SELECT doc_id, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.i = x[1].i OR y.j = x[1].j)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM l),
    m AS (SELECT doc_id, unnest(kept) AS x FROM f),
    r AS (SELECT m.doc_id, CASE WHEN x.wrong THEN 'type_confusion' ELSE 'tp' END AS outcome, 'EMAIL' AS kind FROM m
      UNION ALL SELECT tn.doc_id, 'fn', kind FROM tn WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = tn.doc_id AND m.x.i = tn.i)
      UNION ALL SELECT pn.doc_id, 'fp', kind FROM pn WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = pn.doc_id AND m.x.j = pn.j))"""


@query(f"WITH {_CONFLICTS} SELECT doc_id, outcome, count(*) AS n FROM r GROUP BY doc_id, outcome")
def match_conflicts(spark, sf_dir):
    return scoring.match(*conflicts(spark, sf_dir), exact=False).groupBy("doc_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


_SCORES = f"""WITH {_CONFLICTS}, ty AS (SELECT unnest({list(PII_TYPES)!r}) AS kind),
    q AS (SELECT ty.kind, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn, count(*) FILTER (outcome = 'type_confusion') AS wrong FROM ty LEFT JOIN r ON ty.kind = r.kind GROUP BY ty.kind),
    w AS (SELECT kind, tp, fp, fn, wrong, tp / nullif(tp + fp + wrong, 0) AS pr, tp / nullif(tp + fn + wrong, 0) AS re FROM q),
    z AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) WHEN pr + re = 0 THEN 0 END AS f1 FROM w)"""


@query(_SCORES + " SELECT kind AS pii_type, tp, fp, fn, wrong AS type_confusion, round(pr, 9) AS precision_, round(re, 9) AS recall_, round(f1, 9) AS f1_ FROM z")
def score_by_type(spark, sf_dir):
    d = scoring.score(scoring.match(*conflicts(spark, sf_dir), exact=False)).where("pii_type is not null")
    return d.select("pii_type", "tp", "fp", "fn", "type_confusion", *[F.round(c, 9).alias(f"{c}_") for c in ("precision", "recall", "f1")])


@query(_SCORES + " SELECT round(avg(pr), 9) AS precision_, round(avg(re), 9) AS recall_, round(avg(f1), 9) AS f1_ FROM z WHERE tp + fp + fn > 0")
def macro_rates(spark, sf_dir):
    d = scoring.macro(scoring.score(scoring.match(*conflicts(spark, sf_dir), exact=False)))
    return d.select(*[F.round(c, 9).alias(f"{c}_") for c in ("precision", "recall", "f1")])


@query(_SCORES + """, fl(kind, metric, least) AS (VALUES ('EMAIL', 'precision', 0.2), ('EMAIL', 'recall', 0.999), ('PHONE', 'recall', 0.1), ('SSN', 'f1', 0.1))
    SELECT kind AS pii_type, metric, CAST(least AS DOUBLE) AS minimum FROM fl JOIN z USING (kind) WHERE CASE metric WHEN 'precision' THEN pr WHEN 'recall' THEN re ELSE f1 END IS NULL OR CASE metric WHEN 'precision' THEN pr WHEN 'recall' THEN re ELSE f1 END + 1e-12 < least""")
def floors_missed(spark, sf_dir):
    floors = [("EMAIL", "precision", 0.2), ("EMAIL", "recall", 0.999), ("PHONE", "recall", 0.1), ("SSN", "f1", 0.1)]
    rows = F.array(*[F.struct(F.lit(k).alias("pii_type"), F.lit(m).alias("metric"), F.lit(x).alias("minimum")) for k, m, x in floors])
    scores = scoring.score(scoring.match(*conflicts(spark, sf_dir), exact=False))
    return scoring.floor_failures(scores, spark.range(1).select(F.inline(rows))).select("pii_type", "metric", "minimum")


@query(f"""WITH {_CONFLICTS}, d AS (SELECT DISTINCT doc_id, 300 AS chars FROM k), h AS (SELECT doc_id, unnest(range(0, 300)) AS x FROM d),
    g AS (SELECT h.doc_id, x, EXISTS (SELECT 1 FROM t WHERE t.doc_id = h.doc_id AND x >= t.s AND x < t.e) AS a, EXISTS (SELECT 1 FROM p WHERE p.doc_id = h.doc_id AND x >= p.s AND x < p.e) AS b FROM h)
    SELECT doc_id, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM g GROUP BY doc_id""")
def char_accuracy(spark, sf_dir):
    t, p = conflicts(spark, sf_dir)
    docs = t.select("doc_id").distinct().withColumn("text", F.lpad(F.lit("x"), 300, "x"))
    return scoring.char_accuracy(docs, t, p).select("doc_id", F.round("accuracy", 9).alias("accuracy"))


_TRUTH = [("abcdef", 0, 3, "abc", True, None), ("abcdef", 0, 3, "abd", True, "slice"), ("abcdef", 1, 3, "bc", False, "fingerprint")]


@query(f"SELECT doc_id, broken FROM {cases_sql(_TRUTH, ('text', 'a', 'b', 'value', 'sure', 'broken'))} WHERE broken IS NOT NULL")
def truth_violations(spark, sf_dir):
    d = cases(spark, sf_dir, _TRUTH, ("text", "a", "b", "value", "sure", "x"))
    mark = scoring.fingerprint(F.when(F.col("sure"), "1").otherwise("2"), F.col("text"))
    corpora = d.select("doc_id", "text", F.lit("1").alias("version"), mark.alias("fingerprint"))
    truth = d.select("doc_id", F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end"), F.col("value").alias("text"))
    return scoring.truth_violations(corpora, truth)


# Audits


@query(r"""
    WITH k AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS l FROM k)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (strpos(l, 'the') > 0) AS moved FROM u GROUP BY doc_id""")
def churn(spark, sf_dir):
    """Whole documents with one word taken out: the lines that held it changed."""
    d = documents(spark, sf_dir).withColumn("rewritten", F.replace("text", F.lit("the"), F.lit("")))
    return audit.churn(d).select("doc_id", F.col("blocks").cast("long").alias("lines"), F.col("changed").cast("long").alias("moved"))


_PROBED = [
    ("Mr. Omar Farooqui paid; see http://a.site.org/x", "x", "honorific_person:Omar Farooqui|url:http://a.site.org"),
    ("Attn: Tara Velloor Email x", "x", "labelled_person:Tara Velloor"),
    ("Name: Tara", "x", ""),
    ("+44 20 7946 0958 and 219-09-9998", "x", "phone_intl:+44 20 7946 0958|ssn:219-09-9998"),
    ("4111 1111 1111 1111, 10.1.2.3", "x", "card:4111 1111 1111 1111|ipv4:10.1.2.3"),
    ("of Orchid Mills GmbH", "x", "legal_entity:Orchid Mills GmbH"),
    ("a.b@c.org a.b@c.org", "x", "email:a.b@c.org"),
]


@query(f"SELECT doc_id, found FROM {cases_sql(_PROBED, ('text', 'x', 'found'))}")
def probe_values(spark, sf_dir):
    d = cases(spark, sf_dir, _PROBED, ("text", "x", "y")).select("doc_id", "text")
    found = audit.probe_values(d).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "probe", "value"))), "|").alias("found"))
    return d.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit("")).alias("found"))


_PAIRS = [
    # text, rewritten, candidates and what is left, by category
    ("mail a{n}@c.org, host 10.1.2.3", "mail b@d.org, host 10.1.2.3", 1, 0, 1, 1),
    ("mail a{n}@c.org, host 10.1.2.4", "mail b@d.org, host 10.9.9.9", 1, 0, 1, 0),
    ("mail a{n}@c.org", "mail a{n}@c.org", 1, 1, 0, 0),
]


@query(f"""
    WITH k AS (SELECT sum(m) AS m, sum(ml) AS ml, sum(h) AS h, sum(hl) AS hl FROM {cases_sql(_PAIRS, ('text', 'rewritten', 'm', 'ml', 'h', 'hl'))}), c AS (SELECT 'Email addresses' AS category, m AS n, ml AS l FROM k UNION ALL SELECT 'IP addresses', h, hl FROM k UNION ALL SELECT NULL, m + h, ml + hl FROM k)
    SELECT category, CAST(n AS BIGINT) AS candidates, CAST(n - l AS BIGINT) AS removed, CAST(l AS BIGINT) AS remaining, round(100.0 * (n - l) / n, 1) AS pct FROM c""")
def audit_scores(spark, sf_dir):
    return audit.category_score(cases(spark, sf_dir, _PAIRS, ("text", "rewritten", "a", "b", "c", "d")), CONFIG).select("category", "candidates", "removed", "remaining", "pct")


@query(f"""
    WITH k AS (SELECT sum(ml + hl) AS a FROM {cases_sql(_PAIRS, ('text', 'rewritten', 'm', 'ml', 'h', 'hl'))}) SELECT CAST(a AS BIGINT) AS applied_leaks, CAST(a AS BIGINT) AS probe_leaks, CAST(2 * (SELECT count(*) FROM customer) AS BIGINT) AS metadata_fields, false AS clean FROM k""")
def audit_totals(spark, sf_dir):
    d = cases(spark, sf_dir, _PAIRS, ("text", "rewritten", "a", "b", "c", "d"))
    parts = d.select("doc_id", F.lit("docProps/core.xml").alias("part_name"), F.lit("<dc:creator>Bob</dc:creator><cp:lastModifiedBy>Al</cp:lastModifiedBy>").alias("text"))
    return audit.totals(d, CONFIG, parts=parts)


_NAMED = [("<dc:creator>Bob {n}</dc:creator><cp:lastModifiedBy> </cp:lastModifiedBy>", "dc:creator=Bob {n}"), ("<dc:creator></dc:creator><cp:lastModifiedBy>Al</cp:lastModifiedBy>", "cp:lastModifiedBy=Al"), ("<dc:creator/>", None)]


@query(f"SELECT doc_id, named FROM {cases_sql(_NAMED, ('text', 'named'))} WHERE named IS NOT NULL")
def metadata_fields(spark, sf_dir):
    d = cases(spark, sf_dir, _NAMED, ("text", "x")).withColumn("part_name", F.lit("docProps/core.xml"))
    return audit.metadata(d).select("doc_id", F.concat_ws("=", "field", "value").alias("named"))


_WORDS = ["Harbour", "Garden", "Market", "Temple"]


@query("""
    WITH k AS (SELECT o_orderkey, (['Harbour', 'Garden', 'Market', 'Temple'])[o_orderkey % 4 + 1] AS w, CASE WHEN o_orderkey % 4 = 0 THEN false WHEN o_orderkey % 4 = 1 THEN o_custkey % 5 = 0 WHEN o_orderkey % 4 = 2 THEN o_custkey % 2 = 0 ELSE true END AS stays FROM orders),
    n AS (SELECT w AS word, count(*) AS in_source, count(*) FILTER (stays) AS in_output FROM k GROUP BY w)
    SELECT word, in_source, in_output FROM n WHERE in_source >= 12 AND in_output <= in_source * 0.25""")
def over_rewriting(spark, sf_dir):
    key = F.col("o_orderkey") % 4
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (key + 1).cast("int"))
    stays = F.when(key == 0, False).when(key == 1, F.col("o_custkey") % 5 == 0).when(key == 2, F.col("o_custkey") % 2 == 0).otherwise(True)
    d = table(spark, sf_dir, "orders").select(F.concat(F.lit("the "), word, F.lit(" there")).alias("text"), F.concat(F.lit("the "), F.when(stays, word).otherwise("x"), F.lit(" there")).alias("rewritten"))
    return audit.over_rewriting(d)


_QUALITY = [("4111 1111 1111 1111", True, True, False, False), ("4111 1111 1111 1112", True, False, False, False), ("9999 9999 9999 9995", True, True, False, False), ("219-09-{n}", False, False, False, False), ("000-09-9998", False, False, True, True), ("219-09-9998", False, False, True, False)]


@query("SELECT CAST(least(3, count(*)) AS BIGINT) AS cards, CAST(1 AS BIGINT) AS fail_luhn, CAST(1 AS BIGINT) AS bad_scheme, CAST(2 AS BIGINT) AS ssns, CAST(1 AS BIGINT) AS bad_ssns FROM customer")
def surrogate_quality(spark, sf_dir):
    d = cases(spark, sf_dir, _QUALITY, ("rewritten", "a", "b", "c", "d"))
    return audit.surrogate_quality(d)


@query(r"""
    WITH k AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS l FROM k), c AS (SELECT count(*) FILTER (strpos(l, 'the') > 0) AS changed, count(*) AS blocks FROM u)
    SELECT blocks, blocks AS new_blocks, CAST(0 AS BIGINT) AS unmatched, CAST((SELECT sum(length(t)) FROM k) AS BIGINT) AS chars, CAST((SELECT sum(length(replace(t, 'the', ''))) FROM k) AS BIGINT) AS new_chars, (SELECT count(*) FROM k) AS tables, 2 * (SELECT count(*) FROM k) AS parts, changed, round(100.0 * changed / blocks, 1) AS churn_pct FROM c""")
def package_structure(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("new_text", F.replace("text", F.lit("the"), F.lit("")))
    d = d.select("*", spans.line_blocks(F.col("text")).alias("blocks"), spans.line_blocks(F.col("new_text")).alias("new_blocks"), *[F.lit(n).alias(c) for c, n in (("n_tables", 1), ("new_n_tables", 1), ("n_parts", 2), ("new_n_parts", 2))])
    return audit.structure(cut(d)).drop("new_tables", "new_parts")

