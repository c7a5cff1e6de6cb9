"""The consistency map: one surrogate per (type, key) of a scope.

assign() keeps the map inside the document's row, so documents stay independent and no
row is shuffled.  Names come first, then companies, then shared domain labels, then the
rest in order of place.  A token of a real name in a candidate is replaced by another word.
A candidate is taken if it is no real value and not taken yet; the next attempt hashes anew,
from the fourth on with made-up words, of which there are millions.  A type of few values can
run out (all days, all private addresses), as can any that fails a dozen times: then
the surrogate is null, the row's text is null and its status says so; only the check of a
result raises.  corpus_mapping() makes one map for a whole corpus by ranks instead, where a
fold would need all values in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions import surrogates as S
from veil.functions.lexicon import HONORIFICS, PII_TYPES
from veil.functions.text import first_places, let
from veil.store import cut, small

from .rules import Config

ATTEMPTS = 12
#: Keys that a range of hashes holds, about; the bytes of a row of their counts.
RANGE_KEYS, RANGE_BYTES = 50_000, 200
FIELDS = ("pii_type", "key", "surface", "fake")
MAPPED = "array<struct<" + ",".join(f"{c}:string" for c in FIELDS) + ">>"
ALLOTTED = "struct<" + ",".join(f"{c}:string" for c in (*FIELDS, "low")) + ">"


def distinct_keys(entities: Column) -> Column:
    """The first surface of each (type, key), in order of place."""
    keyed = F.transform(F.array_sort(entities), lambda e: F.struct(e["pii_type"].alias("pii_type"), S.normalise_key(e["pii_type"], e["text"]).alias("key"), e["text"].alias("surface")))
    return first_places(keyed, id_of)


def id_of(k: Column) -> Column:
    """A type and key as one string."""
    return F.concat(k["pii_type"], F.lit("\x1f"), k["key"])


def long_tokens(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(r"(?U)[\p{L}]{4,}"), F.lit(0)), F.lower)


def name_parts(entities: Column) -> Column:
    """Tokens of four letters or more of the real names."""
    names = F.filter(entities, lambda e: e["pii_type"] == "FULL_NAME")
    every = F.array_distinct(F.flatten(F.transform(names, lambda e: long_tokens(e["text"]))))
    return F.array_except(every, F.array(*[F.lit(h.rstrip(".")) for h in HONORIFICS]))


def real_values(entities: Column) -> Column:
    both = F.concat(F.transform(entities, lambda e: F.lower(e["text"])), F.transform(entities, lambda e: S.normalise_key(e["pii_type"], e["text"])))
    return F.array_distinct(both)


def free(candidate: Column, original: Column, taken: Column, real: Column) -> Column:
    """Whether a candidate is none of the lower-case strings of taken and real, nor the original."""
    return let(F.lower(candidate), lambda low: (candidate != original) & ~F.coalesce(F.array_contains(taken, low), F.lit(False)) & ~F.array_contains(real, low))


def allot(keys: Column, taken: Column, make, real: Column, parts: Column) -> Column:
    """taken plus a surrogate, or null, for each key; make(key, attempt) gives candidates."""

    def one(acc: Column, k: Column) -> Column:
        def whole(c: Column, n: Column) -> Column:
            return F.when(F.arrays_overlap(long_tokens(c), parts), S.repaired(c, parts, F.sha2(F.concat(c, n.cast("string")), 256))).otherwise(c)

        def attempt(found: Column, n: Column) -> Column:
            tried = lambda: let(let(make(k, n), lambda c: whole(c, n)), lambda c: F.when(free(c, k["surface"], acc["low"], real), c))
            return F.when(found.isNotNull(), found).otherwise(tried())

        fake = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("string"), attempt)

        # low stands with its fake, as a struct of the whole of acc would be copied at each key
        return F.array_append(acc, let(fake, lambda f: F.struct(k["pii_type"].alias("pii_type"), k["key"].alias("key"), k["surface"].alias("surface"), f.alias("fake"), F.lower(f).alias("low"))).cast(ALLOTTED))

    start = F.transform(taken.cast(MAPPED), lambda m: F.struct(*[m[c].alias(c) for c in FIELDS], F.lower(m["fake"]).alias("low"))).cast(f"array<{ALLOTTED}>")
    return F.transform(F.aggregate(keys, start, one), lambda m: F.struct(*[m[c].alias(c) for c in FIELDS])).cast(MAPPED)


def of_type(keys: Column, *types: str) -> Column:
    return F.filter(keys, lambda k: k["pii_type"].isin(*types))


def host_of(surface: Column) -> Column:
    """The host part of a mail address or website."""
    return F.when(F.contains(surface, F.lit("@")), F.substring_index(surface, "@", -1)).otherwise(surface)


def letters(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def assign(docs: DataFrame, config: Config, scope: str = "doc_id", column: str = "entities") -> DataFrame:
    """docs with assigned (entities with replacement), mapping (surface to fake) and status (null if all is well).

    Rows without entities pass through all steps on empty arrays.
    """
    e, seed = F.col(column), config.seed
    keep = list(docs.columns)
    d = docs.withColumn("_keys", distinct_keys(e)).withColumn("_real", real_values(e)).withColumn("_parts", name_parts(e))
    real, parts, sc = F.col("_real"), F.col("_parts"), F.coalesce(F.col(scope).cast("string"), F.lit(""))

    def generic(k: Column, n: Column) -> Column:
        def of(h: Column) -> Column:
            out = F.lit(None).cast("string")
            for kind, make in S.GENERATORS.items():
                if kind not in ("FULL_NAME", "COMPANY"):
                    out = F.when(k["pii_type"] == kind, make(k["surface"], h, n)).otherwise(out)
            return out

        return let(S.digest(seed, sc, k["pii_type"], k["key"], n), of)

    def only(kind: str):
        return lambda k, n: let(S.digest(seed, sc, k["pii_type"], k["key"], n), lambda h: S.GENERATORS[kind](k["surface"], h, n))

    d = d.withColumn("_map", allot(of_type(F.col("_keys"), "FULL_NAME"), F.array().cast(MAPPED), only("FULL_NAME"), real, parts))
    d = d.withColumn("_map", allot(of_type(F.col("_keys"), "COMPANY"), F.col("_map"), only("COMPANY"), real, parts))
    # one label for all sites and mail addresses of a real label
    cores = F.array_distinct(F.transform(of_type(F.col("_keys"), "EMAIL", "DOMAIN"), lambda k: F.lower(S.split_host(host_of(k["surface"]))["core"])))
    asked = F.transform(cores, lambda c: F.struct(F.lit("LABEL").alias("pii_type"), c.alias("key"), c.alias("surface")))
    companies = of_type(F.col("_map"), "COMPANY")

    def label(k: Column, n: Column) -> Column:
        own = F.filter(companies, lambda m: (letters(k["key"]) != "") & F.contains(letters(m["surface"]), letters(k["key"])))
        derived = F.when(n == 0, letters(S.company_base(F.get(own, F.lit(0))["fake"])))
        return F.coalesce(derived, let(S.digest(seed, sc, F.lit("LABEL"), k["key"], n), lambda h: S.fake_label(h, n)))

    d = d.withColumn("_labels", allot(asked, F.array().cast(MAPPED), label, real, parts))
    names, labels = of_type(F.col("_map"), "FULL_NAME"), F.col("_labels")

    def host(value: Column) -> Column:
        fake = lambda h: F.get(F.filter(labels, lambda m: m["key"] == F.lower(h["core"])), F.lit(0))["fake"]
        return let(S.split_host(value), lambda h: F.concat(h["prefix"], fake(h), h["suffix"]))

    def mail(k: Column, n: Column) -> Column:
        local = F.substring_index(k["surface"], "@", 1)
        base = F.substring_index(F.lower(local), "+", 1)
        tag = F.when(F.contains(local, F.lit("+")), F.concat(F.lit("+"), F.regexp_extract(local, r"\+(.*)$", 1))).otherwise(F.lit(""))
        person = F.get(F.filter(names, lambda m: F.array_contains(S.local_forms(m["surface"]), base)), F.lit(0))
        own = F.when(n == 0, let(S.name_tokens(person["fake"]), lambda t: F.concat(F.get(t, F.lit(0)), F.lit("."), F.get(t, F.size(t) - 1))))
        user = F.coalesce(own, let(S.digest(seed, sc, k["pii_type"], k["key"], n), lambda h: S.fake_user(h, n)))
        return F.concat(user, tag, F.lit("@"), host(F.substring_index(k["surface"], "@", -1)))

    def site(k: Column, n: Column) -> Column:
        return F.when(n == 0, host(k["surface"])).otherwise(let(S.split_host(k["surface"]), lambda h: F.concat(h["prefix"], let(S.digest(seed, sc, k["pii_type"], k["key"], n), lambda x: S.fake_label(x, n)), h["suffix"])))

    rest = F.filter(F.col("_keys"), lambda k: ~k["pii_type"].isin("FULL_NAME", "COMPANY"))
    by_kind = lambda k, n: F.when(k["pii_type"] == "EMAIL", mail(k, n)).when(k["pii_type"] == "DOMAIN", site(k, n)).otherwise(generic(k, n))
    d = d.withColumn("_map", allot(rest, F.col("_map"), by_kind, real, parts))
    own_id = lambda x: F.concat(x["pii_type"], F.lit("\x1f"), S.normalise_key(x["pii_type"], x["text"]))
    fake_of = lambda x, ids: F.get(F.col("_map"), (F.array_position(ids, own_id(x)) - 1).cast("int"))["fake"]
    # bound here, as a column of ids could be written into the lambda and computed for each entity
    assigned = let(F.transform("_map", id_of), lambda ids: F.transform(e, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "source", "pii_type", "text", "confidence", "priority")], fake_of(x, ids).alias("replacement"))))
    d = d.withColumn("assigned", assigned)
    pairs = F.array_distinct(F.transform("assigned", lambda x: F.struct(x["text"].alias("k"), x["replacement"].alias("v"))))
    # a surface that stands under two types keeps the fake of its first place
    once = first_places(pairs, lambda p: p["k"])
    lost = F.array_sort(F.array_distinct(F.transform(F.filter("assigned", lambda x: x["replacement"].isNull()), lambda x: x["pii_type"])))
    status = F.when(F.size(lost) > 0, F.concat(F.lit("no free surrogate: "), F.array_join(lost, ", "))).alias("status")
    return d.withColumn("mapping", F.map_from_entries(once)).select(*keep, "assigned", "mapping", status)


def ranked(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """rows with rank, from 1 in each type, in order of a keyed hash.

    Ranks are counted inside hash ranges of some RANGE_KEYS rows, as many as the rows need,
    and the sizes of lower ranges are added, so no task holds all values of a type.
    """
    ranges = max(1, rows.count() // RANGE_KEYS)
    h = F.xxhash64(F.lit(seed), F.col(column))
    # the upper half of the hash without its sign, cut into equal ranges
    d = rows.withColumn("_h", h).withColumn("_range", F.floor((F.shiftright("_h", 32) + (1 << 31)) * ranges / float(1 << 32)).cast("long"))
    lower = Window.partitionBy("pii_type").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("pii_type", "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("pii_type", "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("pii_type", "_range").orderBy("_h", column))
    # a few counts a range: ten types at most
    d = d.withColumn("_inside", inside).join(small(sizes, RANGE_BYTES, ranges * len(PII_TYPES)), ["pii_type", "_range"])
    return d.withColumn("rank", F.col("_before") + F.col("_inside")).drop("_h", "_range", "_inside", "_before")


def corpus_mapping(entities: DataFrame, config: Config, pool: DataFrame) -> DataFrame:
    """One fake per (type, key) over all documents, from a pool (pii_type, candidate).

    Candidates that are real values, or hold a real name's token, are taken out by anti
    joins; keys and candidates are ranked by keyed hashes and meet by rank, so no fake is
    given twice and nothing needs a retry.  entities and pool are written once and read from
    there.  A key beyond the pool's size raises.
    """
    entities = cut(entities.select("pii_type", "text").distinct())
    pool = cut(pool)
    keyed = entities.withColumn("key", S.normalise_key(F.col("pii_type"), F.col("text")))
    keys = cut(keyed.groupBy("pii_type", "key").agg(F.min("text").alias("surface")))
    reals = entities.select(F.lower("text").alias("low")).distinct()
    tokens = entities.where("pii_type = 'FULL_NAME'").select(F.explode(long_tokens(F.col("text"))).alias("token")).distinct()
    p = pool.withColumn("low", F.lower("candidate")).join(reals, "low", "left_anti")
    bad = p.select("pii_type", "low", F.explode(long_tokens(F.col("candidate"))).alias("token")).join(tokens, "token", "left_semi").select("pii_type", "low").distinct()
    p = cut(p.join(bad, ["pii_type", "low"], "left_anti"))
    k, p = ranked(keys, "key", config.seed), ranked(p, "candidate", config.seed)
    p = p.select("pii_type", "rank", F.col("candidate").alias("fake"))
    fake = F.coalesce("fake", F.raise_error(F.concat(F.lit("no free surrogate for type "), F.col("pii_type"))).cast("string"))
    return k.join(p, ["pii_type", "rank"], "left").select("pii_type", "key", "surface", fake.alias("fake"))
