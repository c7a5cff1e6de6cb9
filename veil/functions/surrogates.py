"""Shape-preserving surrogate values as native expressions.

Digits and choices come from SHA-256 of (seed, scope, type, key, attempt), so they depend on
nothing else and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import COMPANY_SUFFIXES, HONORIFICS, SECOND_LEVEL_SUFFIXES
from .text import digits_of, let, squeeze, strings

FIRST = ["Aarav", "Bela", "Corin", "Dalia", "Edric", "Farah", "Gavin", "Hanna", "Ilyas", "Jorin", "Kavya", "Leona", "Marek", "Nadia", "Orson", "Petra", "Quill", "Runa", "Selim", "Tilda", "Ulric", "Vanya", "Wendel", "Xenia", "Yusuf", "Zelda"]
LAST = ["Abernale", "Brackwell", "Castorio", "Dunvale", "Ellisande", "Farrowby", "Grenholt", "Harkness", "Ilverton", "Jarrowick", "Kestrelli", "Lindqvist", "Marchetti", "Norrland", "Oakhurst", "Penhallow", "Quistgard", "Ravenhill", "Sandoval", "Thornbury", "Umbertson", "Valmonte", "Winterton", "Yarborough", "Zimmerli"]
FIRMS = ["Amberline", "Bluecrest", "Cobaltway", "Dawnfield", "Eastmark", "Fernhollow", "Goldspire", "Highmoor", "Ironbay", "Junegrove", "Kingfisher", "Lakeshore", "Moonrise", "Northgate", "Opaldale", "Pinecroft", "Quarrystone", "Riverbend", "Silverleaf", "Tidewater", "Upland", "Vistapoint", "Westbrook", "Yellowstar", "Zephyr"]
TRADES = ["Works", "Metals", "Systems", "Foods", "Textiles", "Energy", "Partners", "Trading", "Chemicals", "Logistics", "Motors", "Papers"]
STREETS = ["Harbour", "Meadow", "Willow", "Station", "Temple", "Orchard", "Canal", "Garden", "Hillside", "Market", "Cedar", "Palace"]
TOWNS = ["Easthaven", "Marlow", "Bramford", "Kelvindale", "Sunderpur", "Rosewick", "Ashgate", "Tarnby", "Ludford", "Norwell"]


#: Parts of made-up words.
ONSETS = ["b", "br", "c", "d", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "r", "s", "st", "t", "v", "w"]
RIMES = ["a", "ando", "ara", "e", "ell", "en", "i", "ima", "in", "o", "olt", "or", "u", "una", "urn", "y"]


def digest(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def digits(h: Column) -> Column:
    """64 decimal digits of a hexadecimal digest."""
    return F.translate(h, "abcdef", "602846")


def number(h: Column, at: int, below: int | Column) -> Column:
    """A number below a bound from seven hexadecimal digits at a place."""
    return F.pmod(F.conv(F.substring(h, at, 7), 16, 10).cast("long"), F.lit(below) if isinstance(below, int) else below)


def pick(h: Column, at: int, values: list[str]) -> Column:
    return F.element_at(strings(values), (number(h, at, len(values)) + 1).cast("int"))


def made_word(h: Column, at: int) -> Column:
    """A word of three syllables from twelve hexadecimal digits: 32 million of them."""
    parts = [pick(h, at + 4 * i, values) for i, values in enumerate((ONSETS, RIMES, ONSETS, RIMES, ONSETS, RIMES))]
    return F.initcap(F.concat(*parts))


def repaired(value: Column, forbidden: Column, h: Column) -> Column:
    """value with each token of four letters or more that is forbidden replaced by a made-up word."""
    pieces = F.split(value, r"(?U)(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})")
    word = made_word(h, 29)
    cased = lambda x: F.when(F.upper(x) == x, F.upper(word)).when(F.lower(x) == x, F.lower(word)).otherwise(word)
    return F.array_join(F.transform(pieces, lambda x: F.when((F.length(x) >= 4) & F.array_contains(forbidden, F.lower(x)), cased(x)).otherwise(x)), "")


def reshape(template: Column, new: Column) -> Column:
    """new poured into the digit places of template; what is left of template ends where new does."""
    walked = F.aggregate(
        F.split(template, ""),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out"), F.lit(False).alias("done")),
        lambda acc, c: F.when(acc["done"], acc)
        .when(~c.rlike(r"(?U)^\d$"), F.struct(acc["at"].alias("at"), F.concat(acc["out"], c).alias("out"), F.lit(False).alias("done")))
        .when(acc["at"] > F.length(new), F.struct(acc["at"].alias("at"), acc["out"].alias("out"), F.lit(True).alias("done")))
        .otherwise(F.struct((acc["at"] + 1).alias("at"), F.concat(acc["out"], F.substring(new, acc["at"], F.lit(1))).alias("out"), F.lit(False).alias("done"))),
        lambda acc: acc["out"],
    )
    return walked


def luhn_digit(payload: Column) -> Column:
    """The check digit of a payload without one."""
    back = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, F.get(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int"))).otherwise(c.try_cast("int")))
    total = F.aggregate(back, F.lit(0), lambda acc, n: acc + F.coalesce(n, F.lit(0)))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def normalise_key(pii_type: Column, value: Column) -> Column:
    """The part of a value that tells whether two surfaces are the same thing."""
    v = squeeze(value)
    return (
        F.when(pii_type.isin("PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS"), F.regexp_replace(v, "[^a-z0-9:]", ""))
        .when(pii_type == "EMAIL", v)
        .otherwise(F.regexp_replace(v, r"(?U)[^\w\s@.]", ""))
    )


def honorific(name: Column) -> Column:
    """The honorific at the front of a name, or an empty string."""
    bare = sorted({h.rstrip(".") for h in HONORIFICS})
    return F.regexp_extract(F.trim(name), r"(?iU)^((?:" + "|".join(bare) + r")\.*)\s+\S", 1)


def name_tokens(name: Column) -> Column:
    rest = F.substring(F.trim(name), F.length(honorific(name)) + 1, F.length(name))
    return F.filter(F.split(F.lower(rest), r"(?U)[^\w]+"), lambda t: t != "")


def local_forms(name: Column) -> Column:
    """Local parts of mail addresses that a name may have."""
    return let(name_tokens(name), _forms)


def _forms(t: Column) -> Column:
    first, last = F.get(t, F.lit(0)), F.get(t, F.size(t) - 1)
    initial = F.substring(first, 1, 1)
    forms = F.array(first, last, F.concat(first, F.lit("."), last), F.concat(first, last), F.concat(initial, F.lit("."), last), F.concat(initial, last), F.concat(first, F.lit("_"), last), F.array_join(F.transform(t, lambda x: F.substring(x, 1, 1)), ""))
    forms = F.when(F.size(t) > 2, F.array_append(forms, F.concat(first, F.lit("."), F.get(t, F.lit(1)), F.lit("."), last))).otherwise(forms)
    return F.when(F.size(t) > 0, F.array_distinct(forms)).otherwise(F.array().cast("array<string>"))


def company_suffix(company: Column) -> Column:
    """The legal suffix that ends a company's name, as written, or an empty string."""
    fits = F.filter(strings(COMPANY_SUFFIXES), lambda s: F.endswith(F.lower(company), s))
    return F.coalesce(F.right(company, F.length(F.get(fits, F.lit(0)))), F.lit(""))


def company_base(company: Column) -> Column:
    return F.rtrim(F.left(company, F.length(company) - F.length(company_suffix(company))))


def split_host(value: Column) -> Column:
    """(prefix, core, suffix) of a host or URL; second-level suffixes stay in the suffix."""
    prefix = r"(?i)^((?:https?://)?(?:www\.)?)"
    second = lambda x: (F.size(x) >= 3) & F.lower(F.get(x, F.size(x) - 2)).isin(*SECOND_LEVEL_SUFFIXES)
    labels = F.split(F.regexp_replace(value, prefix, ""), r"\.", -1)
    cuts = let(labels, lambda x: F.struct(x.alias("labels"), F.when(second(x), 2).otherwise(1).alias("n"), F.size(x).alias("size")))
    core = lambda c: F.array_join(F.when(c["size"] > c["n"], F.slice(c["labels"], F.lit(1), F.greatest(c["size"] - c["n"], F.lit(0)))).otherwise(c["labels"]), ".")
    suffix = lambda c: F.when(c["size"] > c["n"], F.concat(F.lit("."), F.array_join(F.slice(c["labels"], F.greatest(c["size"] - c["n"], F.lit(0)) + 1, c["n"]), "."))).otherwise(F.lit(""))
    return let(cuts, lambda c: F.struct(F.regexp_extract(value, prefix, 1).alias("prefix"), core(c).alias("core"), suffix(c).alias("suffix")))


#: Attempts that draw from the lists alone; later ones make words, so that names have no end.
LISTED = 3


def fake_name(original: Column, h: Column, n: Column) -> Column:
    core = F.concat_ws(" ", pick(h, 1, FIRST), F.when(n < LISTED, pick(h, 9, LAST)).otherwise(made_word(h, 17)))
    title = honorific(original)
    return F.when(title != "", F.concat_ws(" ", title, core)).otherwise(core)


def fake_company(original: Column, h: Column, n: Column) -> Column:
    core = F.concat_ws(" ", F.when(n < LISTED, pick(h, 1, FIRMS)).otherwise(made_word(h, 17)), pick(h, 9, TRADES))
    suffix = company_suffix(original)
    return F.when(suffix == "", core).otherwise(F.concat(core, F.lit(" "), F.ltrim(suffix)))


def not_all_zero(d: Column) -> Column:
    return F.when(d.rlike("^0+$"), F.concat(F.substring(d, F.lit(1), F.length(d) - 1), F.lit("1"))).otherwise(d)


def fake_phone(original: Column, h: Column, n: Column | None = None) -> Column:
    d = digits_of(original)
    head = F.ltrim(original)
    keep = F.when(F.startswith(head, F.lit("+91")), 2).when(head.rlike(r"^\+1(?!\d*91)"), 1).otherwise(0)
    rest = F.substring(digits(h), F.lit(1), F.length(d) - keep)
    return reshape(original, F.concat(F.substring(d, F.lit(1), keep), not_all_zero(rest)))


def fake_address(original: Column, h: Column, n: Column | None = None) -> Column:
    pin = F.regexp_extract(original, r"(\d{5,6})\s*$", 1)
    line = F.concat_ws(" ", (number(h, 1, 998) + 1).cast("string"), pick(h, 9, STREETS), F.lit("Road,"), pick(h, 17, TOWNS))
    more = F.transform(F.slice(F.split(original, "\n"), 2, 100), lambda x: F.concat_ws(" ", F.lit("Block"), pick(h, 25, STREETS)))
    body = F.array_join(F.concat(F.array(line), more), "\n")
    new = not_all_zero(F.substring(digits(h), F.lit(33), F.length(pin)))
    return F.when(pin != "", F.concat_ws(" ", body, new)).otherwise(body)


def fake_ssn(original: Column, h: Column, n: Column | None = None) -> Column:
    area = number(h, 1, 899) + 1
    area = F.when(area == 666, 665).otherwise(area)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return reshape(original, F.concat(pad(area, 3), pad(number(h, 9, 99) + 1, 2), pad(number(h, 17, 9999) + 1, 4)))


def card_prefix(d: Column) -> Column:
    n = (
        F.when(d.rlike("^4"), 1)
        .when(d.rlike("^3[47]"), 2)
        .when(d.rlike("^5[1-5]"), 2)
        .when(F.coalesce(F.substring(d, 1, 4).try_cast("int").between(2221, 2720), F.lit(False)), 4)
        .otherwise(F.when(F.length(d) >= 6, 6).otherwise(F.greatest(F.lit(1), F.length(d) - 1)))
    )
    return F.substring(d, F.lit(1), n)


def fake_card(original: Column, h: Column, n: Column | None = None) -> Column:
    d = digits_of(original)
    body = F.substring(F.concat(card_prefix(d), digits(h)), F.lit(1), F.length(d) - 1)
    return reshape(original, F.concat(body, luhn_digit(body)))


def fake_dob(original: Column, h: Column, n: Column | None = None) -> Column:
    """A day from 1945-01-01 to 2005-12-31 in the layout of the original; others become ISO."""
    day = F.date_add(F.to_date(F.lit("1945-01-01")), number(h, 1, 22280).cast("int"))
    v = F.trim(original)
    out = lambda f: F.date_format(day, f)
    slash = r"^(\d{1,2})/(\d{1,2})/\d{4}$"
    month_first = F.coalesce(F.regexp_extract(v, slash, 2).try_cast("int") > 12, F.lit(False)) & F.coalesce(F.regexp_extract(v, slash, 1).try_cast("int") <= 12, F.lit(False))
    return (
        F.when(v.rlike(slash), F.when(month_first, out("MM/dd/yyyy")).otherwise(out("dd/MM/yyyy")))
        .when(v.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), out("dd-MM-yyyy"))
        .when(v.rlike(r"(?U)^\d{1,2}\s+[A-Za-z]+\s+\d{4}$"), out("dd MMMM yyyy"))
        .when(v.rlike(r"(?U)^[A-Za-z]+\s+\d{1,2},\s+\d{4}$"), out("MMMM dd, yyyy"))
        .when(v.rlike(r"(?U)^[A-Za-z]+\s+\d{1,2}\s+\d{4}$"), out("MMMM dd yyyy"))
        .otherwise(out("yyyy-MM-dd"))
    )


def fake_ip(original: Column, h: Column, n: Column | None = None) -> Column:
    octet = lambda at, low, n: (number(h, at, n) + low).cast("string")
    six = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(h, (i * 4 + 1).cast("int"), F.lit(4))), ":")
    private = F.concat_ws(".", F.lit("10"), octet(1, 0, 256), octet(9, 0, 256), octet(17, 1, 254))
    public = F.concat_ws(".", octet(1, 11, 89), octet(9, 0, 256), octet(17, 0, 256), octet(25, 1, 254))
    return F.when(F.contains(original, F.lit(":")), six).when(F.regexp_extract(original, r"^(\d+)\.", 1).isin("10", "172", "192"), private).otherwise(public)


def fake_label(h: Column, n: Column) -> Column:
    return F.lower(F.concat(F.when(n < LISTED, pick(h, 1, FIRMS)).otherwise(made_word(h, 33)), pick(h, 9, TRADES), F.substring(digits(h), 30, 2)))


def fake_user(h: Column, n: Column) -> Column:
    return F.lower(F.concat(pick(h, 1, FIRST), F.lit("."), F.when(n < LISTED, pick(h, 9, LAST)).otherwise(made_word(h, 33)), F.substring(digits(h), 30, 2)))


#: Generators by type, but for the two that go by the mapping of domain labels.
GENERATORS = {
    "FULL_NAME": fake_name,
    "COMPANY": fake_company,
    "PHONE": fake_phone,
    "ADDRESS": fake_address,
    "SSN": fake_ssn,
    "CREDIT_CARD": fake_card,
    "DOB": fake_dob,
    "IP_ADDRESS": fake_ip,
}
