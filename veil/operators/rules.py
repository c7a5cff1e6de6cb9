"""Detection rules: declarative specs, their registry, and the union of their spans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions import context, validators
from veil.functions.lexicon import GENERIC_ENTITY_WORDS, NAME_STOP_TOKENS, PII_TYPES, PRIORITY_REGEX, PRIORITY_VALIDATED, SPACED_TLDS
from veil.functions.text import cut_out, digits_of, let, spans, strings, unmarked

#: In this order an array of entities sorts by place, then source.
ENTITY = "struct<start:int,end:int,source:string,pii_type:string,text:string,confidence:double,priority:int>"


@dataclass(frozen=True)
class Config:
    """What to detect and how; a plan is built from it, so disabled types cost nothing."""

    enabled_types: Sequence[str] = tuple(PII_TYPES)
    let_reference_numbers_through: bool = False
    seed: int = 0
    as_of: str | None = None
    agreement: bool = False
    use_candidates: bool = True
    model: str | None = None
    threshold: float = 0.5
    verify_output: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "enabled_types", tuple(self.enabled_types))
        if unknown := set(self.enabled_types) - set(PII_TYPES):
            raise ValueError(f"unknown types: {sorted(unknown)}")

    @property
    def today(self) -> Column:
        return F.to_date(F.lit(self.as_of)) if self.as_of else F.current_date()


Check = Callable[[Column, Column, Config], Column]


@dataclass(frozen=True)
class Rule:
    """A pattern whose group is the value, a cheap filter on texts, and a check of each span."""

    name: str
    pii_type: str
    priority: int
    pattern: str
    group: int = 0
    hint: str | None = None
    check: Check | None = None
    confidence: Callable[[Column], Column] = field(default=lambda span: F.lit(1.0))


def unlabelled(text: Column, span: Column, config: Config) -> Column:
    return F.lit(True) if config.let_reference_numbers_through else ~context.is_reference(text, span["start"])


def check_email(text: Column, span: Column, config: Config) -> Column:
    return ~span["text"].rlike(r"(?i)\.localhost$")


def check_phone(text: Column, span: Column, config: Config) -> Column:
    enough = let(F.length(digits_of(span["text"])), lambda n: n.between(7, 15))
    whole = F.length(context.digit_run(text, span["start"], span["end"])) <= 15
    return ~span["text"].rlike(r"[\r\n]") & enough & whole & unlabelled(text, span, config)


def check_ssn(text: Column, span: Column, config: Config) -> Column:
    return validators.ssn_valid(span["text"]) & unlabelled(text, span, config)


def check_card(text: Column, span: Column, config: Config) -> Column:
    card = let(digits_of(span["text"]), lambda d: F.length(d).between(13, 19) & (F.call_function("luhn_check", d) | validators.card_scheme_match(d)))
    return card & unlabelled(text, span, config)


def check_ip(text: Column, span: Column, config: Config) -> Column:
    return validators.ip_valid(span["text"]) & ~context.version_before(text, span["start"]) & unlabelled(text, span, config)


def check_dob(text: Column, span: Column, config: Config) -> Column:
    plausible = let(validators.parse_date(span["text"]), lambda born: born.isNotNull() & validators.plausible_birth(born, config.today))
    return context.has_birth_cue(text, span["start"]) & plausible


def check_address(text: Column, span: Column, config: Config) -> Column:
    return (F.length(span["text"]) >= 10) & ~F.contains(span["text"], F.lit("\n")) & span["text"].rlike(r"(?U)\d")


def words_of(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"(?U)\S+"), F.lit(0))


def check_contact(text: Column, span: Column, config: Config) -> Column:
    tokens = F.transform(words_of(span["text"]), lambda w: F.regexp_replace(F.lower(w), r"^\.+|\.+$", ""))
    return let(tokens, lambda t: (F.size(t) >= 2) & ~F.arrays_overlap(t, strings(NAME_STOP_TOKENS)))


def check_domain(text: Column, span: Column, config: Config) -> Column:
    labels = F.split(F.regexp_replace(span["text"], "^https?://", ""), r"\.")
    last = F.regexp_replace(F.element_at(labels, -1), r"(?U)^\s+|\s+$", "")
    return (F.size(labels) >= 2) & last.rlike(r"(?U)^\p{L}{2,}$") & (cut_out(text, span["start"] - 1, span["start"]) != "@")


def check_entity(text: Column, span: Column, config: Config) -> Column:
    words = F.transform(words_of(span["text"]), lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", ""))
    core = F.filter(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w != "")
    return ~F.contains(span["text"], F.lit("\n")) & F.exists(core, lambda w: ~F.array_contains(strings(GENERIC_ENTITY_WORDS), w))


# The rules' patterns.
_STOP = r"(?!(?i:" + "|".join(NAME_STOP_TOKENS) + r")\b)"
_NAME_TOKEN = _STOP + r"[A-Z][A-Za-z'’.\-]+"
_TLD = r"(?:\.[^\S\n](?:" + "|".join(SPACED_TLDS) + r"))?"
_STREETS = (
    r"Road|Rd|Street|St|Lane|Ln|Marg|Nagar|Sector|Block|Avenue|Ave|Boulevard|Blvd|Floor|Apt|Apartment|Hills|Vihar|Puram|Layout|"
    r"Enclave|Extension|Phase|Society|Complex|Towers?|Chambers|Bhavan|Estate|Gardens?|Colony|Chowk|"
    r"Industrial\s+(?:Park|Area|Estate)|P\.?\s*O\.?\s*Box"
)

RULES = [
    Rule("email", "EMAIL", PRIORITY_REGEX, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_%+-])", hint="@", check=check_email),
    Rule(
        "contact_person", "FULL_NAME", PRIORITY_REGEX,
        r"(?U)(?:Contact\s+Person|Compliance\s+Officer|Company\s+Secretary)\s*:?[^\S\n]*\n?[^\S\n]*(" + _NAME_TOKEN + r"(?:[^\S\n]+" + _NAME_TOKEN + r"){1,4})",
        group=1, hint=r"Person|Officer|Secretary", check=check_contact,
    ),
    Rule("domain", "DOMAIN", PRIORITY_REGEX, r"(?U)(?<![\w@.])(?:(?:https?://)?www\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*" + _TLD + r"|https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+" + _TLD + r")(?![\w@])", hint=r"www\.|://", check=check_domain),
    Rule("legal_entity", "COMPANY", PRIORITY_REGEX, r"(?U)(?<![\w&])(?:[A-Z][\w&.\-]*[ \t]+){1,5}(?:Private[ \t]+Limited|Pvt\.?[ \t]*Ltd\.?|Limited|Ltd\.?|LLP|Inc)(?!\w)", hint=r"Limited|Ltd|LLP|Inc", check=check_entity),
    Rule(
        "phone", "PHONE", PRIORITY_REGEX,
        r"(?U)(?<!\w)(?:(?:\+[ \t]*91[ \t\-]*)?(?:\d[ \t\-]*){8,12}\d|(?:\+?[ \t]*1[ \t\-.]*)?\(?\d{3}\)?[ \t\-.]+\d{3}[ \t\-.]+\d{4})(?:[ \t]*(?:x|ext\.?)[ \t]*\d{1,5})?(?!\w)",
        hint=r"(?U)\d[^\d]*\d[^\d]*\d[^\d]*\d[^\d]*\d[^\d]*\d[^\d]*\d", check=check_phone,
    ),
    Rule(
        "address", "ADDRESS", PRIORITY_REGEX,
        # the first number starts where no digit stands before it, or with its last five: other starts match from the same place on
        r"(?iU)(?:(?=\d)(?:\G|(?<!\d)|(?=\d{5}\s))\d{1,5}\s+[^\n]{3,80}?\b(?:" + _STREETS + r")\.?(?![A-Za-z])|\b(?:Plot|Flat|House|Shop|Unit|Gat|Survey|Khasra|Door)\b[ \t]*(?:No\.?)?[ \t]*\d{1,5})[^\n]{0,60}?\d{5,6}",
        hint=r"(?U)\d{5}", check=check_address,
    ),
    Rule("ssn", "SSN", PRIORITY_VALIDATED, r"(?U)(?<!\d)\d{3}[\s\-]\d{2}[\s\-]\d{4}(?!\d)", hint=r"(?U)\d{4}", check=check_ssn),
    Rule(
        "credit_card", "CREDIT_CARD", PRIORITY_VALIDATED, r"(?U)(?<!\d)(?:\d[ \-]*){12,18}\d(?!\d)", hint=r"(?U)(?:\d[ \-]*){13}", check=check_card,
        confidence=lambda span: F.when(validators.luhn_valid(span["text"]), 1.0).otherwise(0.75),
    ),
    Rule("ip_address", "IP_ADDRESS", PRIORITY_VALIDATED, r"(?U)(?<![\w.])(?:(?:\d{1,3}\.){3}\d{1,3}|(?:[A-Fa-f0-9]{0,4}:){2,7}[A-Fa-f0-9]{0,4})(?![\w:])", hint=r"(?U)\d\.\d|:[A-Fa-f0-9]{0,4}:", check=check_ip),
    Rule("dob", "DOB", PRIORITY_VALIDATED, r"(?U)(?<!\w)(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]+\s+\d{4}|[A-Za-z]+\s+\d{1,2},?\s+\d{4})(?!\w)", hint=r"(?i)dob|d\.o\.b|birth|born", check=check_dob),
]


class Registry:
    """Rules by type; a name may stand once in a type."""

    def __init__(self, rules: Sequence[Rule] = ()):
        self.rules: list[Rule] = []
        for rule in rules:
            self.register(rule)

    def register(self, rule: Rule) -> Rule:
        if any((r.pii_type, r.name) == (rule.pii_type, rule.name) for r in self.rules):
            raise ValueError(f"duplicate rule: {rule.pii_type}/{rule.name}")
        self.rules.append(rule)
        return rule

    def enabled(self, config: Config) -> list[Rule]:
        return sorted((r for r in self.rules if r.pii_type in config.enabled_types), key=lambda r: (-r.priority, r.name))


REGISTRY = Registry(RULES)


def rule_spans(text: Column, rule: Rule, config: Config, copy: Column | None = None) -> Column:
    """Entities of one rule; texts without the rule's hint skip its pattern.  copy is unmarked(text), where it is at hand."""
    found = spans(text, rule.pattern, rule.group, copy)
    if rule.check:
        found = F.filter(found, lambda s: F.coalesce(rule.check(text, s, config), F.lit(False)))
    out = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(f"regex:{rule.name}").alias("source"),
            F.lit(rule.pii_type).alias("pii_type"),
            s["text"].alias("text"),
            rule.confidence(s).cast("double").alias("confidence"),
            F.lit(rule.priority).alias("priority"),
        ),
    )
    none = F.array().cast(f"array<{ENTITY}>")
    return F.when(text.rlike(rule.hint), out).otherwise(none) if rule.hint else F.coalesce(out, none)


_built: dict[tuple, dict[str, Column]] = {}


def built(docs: DataFrame, rules: tuple[Rule, ...], config: Config) -> dict[str, Column]:
    """The rules' expressions over _text and _copy, made once a session and configuration."""
    key = (docs.sparkSession.sparkContext.applicationId, tuple((r.pii_type, r.name, r.pattern) for r in rules), config)
    if key not in _built:
        _built[key] = {f"_{r.name}": rule_spans(F.col("_text"), r, config, F.col("_copy")) for r in rules}
    return _built[key]


def detect(docs: DataFrame, config: Config | None = None, registry: Registry = REGISTRY, text: str = "text", out: str = "entities") -> DataFrame:
    """docs with all entities of all enabled rules, in order of place and source.

    The arrays stay on the document's row: there is no shuffle, and one pass over the texts.
    """
    config = config or Config()
    rules = registry.enabled(config)
    if not rules:
        return docs.withColumn(out, F.array().cast(f"array<{ENTITY}>"))
    # the text is bound once, so rules refer to a column and not to an expression
    docs = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_copy", unmarked(F.col("_text")))
    parts = built(docs, tuple(rules), config)
    return docs.select("*", *[c.alias(n) for n, c in parts.items()]).withColumn(out, F.array_sort(F.concat(*parts))).drop("_text", "_copy", *parts)


def explode_entities(docs: DataFrame, *keys: str, column: str = "entities") -> DataFrame:
    return docs.select(*keys, F.explode_outer(column).alias("e")).where("e is not null").select(*keys, "e.*")
