"""Word lists and constants that define behaviour.

Everything in this module is a fixed value: it must be as it is for right results.
"""

PII_TYPES = ["FULL_NAME", "EMAIL", "PHONE", "COMPANY", "ADDRESS", "SSN", "CREDIT_CARD", "DOB", "IP_ADDRESS", "DOMAIN"]

PRIORITY_VALIDATED = 30
PRIORITY_REGEX = 20
PRIORITY_NER = 10

NEGATIVE_CONTEXT = [
    "ticket", "order", "invoice", "receipt", "reference", "ref", "txn", "transaction", "po", "sku", "isin", "cin", "gstin",
    "folio", "application", "allotment", "dp id", "client id", "section", "version", "ver", "page", "regulation", "chapter",
    "clause", "annexure", "schedule", "serial", "sr", "no", "number", "nos",
]

BIRTH_CUES = ["dob", "d.o.b", "d.o.b.", "date of birth", "birth date", "born", "birthday", "birthdate"]

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

GENERIC_ENTITY_WORDS = [
    "the", "and", "of", "our", "a", "an", "company", "companies", "private", "public", "limited", "ltd", "group", "holding",
    "holdings", "its",
]

NAME_STOP_TOKENS = [
    "website", "telephone", "tel", "email", "e-mail", "fax", "address", "sebi", "registration", "number", "investor",
    "grievance", "contact", "person", "compliance", "officer", "company", "secretary", "limited", "private", "ltd", "llp",
    "pvt", "corporate", "registered", "office", "designation", "din", "membership", "firm", "regd",
]

SPACED_TLDS = ["com", "net", "org", "in", "co", "uk", "io", "gov", "edu", "info", "biz"]

LABEL_MAP = {"PERSON": "FULL_NAME", "PER": "FULL_NAME", "ORG": "COMPANY", "GPE": "ADDRESS", "LOC": "ADDRESS", "FAC": "ADDRESS", "DATE": "DOB"}

ORG_STOPWORDS = [
    "prospectus", "red herring", "red herring prospectus", "annexure", "schedule", "the company", "company",
    "board of directors", "securities", "equity shares", "bse", "nse", "sebi", "registrar", "lead manager",
    "book running lead manager", "draft red herring prospectus", "drhp", "rhp", "offer", "the offer", "allotment", "bidder",
    "anchor investor", "promoter", "selling shareholder", "book building", "book building process", "roc", "face value",
    "mandate", "risk management committee", "non-resident", "non resident", "fresh issue", "offer for sale",
    "objects of the offer", "asba", "asba form", "scsb", "syndicate", "syndicate member", "registered broker",
    "designated intermediary", "escrow collection bank", "refund bank", "public offer account", "upi", "upi mandate request",
]

FIELD_LABELS = [
    "email", "e-mail", "e mail", "telephone", "website", "address", "contact person", "contact", "fax", "tel", "phone",
    "mobile", "registered office", "corporate office", "cin", "din", "pan",
]

PERSON_CUES = [
    "managing director", "independent director", "non-executive director", "company secretary", "compliance officer",
    "authorised signatory", "authorized signatory", "contact person", "director", "signatory", "signature", "signed by",
    "chairman", "mr.", "mrs.", "ms.", "dr.", "shri", "smt.", "s/o", "d/o", "w/o",
]

DETERMINERS = ["the", "our", "such", "each", "any", "this"]

#: No-break, figure, narrow no-break, thin, hair, en and em space.
EXOTIC_SPACES = "       "

SECOND_LEVEL_SUFFIXES = ["co", "com", "net", "org", "gov", "edu", "ac", "in", "res"]

HONORIFICS = ["mr.", "mrs.", "ms.", "miss", "dr.", "prof.", "sri", "shri", "smt."]

#: In order: the first that ends the name counts.
COMPANY_SUFFIXES = [
    "pvt. ltd.", "pvt ltd", "private limited", "ltd.", "ltd", "limited", "llc", "llp", "inc.", "inc", "corp.", "corp", "co.",
    "company",
]

MIN_LEAK_LENGTH = 5
