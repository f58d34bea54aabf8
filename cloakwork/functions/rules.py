"""The rule catalogue as data.  A rule is compiled to Columns by `spans`; users add their own to the lists."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """One pattern.  `needs`: texts of which one must be in a text before the pattern can match, a regex each; empty: none known."""

    name: str
    entity: str
    regex: str
    score: float
    needs: tuple[str, ...] = field(default=())


# Names, types, patterns and scores that results depend on.
PATTERN_RULES = [
    Rule("in_phone", "IN_PHONE", r"\b(?:\+91|91|0)?[6-9]\d{9}\b", 0.85, (r"\d",)),
    Rule("in_aadhaar", "IN_AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b", 0.85, (r"\d",)),
    Rule("in_pan", "IN_PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.9, (r"\d",)),
    Rule("ipv4", "IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.6, (r"\d",)),
    Rule("in_passport", "IN_PASSPORT", r"\b[A-Z][0-9]{7}\b", 0.7, (r"\d",)),
    Rule("ifsc", "IFSC_CODE", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.9, (r"\d",)),
    Rule("bank_acct", "BANK_ACCOUNT", r"\b\d{9,18}\b", 0.4, (r"\d",)),
    Rule("upi", "UPI_ID", r"\b[\w.\-]+@[a-z]{2,}(?:bank|pay|upi|paytm|gpay|ybl|okhdfcbank|okaxis|oksbi|apl|ibl)\b", 0.9, ("@",)),
    Rule("credit_card", "CREDIT_CARD", r"\b(?:\d[ -]*?){13,19}\b", 0.5, (r"\d",)),
    Rule("android_id", "DEVICE_ID", r"\bandroid-[a-f0-9]{10,16}\b", 0.9, ("android-",)),
    Rule("ios_id", "DEVICE_ID", r"\b[A-F0-9]{8}-[A-F0-9]{4}-[A-F0-9]{4}-[A-F0-9]{4}-[A-F0-9]{12}\b", 0.7, ("-",)),
    Rule("imei", "DEVICE_ID", r"\b\d{15}\b", 0.3, (r"\d",)),
    Rule("fp_hash", "HASH_VALUE", r"\bfp_hash_[a-f0-9]{10,}\b", 0.95, ("fp_hash_",)),
    Rule("face_tmp", "HASH_VALUE", r"\bface_tmp_[a-f0-9]{8,}\b", 0.95, ("face_tmp_",)),
    Rule("sha256", "HASH_VALUE", r"\b[a-f0-9]{64}\b", 0.6, ("[a-f0-9]{32}",)),
    Rule("md5", "HASH_VALUE", r"\b[a-f0-9]{32}\b", 0.5, ("[a-f0-9]{32}",)),
    Rule("dob_dmy", "DATE_OF_BIRTH", r"\b\d{1,2}[\s/\-.](?:January|February|March|April|May|June|July|August|September|October|November|December|\d{1,2})[\s/\-.]\d{2,4}\b", 0.6, (r"\d",)),
    Rule("dob_iso", "DATE_OF_BIRTH", r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", 0.5, (r"\d",)),
    Rule("email", "EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.85, ("@",)),
]

# Labels before a value, by type; they match in any case, and what follows is the value.
KEYWORD_LABELS = {
    "PERSON": [
        r"(?:full\s*)?name\s*[:=]\s*",
        r"applicant\s*[:=]?\s*",
        r"customer\s*[:=]?\s*",
        r"employee\s*[:=]?\s*",
        r"patient\s*[:=]?\s*",
        r"father'?s?\s*name\s*[:=]\s*",
        r"mother'?s?\s*name\s*[:=]\s*",
        r"spouse\s*[:=]?\s*",
        r"(?:mr|mrs|ms|dr|prof)\.?\s+",
        r"user\s*[:=]?\s*",
        r"account\s*holder\s*[:=]?\s*",
    ],
    "DATE_OF_BIRTH": [r"(?:date\s*of\s*birth|dob|d\.o\.b|birth\s*date)\s*[:=]\s*"],
    "IN_PASSPORT": [r"passport\s*(?:no|number|#)?\s*[:=]\s*"],
    "BANK_NAME": [r"bank\s*(?:name)?\s*[:=]\s*"],
    "BANK_ACCOUNT": [r"(?:account|acct|a/c)\s*(?:no|number|#)?\s*[:=]\s*"],
    "IFSC_CODE": [r"ifsc\s*(?:code)?\s*[:=]\s*"],
    "UPI_ID": [r"upi\s*(?:id)?\s*[:=]\s*"],
    "DEVICE_ID": [r"device\s*(?:id)?\s*[:=]\s*", r"imei\s*[:=]\s*"],
    "HASH_VALUE": [
        r"fingerprint\s*(?:hash)?\s*[:=]\s*",
        r"face\s*template\s*[:=]\s*",
        r"biometric\s*(?:id|hash|template)?\s*[:=]\s*",
        r"hash\s*[:=]\s*",
    ],
    "CREDIT_CARD": [r"(?:credit|debit)\s*card\s*(?:no|number|#)?\s*[:=]\s*"],
    "LOCATION": [r"address\s*[:=]\s*", r"city\s*[:=]\s*", r"state\s*[:=]\s*", r"pin\s*code\s*[:=]\s*"],
    "IN_PHONE": [r"(?:mobile|phone|cell|contact)\s*(?:no|number|#)?\s*[:=]\s*"],
    "EMAIL_ADDRESS": [r"e-?mail\s*(?:id|address)?\s*[:=]\s*"],
    "IN_AADHAAR": [r"aadhaar\s*(?:no|number|#|card)?\s*[:=]\s*"],
    "IN_PAN": [r"pan\s*(?:no|number|#|card)?\s*[:=]\s*"],
}
KEYWORD_SCORE = 0.85

# Fixed value: a label that ends the value before it on the same line.
NEXT_LABEL = (
    r"\s+(?:(?:full\s*)?name|dob|d\.o\.b|date\s*of\s*birth|birth\s*date|mobile|phone|cell|contact|e-?mail|address|city|state|pin\s*code"
    r"|pan|aadhaar|passport|bank|account|acct|a/c|ifsc|upi|ip\b|device|imei|fingerprint|face\s*template|biometric|hash|credit|debit)"
    r"\s*(?:no|number|#|name|id|code|card|address)?\s*[:=]"
)
# Fixed value: a label that ends a person's span.
TRAILING_LABEL = r"\s+(?:DOB|D\.O\.B|Mobile|Phone|Cell|Contact|Email|Address|PAN|Aadhaar|Passport|Bank|Account|IFSC|UPI|IP)\s*[:=]?$"
# Fixed value: one to four capitalised words.
PERSON_VALUE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}"

# How specific a type is; a type that is not listed has tier 1.
TIERS = {
    3: ["IN_AADHAAR", "IN_PAN", "IN_PASSPORT", "IFSC_CODE", "BANK_ACCOUNT", "CREDIT_CARD", "DEVICE_ID", "HASH_VALUE", "UPI_ID", "DATE_OF_BIRTH", "IP_ADDRESS"],
    2: ["IN_PHONE", "PHONE_NUMBER", "EMAIL_ADDRESS", "PERSON", "LOCATION", "BANK_NAME"],
    0: ["ID_NUM", "URL", "USERNAME", "NAME"],
}
TIER_OF = {entity: tier for tier, entities in TIERS.items() for entity in entities}

# Types that a detection asks for.
ENTITIES = ["PERSON", "EMAIL_ADDRESS", "IP_ADDRESS", "LOCATION", "IN_PHONE", "IN_AADHAAR", "IN_PAN", "PHONE_NUMBER", "IN_PASSPORT", "IFSC_CODE", "BANK_ACCOUNT", "UPI_ID", "CREDIT_CARD", "DEVICE_ID", "HASH_VALUE", "DATE_OF_BIRTH"]

#: What one of these needs stands in a text, folded to lower case, whenever the label matches.
_LABEL_STEMS = {
    "applicant": ("applicant",), "customer": ("customer",), "employee": ("employee",), "patient": ("patient",), "spouse": ("spouse",), "user": ("user",),
    "account\\s*holder": ("holder",), "(?:mr": ("mr", "ms", "dr", "prof"), "(?:full": ("name",), "father": ("father",), "mother": ("mother",),
    "(?:date": ("birth", "dob", "d.o.b"), "passport": ("passport",), "bank": ("bank",), "(?:account": ("account", "acct", "a/c"), "ifsc": ("ifsc",), "upi": ("upi",),
    "device": ("device",), "imei": ("imei",), "fingerprint": ("fingerprint",), "face": ("template",), "biometric": ("biometric",), "hash": ("hash",), "(?:credit": ("card",),
    "address": ("address",), "city": ("city",), "state": ("state",), "pin": ("code",), "(?:mobile": ("mobile", "phone", "cell", "contact"), "e-?mail": ("mail",), "aadhaar": ("aadhaar",), "pan": ("pan",),
}


def label_stems(regex: str) -> tuple[str, ...]:
    """Lower-case texts of which one is in every match of a label; empty if the label is not one of the catalogue's."""
    found = [v for k, v in _LABEL_STEMS.items() if regex.startswith(k)]
    return found[0] if found else ()


def keyword_rules(labels: dict[str, list[str]] = KEYWORD_LABELS) -> list[Rule]:
    """The labels as rules, in order."""
    return [Rule(f"kw_{entity.lower()}_{k}", entity, regex, KEYWORD_SCORE, label_stems(regex)) for entity, regexes in labels.items() for k, regex in enumerate(regexes)]
