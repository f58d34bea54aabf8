"""A plain Python model of detection and masking, written from the rules' meaning, for tests only."""

import re

from cloakwork.functions import rules


def labels_and_patterns(text):
    """(entity, start, end, score) in source order."""
    for r in rules.PATTERN_RULES:
        for m in re.finditer(r.regex, text):
            yield r.entity, m.start(), m.end(), r.score
    cut = re.compile(rules.NEXT_LABEL, re.I)
    for r in rules.keyword_rules():
        for m in re.finditer(r.regex, text, re.I):
            line = text[m.end() :].split("\n")[0]
            line = cut.split(line, maxsplit=1)[0]
            if r.entity == "PERSON":
                if n := re.match(rf"\s*({rules.PERSON_VALUE})", line):
                    yield r.entity, m.end() + n.start(1), m.end() + n.end(1), r.score
            elif len(line.strip()) > 1:
                yield r.entity, m.end(), m.end() + len(line.rstrip()), r.score


def clipped(spans, text):
    for e, a, b, s in spans:
        head = text[a:b].split("\n")[0]
        if len(head) == b - a or head.strip():
            yield e, a, a + len(head), s


def folded(spans):
    tier = lambda e: rules.TIER_OF.get(e, 1)
    out = []
    for x in sorted(spans, key=lambda x: (x[1], x[1] - x[2], -x[3])):
        if not out or x[1] >= out[-1][2]:
            out.append(x)
            continue
        y = out[-1]
        if (x[2] - x[1], tier(x[0]), x[3]) > (y[2] - y[1], tier(y[0]), y[3]):
            out[-1] = x
    return out


def detect(text):
    return folded(clipped(labels_and_patterns(text), text)) if text and text.strip() else []


EDGES = {
    "9000000001": [("BANK_ACCOUNT", 0, 10, 0.4)],
    "+91 9000000001": [("BANK_ACCOUNT", 4, 14, 0.4)],
    "phone: 9000000001": [("BANK_ACCOUNT", 7, 17, 0.4)],
    "111122223333": [("IN_AADHAAR", 0, 12, 0.85)],
    "1111 2222 3333 9000000001": [("CREDIT_CARD", 5, 25, 0.5)],
    "asha@upi": [],
    "asha@okhdfcbank": [("UPI_ID", 0, 15, 0.9)],
    "x@demopay": [("UPI_ID", 0, 9, 0.9)],
    "1.2.3.4": [("IP_ADDRESS", 0, 7, 0.6)],
    "10.20.30.40": [("IP_ADDRESS", 0, 11, 0.6)],
    "2024-01-31": [("DATE_OF_BIRTH", 0, 10, 0.5)],
    "A1234567": [("IN_PASSPORT", 0, 8, 0.7)],
    "123456789012345": [("CREDIT_CARD", 0, 15, 0.5)],
    "DOB:\nMobile: 12": [("DATE_OF_BIRTH", 5, 15, 0.85)],
    "items Foo Bar": [("PERSON", 6, 13, 0.85)],
    "Japan: Tokyo": [("IN_PAN", 7, 12, 0.85)],
    "Customer References": [("PERSON", 9, 19, 0.85)],
    "customer references": [],
    "Mr. Asha Rao": [("PERSON", 4, 12, 0.85)],
    "email: @x": [("EMAIL_ADDRESS", 7, 9, 0.85)],
    "name: \nAsha Rao": [("PERSON", 7, 15, 0.85)],
    "Name: Asha Rao DOB: 5 May 1990": [("PERSON", 6, 14, 0.85), ("DATE_OF_BIRTH", 20, 30, 0.85)],
    "é4111 1111 1111 1111": [("IN_AADHAAR", 6, 20, 0.85)],
    "😀 a@b.co": [("EMAIL_ADDRESS", 2, 8, 0.85)],
}
GOLDEN = "Name: Asha Rao\nDOB: 5 May 1990\nMobile: +91 9000000001\nEmail: asha@example.org\nAddress: 1 Lake Road, Pune\nPAN: ABCDE1234F\nAadhaar: 1111 2222 3333\nPassport: Z1234567\nBank: Demo Bank\nAccount: 70000000000001\nIFSC: DEMO0000001\nUPI: asha@upi\nIP: 10.1.2.3\nDevice ID: android-0123456789\nFingerprint: fp_hash_0123456789ab\n"
GOLDEN_MASKS = ["A*******", "** **** 19**", "91********01", "a***@example.org", "[REDACTED]", "A****1234F", "XXXX XXXX 3333", "Z*******", "[REDACTED]", "**********0001", "[REDACTED]", "a***@upi", "10.***.***.***", "[REDACTED]", "[REDACTED]"]
