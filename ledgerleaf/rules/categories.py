"""Document categories: keywords, patterns, weight (in hundredths), filename hints."""

from __future__ import annotations

from dataclasses import dataclass

INVOICE = "Commercial Invoice"
CONTRACT = "Legal Contract"
AUDIT = "Compliance Audit"
IDENTITY = "Identity Verification"
CLAIM = "Medical Claim"
REPORT = "Business Report"


@dataclass(frozen=True)
class Category:
    name: str
    slug: str
    keywords: tuple[str, ...]
    patterns: tuple[str, ...]
    weight_pct: int


# Keyword and pattern lists, weights; the order decides ties.
CATEGORIES = (
    Category(
        INVOICE,
        "invoice",
        (
            "invoice", "bill to", "sold to", "remit to", "tax invoice", "subtotal", "gstin",
            "vat", "due date", "amount due", "payment terms", "line item", "po number",
            "unit price",
        ),
        (r"inv[-\s]?[0-9a-z]{3,}", r"total\s+amount", r"balance\s+due", r"qty\s+unit\s+price"),
        120,
    ),
    Category(
        CONTRACT,
        "contract",
        (
            "agreement", "master services agreement", "terms and conditions", "indemnification",
            "confidentiality", "governing law", "jurisdiction", "breach", "force majeure",
            "parties hereto", "severability", "arbitration",
        ),
        (
            r"this\s+agreement\s+is\s+entered", r"whereas", r"in\s+witness\s+whereof",
            r"section\s+\d+",
        ),
        110,
    ),
    Category(
        AUDIT,
        "audit",
        (
            "audit report", "safety inspection", "compliance assessment", "non-conformance",
            "corrective action", "inspector", "hazard", "osha", "iso 9001", "remediation",
            "inspection checklist", "passed", "failed",
        ),
        (
            r"audit\s+id", r"findings\s+and\s+observations", r"corrective\s+action\s+request",
            r"inspection\s+score",
        ),
        115,
    ),
    Category(
        IDENTITY,
        "identity",
        (
            "passport", "driver license", "national identity", "date of birth",
            "identification", "nationality", "issuing authority", "expiry date", "sex",
            "citizenship", "id number", "full legal name",
        ),
        (r"dob:\s*\d{2}", r"passport\s+no", r"national\s+id", r"issuing\s+country"),
        120,
    ),
    Category(
        CLAIM,
        "claim",
        (
            "patient name", "claim form", "diagnosis code", "icd-10", "provider", "healthcare",
            "treatment date", "insurance policy", "copay", "prescription", "hospital",
        ),
        (r"patient\s+id", r"policy\s+number", r"diagnostic\s+code", r"claim\s+amount"),
        110,
    ),
)

# Points per hit and their ceiling, per keyword and per pattern.
KEYWORD_POINTS, KEYWORD_CEILING = 8, 32
PATTERN_POINTS, PATTERN_CEILING = 15, 45

# Below this score the file name decides, in this order.
WEAK_SCORE = 10.0
FILENAME_HINTS = (
    (("invoice", "bill"), INVOICE),
    (("contract", "agreement", "nda"), CONTRACT),
    (("audit", "inspection"), AUDIT),
    (("id", "passport", "kyc"), IDENTITY),
)
HINT_CONFIDENCE = 0.85
NO_HINT_CONFIDENCE = 0.72

# confidence = base + s / (s + half) * span, kept within [floor, ceiling].
CONFIDENCE_BASE, CONFIDENCE_HALF, CONFIDENCE_SPAN = 0.75, 40.0, 0.24
CONFIDENCE_FLOOR, CONFIDENCE_CEILING = 0.82, 0.99
