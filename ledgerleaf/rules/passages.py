"""Entity patterns and section headings."""

from __future__ import annotations

from dataclasses import dataclass

from ledgerleaf.rules.fields import GROUPED, MONTHS


@dataclass(frozen=True)
class Entity:
    type: str
    pattern: str
    ignore_case: bool = True
    whole_words: bool = False


# Entity patterns, in report order, and the number reported per document.
ENTITIES = (
    Entity("MONETARY_AMOUNT", rf"(?:[\$€£₹]|USD|EUR|INR|GBP)\s*({GROUPED})"),
    Entity(
        "DATE",
        r"\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
        rf"|(?:{MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{4}})\b",
        whole_words=True,
    ),
    Entity(
        "IDENTIFIER",
        r"\b(?:INV|PO|CONTRACT|AUDIT|PASSPORT|ID|REF)[-_#]?\s*([A-Z0-9]{4,15})\b",
        whole_words=True,
    ),
    Entity("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ignore_case=False),
)
MAX_ENTITIES = 25

# A line shorter than the limit that matches either pattern opens a section.
HEADINGS = (
    r"^(?:[0-9]+\.|\bSECTION\b|\bARTICLE\b|\bPART\b)?\s*([A-Z\s]{4,40}):?$",
    r"^(Bill To|Ship To|Payment Details|Terms & Conditions|Summary of Charges|Scope of Work"
    r"|Indemnification|Governing Law|Audit Findings|Inspection Checklist|Line Items"
    r"|Parties Involved)$",
)
HEADING_LENGTH = 50
FIRST_SECTION = "Document Overview"
MAX_SECTIONS, MAX_SECTION_LINES = 10, 8
