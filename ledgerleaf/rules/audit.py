"""Issue catalogue. Conditions live in ``operators.validate``; the wording lives here."""

from __future__ import annotations

from dataclasses import dataclass

from ledgerleaf.rules.categories import AUDIT, CONTRACT, IDENTITY, INVOICE


@dataclass(frozen=True)
class Issue:
    code: str
    category: str | None
    severity: str
    penalty: int
    field: str
    title: str
    message: str


# Codes, severities, penalties and texts, in report order.
# {braces} are filled from the document's values.
FIELD_ISSUES = (
    Issue("LOW_CONFIDENCE", None, "warning", 10, "{key}",
          "Low AI Confidence on {label}",
          "AI model confidence for '{label}' is {percent}%. Requires human verification."),
    Issue("MISSING_FIELD", None, "error", 25, "{key}",
          "Missing Mandatory Field: {label}",
          "Required field '{label}' could not be located in the document."),
)

CATEGORY_ISSUES = (
    Issue("DATE_INCONSISTENCY", INVOICE, "error", 30, "due_date",
          "Date Inconsistency: Due Date Precedes Invoice Date",
          "Payment due date ({due_date}) occurs before the issue date ({invoice_date})."),
    Issue("INVOICE_OVERDUE", INVOICE, "warning", 15, "due_date",
          "Invoice Payment Overdue ({days_overdue} Days)",
          "The scheduled due date ({due_date}) has lapsed by {days_overdue} days."),
    Issue("MATH_MISMATCH", INVOICE, "error", 35, "grand_total",
          "Arithmetic Discrepancy in Invoice Totals",
          "Stated Grand Total (${total}) does not match Subtotal + Tax "
          "(${subtotal} + ${tax} = ${expected}). Delta: ${delta}."),
    Issue("LINE_ITEM_MISMATCH", INVOICE, "warning", 15, "subtotal",
          "Line Items Sum Mismatch",
          "Sum of extracted itemized rows (${line_sum}) deviates from reported subtotal "
          "(${subtotal})."),
    Issue("CONTRACT_EXPIRED", CONTRACT, "error", 35, "expiration_date",
          "Contract Expired",
          "The term for this legal agreement concluded on {expiration_date}. "
          "Active execution poses compliance risk."),
    Issue("HIGH_LEGAL_EXPOSURE", CONTRACT, "error", 30, "governing_law",
          "High Risk: Missing Governing Law & Jurisdiction",
          "Agreement does not specify state or federal legal jurisdiction. "
          "Creates substantial legal exposure."),
    Issue("UNCAPPED_LIABILITY", CONTRACT, "warning", 20, "liability_cap",
          "Critical Clause: Uncapped / Unlimited Indemnification",
          "Contract contains open-ended liability without standard limitation caps "
          "(e.g. 1x or 2x annual contract value)."),
    Issue("AUDIT_FAILURE", AUDIT, "error", 40, "status",
          "Audit Flagged: Immediate Corrective Action Required",
          "Facility failed compliance threshold with score {score}%. "
          "Critical environmental / safety non-conformances identified."),
    Issue("TIGHT_DEADLINE", AUDIT, "warning", 15, "corrective_deadline",
          "Urgent Remediation Window (Under 10 Days)",
          "Formal corrective response required before {corrective_deadline}. "
          "Failure to submit results in regulatory halt."),
    Issue("ID_EXPIRED", IDENTITY, "error", 50, "expiry_date",
          "Identification Document Expired",
          "Document expired on {expiry_date}. Cannot be used for KYC / employment authorization."),
    Issue("ID_EXPIRING_SOON", IDENTITY, "warning", 15, "expiry_date",
          "Document Expiring Within 30 Days",
          "Document will expire on {expiry_date}. Flag for secondary verification."),
)

# Thresholds.
LOW_CONFIDENCE = 0.85
MISSING_VALUES = ("", "N/A", "Unknown", "None")
TOTAL_TOLERANCE = 0.05
LINE_SUM_TOLERANCE = 1.0
DEADLINE_DAYS = 10
EXPIRY_DAYS = 30
FULL_SCORE = 100
UNKNOWN_LAW = ("not specified", "n/a")
OPEN_LIABILITY = ("uncapped", "unlimited")
FAILED_AUDIT = ("action required", "failed")

# Fixed value: the date the reference results are stated for.
REFERENCE_AS_OF = "2026-09-25"
