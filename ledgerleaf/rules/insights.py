"""Insight catalogue. Conditions live in ``operators.insights``; the wording lives here."""

from __future__ import annotations

from dataclasses import dataclass

from ledgerleaf.rules.categories import AUDIT, CONTRACT, IDENTITY, INVOICE


@dataclass(frozen=True)
class Insight:
    category: str | None
    when: str
    type: str
    badge: str
    icon: str
    title: str
    description: str
    action: str


# Insight texts, in report order. {braces} are filled from the document's fields;
# ``when`` names the condition, and category None stands for every other category.
INSIGHTS = (
    Insight(INVOICE, "valid", "opportunity", "Early Payment Discount", "sparkles",
            "2% Dynamic Discount Available with {vendor_name}",
            "Executing payment before {due_date} qualifies for standard early settlement terms, "
            "saving estimated ${saving} on this transaction.",
            "Schedule Automated Net-10 Remittance"),
    Insight(INVOICE, "not_valid", "action_required", "Discrepancy Audit", "alert-triangle",
            "Invoice Reconciliation Hold Recommended",
            "Significant mathematical or date mismatch detected in invoice {invoice_number}. "
            "Do not release funds until vendor sends credit note.",
            "Trigger Vendor Clarification Notice"),
    Insight(INVOICE, "always", "compliance", "Vendor Intelligence", "shield-check",
            "Tax & Identity Verification Profile: {vendor_name}",
            "Tax ID '{tax_id}' validated against national registry. "
            "Vendor holds Preferred Supplier Tier-1 standing.",
            "View Historical Spend Graph"),
    Insight(INVOICE, "always", "budget", "Budget Allocation", "trending-up",
            "Cloud Infrastructure Operating Expenditure",
            "Transaction total of ${grand_total} aligns within Q3 IT Modernization operating "
            "budget allocation (91.4% capacity utilized).",
            "Assign to Cost Center #4812"),
    Insight(CONTRACT, "always", "risk", "Legal Exposure Alert", "alert-octagon",
            "Asymmetric Indemnification Risk Detected",
            "The clause between {party_one} and {party_two} exposes both entities to open-ended "
            "damages without explicit limitation caps or mutual waivers.",
            "Request Standard 12-Month Fee Limitation Rider"),
    Insight(CONTRACT, "law_not_specified", "action_required", "Mandatory Remediation", "scale",
            "Unspecified Jurisdiction Clause",
            "Cross-border contract lacks choice of law jurisdiction. In litigation, "
            "forum non conveniens challenges could cost >$50,000.",
            "Insert State/Country Jurisdiction Addendum"),
    Insight(CONTRACT, "always", "governance", "Lifecycle Governance", "calendar",
            "Automated 60-Day Renewal Window Notice",
            "Auto-renewal locks 60 days before expiration ({expiration_date}). "
            "Calendar alerts placed for legal review.",
            "Set Legal Reminder in Outlook/Calendar"),
    Insight(AUDIT, "always", "action_required", "Regulatory Action Required", "alert-circle",
            "Facility Remediation Plan Needed for {facility_name}",
            "Overall score of {compliance_score} is below ISO/OSHA threshold of 85.0%. "
            "HVAC calibration and emergency shutoff tags must be rectified.",
            "Dispatch Operations Engineering Team"),
    Insight(AUDIT, "always", "compliance", "Audit Protocol", "clipboard-check",
            "Re-Inspection Escalation Schedule",
            "Formal corrective measures must be logged prior to deadline ({corrective_deadline}) "
            "to avert automated regulatory reporting.",
            "Generate Pre-filled Re-inspection Form"),
    Insight(IDENTITY, "always", "compliance", "KYC Verification", "user-check",
            "Identity Check Status for {full_name}",
            "Document ID '{document_id}' format verified against ICAO 9303 standards. "
            "Biometric integrity checksum match confirmed.",
            "Export Encrypted KYC Audit Certificate"),
    Insight(IDENTITY, "flagged", "risk", "Expiration Warning", "clock",
            "Identity Expiration Imminent or Lapsed",
            "Document cannot be used for ongoing financial transaction signing or formal "
            "compliance audits after current expiration date.",
            "Prompt Customer for Updated ID"),
    Insight(None, "always", "summary", "Executive Summary", "file-text",
            "Synthesized Intelligence Overview",
            "Document parsed with structured layout extraction. Key business metrics indexed for "
            "rapid query and audit retrieval.",
            "View Complete Metadata Record"),
)

# What a text shows when the field is absent altogether.
ABSENT = {
    "vendor_name": "Vendor", "grand_total": "0.00", "due_date": "", "invoice_number": "",
    "tax_id": "N/A", "party_one": "Party 1", "party_two": "Party 2", "governing_law": "",
    "expiration_date": "N/A", "facility_name": "Facility", "compliance_score": "N/A",
    "corrective_deadline": "N/A", "full_name": "Individual", "document_id": "",
}
STATED_SAVING = "273.90"
SAVING_RATE = 0.02
