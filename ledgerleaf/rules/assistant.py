"""Question intents and answer texts."""

from __future__ import annotations

# Trigger substrings per intent; the first intent that has something to say answers.
TRIGGERS = {
    "money": ("total", "amount", "cost", "price", "subtotal", "tax", "fee", "how much", "pay"),
    "dates": ("deadline", "due", "date", "expir", "when", "valid until"),
    "risk": ("risk", "issue", "error", "warning", "anomal", "problem", "discrepanc", "fail"),
    "summary": ("summar", "overview", "what is", "explain", "about", "tell me"),
    "parties": ("who", "vendor", "party", "parties", "client", "person", "name", "inspector",
                "customer"),
}

# Field keys per intent, in answer order.
DATE_KEY_PARTS = ("date", "deadline", "expir")
PARTY_KEYS = ("vendor_name", "customer_name", "party_one", "party_two", "inspector_name",
              "facility_name", "full_name")
ARITHMETIC_CODES = ("math", "line_item")

# Text search.
STOP_WORDS = ("what", "where", "which", "could", "would", "should", "there", "about", "this",
              "that")
MIN_WORD, MIN_LINE, MAX_SNIPPETS = 3, 10, 4
SUMMARY_FIELDS, SUMMARY_INSIGHTS = 5, 2

# Answer texts.
MONEY_INVOICE = (
    "### Financial Summary\n"
    "* **Grand Total Due**: **${grand_total}**\n"
    "* **Subtotal**: ${subtotal}\n"
    "* **Tax / VAT**: ${tax_amount}\n"
    "* **Payment Terms**: {payment_terms}{alert}"
)
MONEY_ALERT = "\n\n> ⚠️ **Audit Alert**: {message}"
MONEY_CONTRACT = (
    "In this legal agreement, the financial exposure clause states:\n"
    "* **Liability Cap**: **{liability_cap}**\n"
    "* Note: Standard monetary fees are governed under individual Statements of Work (SOWs)."
)
DATES = "### Key Dates & Deadlines Identified\n{lines}"
DATE_LINE = "* **{label}**: `{value}` (Confidence: {percent}%)"
NO_RISK = (
    "✅ **No critical risks or validation errors detected**.\n\n"
    "The document conforms to standard enterprise schema with an overall validation health "
    "score of **{score}/100**."
)
RISKS = "### Detected Compliance & Risk Findings ({count} item{plural})\n\n{lines}"
RISK_LINE = "{icon} **{title}**\n   {message}"
ERROR_ICON, OTHER_ICON = "🔴", "🟡"
SUMMARY = (
    "This document has been identified as a **{category}** (confidence: {percent}%).\n\n"
    "#### Core Metadata:\n{fields}\n#### Executive Insights:\n{insights}"
)
SUMMARY_FIELD = "* **{label}**: {value}\n"
SUMMARY_INSIGHT = "* **{badge}**: {title} — *{description}*\n"
PARTIES = "### Identified Entities & Parties\n{lines}"
PARTY_LINE = "* **{label}**: `{value}`"
SNIPPETS = (
    "Here is the relevant information extracted directly from the document matching your "
    "query:\n\n{lines}\n\nWould you like me to analyze any specific aspect of this or extract "
    "additional fields?"
)
SNIPPET_LINE = '> *"{line}"*'
OVERVIEW = (
    "Based on the analysis of **{name}**:\n\n"
    "This document is classified under **{category}**. "
    "It contains **{count} extracted fields** with an overall validation health score of "
    "**{score}%**.\n\n"
    "Try asking:\n"
    "* *'What is the total amount and tax?'*\n"
    "* *'What are the critical risks or errors detected?'*\n"
    "* *'What are the key deadlines?'*\n"
    "* *'Summarize the contract clauses'*"
)

# Citations (section, page, field).
CITE_TOTAL = ("Summary of Charges", "Page 1", "Grand Total")
CITE_CAP = ("Limitation of Liability", "Page 2", "Liability Cap")
CITE_HEALTH = ("Validation Engine", "All Pages", "Health Score")
CITE_SUMMARY = ("Document Overview", "Page 1", "Classification")
CITE_SEARCH = ("Document Body Content", "Page 1", "Text Search")
CITE_OVERVIEW = ("Document Overview", "Page 1", "General")
