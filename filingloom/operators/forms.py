"""Catalogues of annual, quarterly and current report forms, and the names their sections go by."""

from __future__ import annotations

#: Item titles of the SEC's forms, by part.
TEN_K = {
    "I": {"1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "1C": "Cybersecurity", "2": "Properties", "3": "Legal Proceedings", "4": "Mine Safety Disclosures"},
    "II": {
        "5": "Market for Registrant's Common Equity", "6": "Selected Financial Data", "7": "Management's Discussion and Analysis (MD&A)", "7A": "Quantitative and Qualitative Disclosures About Market Risk",
        "8": "Financial Statements", "9": "Controls and Procedures", "9A": "Controls and Procedures", "9B": "Other Information", "9C": "Disclosure Regarding Foreign Jurisdictions That Prevent Inspections",
    },
    "III": {
        "10": "Directors, Executive Officers, and Corporate Governance", "11": "Executive Compensation", "12": "Security Ownership of Certain Beneficial Owners and Management",
        "13": "Certain Relationships and Related Transactions, and Director Independence", "14": "Principal Accounting Fees and Services",
    },
    "IV": {"15": "Exhibits, Financial Statement Schedules", "16": "Form 10-K Summary"},
}
TWENTY_F = {
    "I": {"1": "Identity of Directors, Senior Management, and Advisers", "2": "Offer Statistics and Expected Timetable", "3": "Key Information", "4": "Information on the Company", "4A": "Unresolved Staff Comments"},
    "II": {
        "5": "Operating and Financial Review and Prospects", "6": "Directors, Senior Management, and Employees", "7": "Major Shareholders and Related Party Transactions", "8": "Financial Information", "9": "The Offer and Listing",
    },
    "III": {"10": "Additional Information", "11": "Quantitative and Qualitative Disclosures About Market Risk", "12": "Description of Securities Other Than Equity Securities"},
    "IV": {
        "13": "Defaults, Dividend Arrearages, and Delinquencies", "14": "Material Modifications to the Rights of Security Holders and Use of Proceeds", "15": "Controls and Procedures", "16": "Reserved",
        "16A": "Audit Committee Financial Expert", "16B": "Code of Ethics", "16C": "Principal Accountant Fees and Services", "16D": "Exemptions from the Listing Standards for Audit Committees",
        "16E": "Purchases of Equity Securities by the Issuer", "16F": "Change in Registrant's Certifying Accountant", "16G": "Corporate Governance", "16H": "Mine Safety Disclosure",
        "16I": "Disclosure Regarding Foreign Jurisdictions That Prevent Inspections", "16J": "Insider Trading Policies", "16K": "Cybersecurity",
    },
    "V": {"17": "Financial Statements", "18": "Financial Statements", "19": "Exhibits"},
}
TEN_Q = {
    "I": {"1": "Financial Statements", "2": "Management's Discussion and Analysis", "3": "Quantitative and Qualitative Disclosures About Market Risk", "4": "Controls and Procedures"},
    "II": {"1": "Legal Proceedings", "1A": "Risk Factors", "2": "Unregistered Sales of Equity Securities", "3": "Defaults Upon Senior Securities", "4": "Mine Safety Disclosures", "5": "Other Information", "6": "Exhibits"},
}
EIGHT_K = {
    "": {
        "1.01": "Entry into a Material Definitive Agreement", "1.02": "Termination of a Material Definitive Agreement", "1.03": "Bankruptcy or Receivership", "1.04": "Mine Safety", "1.05": "Material Cybersecurity Incidents",
        "2.01": "Completion of Acquisition", "2.02": "Results of Operations", "2.03": "Creation of a Direct Financial Obligation", "2.04": "Triggering Events", "2.05": "Costs Associated with Exit or Disposal", "2.06": "Material Impairments",
        "3.01": "Notice of Delisting", "3.02": "Unregistered Sales of Equity Securities", "3.03": "Material Modification to Rights", "4.01": "Changes in Registrant's Certifying Accountant", "4.02": "Non-Reliance on Financial Statements",
        "5.01": "Changes in Control", "5.02": "Departure of Directors or Officers", "5.03": "Amendments to Articles or Bylaws", "5.04": "Temporary Suspension of Trading", "5.05": "Amendment to Code of Ethics", "5.06": "Change in Shell Company Status",
        "5.07": "Submission of Matters to a Vote", "5.08": "Shareholder Nominations", "6.01": "ABS Informational Material", "6.02": "Change of Servicer or Trustee", "6.03": "Change in Credit Enhancement", "6.04": "Failure to Make a Distribution",
        "6.05": "Securities Act Updating", "6.06": "Static Pool", "7.01": "Regulation FD Disclosure", "8.01": "Other Events", "9.01": "Financial Statements and Exhibits",
    }
}
#: Headings of prospectuses, which have no items.
PROSPECTUS = (
    "About This Prospectus", "Prospectus Summary", "The Offering", "Summary", "Risk Factors", "Use of Proceeds", "Dilution", "Capitalization", "Description of Capital Stock", "Description of Securities", "Description of Notes",
    "Description of Debt Securities", "Description of Warrants", "Selling Stockholders", "Underwriting", "Plan of Distribution", "Legal Matters", "Experts", "Tax Considerations", "Where You Can Find More Information", "Incorporation by Reference",
)
FORMS = {"10-K": TEN_K, "10-Q": TEN_Q, "20-F": TWENTY_F, "8-K": EIGHT_K}
#: Names that 10-K sections are asked for by.
ALIASES = {
    "business": "1", "risk_factors": "1A", "unresolved_staff_comments": "1B", "cybersecurity": "1C", "properties": "2", "legal_proceedings": "3", "mine_safety": "4", "market_equity": "5",
    "selected_financial_data": "6", "mda": "7", "management_discussion": "7", "market_risk": "7A", "financial_statements": "8", "controls_procedures": "9", "controls_procedures_9a": "9A", "other_information": "9B",
    "foreign_jurisdictions": "9C", "directors_officers": "10", "directors_officers_and_governance": "10", "executive_compensation": "11", "security_ownership": "12", "relationships_transactions": "13",
    "accounting_fees": "14", "exhibits": "15", "summary": "16",
}
#: Headings of a Canadian annual information form, as patterns in order of the rule that asks for them.
ANNUAL_INFORMATION = (
    r"CORPORATE\s+STRUCTURE", r"GENERAL\s+DEVELOPMENT\s+OF\s+(?:THE\s+)?(?:[\w\-]+\s+)?BUSINESS", r"(?:NARRATIVE\s+)?DESCRIPTION\s+OF\s+(?:THE\s+)?(?:\w+\s+)?BUSINESS(?:ES)?", r"BUSINESS\s+OPERATIONS",
    r"DESCRIPTION\s+OF\s+CAPITAL\s+STRUCTURE", r"MARKET\s+FOR\s+SECURITIES", r"DIVIDENDS(?:\s+AND\s+DISTRIBUTIONS)?", r"DIRECTORS\s+AND\s+(?:EXECUTIVE\s+OFFICERS|OFFICERS|EXECUTIVE)", r"RISK\s+FACTORS",
    r"LEGAL\s+(?:PROCEEDINGS|MATTERS)", r"MATERIAL\s+PROPERTIES", r"CODE\s+OF\s+BUSINESS\s+CONDUCT", r"BUSINESS\s+OVERVIEW",
)


def item_title(form: str, item: str, part: str | None = None) -> str | None:
    """Title of an item ("7A", "Item 7A") in a form."""
    number = item.upper().removeprefix("ITEM").strip()
    for p, items in FORMS.get(form, {}).items():
        if (part is None or part.upper().removeprefix("PART").strip() == p) and number in items:
            return items[number]
    return None


def item_number(key: str) -> str | None:
    """The item that a key means: "Item 7", "7", "mda"."""
    text = key.strip()
    if text.lower() in ALIASES:
        return ALIASES[text.lower()]
    bare = text[5:].strip() if text.lower().startswith("item ") else text
    return bare.upper() if bare[:1].isdigit() else None
