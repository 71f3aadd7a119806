"""Fixed values of the domain: word lists, label tables, patterns and bands.

Everything here is data. The functions and operators take these tables as
parameters, so another market can pass its own.
"""

from __future__ import annotations

# --- fixed values: stop words of company names -----------------------------
NAME_STOP = ("limited", "ltd", "private", "pvt", "the", "and", "of", "india")
TITLE_STOP = (
    "limited", "ltd", "private", "pvt", "rhp", "the", "and", "of", "red",
    "herring", "prospectus", "dated", "co", "company",
)
QUESTION_STOP = (
    "the", "and", "what", "which", "does", "how", "are", "was", "were", "this",
    "that", "company",
)

# --- fixed values: money units to crore -------------------------------------
UNIT_FACTORS = {
    "lakhs": 0.01, "lacs": 0.01, "lakh": 0.01, "lac": 0.01,
    "crores": 1.0, "crore": 1.0, "cr": 1.0,
    "millions": 0.1, "million": 0.1, "mn": 0.1,
    "billions": 100.0, "billion": 100.0,
}
UNIT_WORDS = r"lakhs?|lacs|crores?|cr|millions?|mn|billions?"
RUPEE = r"(?:₹|Rs\.?|INR)"
AMOUNT = rf"{RUPEE}?\s*([\d,]+(?:\.\d+)?)\s*({UNIT_WORDS})?"
STRICT_AMOUNT = rf"{RUPEE}\s*([\d,]+(?:\.\d+)?)\s*({UNIT_WORDS})?"

# --- fixed values: fiscal column headers --------------------------------------
FISCAL_HEADER = (
    r"(?:march\s+31(?:st)?,?\s*|31(?:st)?\s+(?:of\s+)?march,?\s*|fiscal\s+"
    r"|financial\s+year\s+|fy\s*)((?:20)?\d{2})"
)
STUB_HEADER = (
    r"(?:december\s+31|september\s+30|june\s+30|31(?:st)?\s+(?:of\s+)?december"
    r"|30(?:th)?\s+(?:of\s+)?(?:september|june))(?:st|nd|rd|th)?\s*,?\s*((?:20)?\d{2})"
)

# --- fixed values: statement row labels, first match wins ----------------------
ROW_LABELS = [
    ("revenue", r"revenue\s+from\s+operations?"),
    ("other_income", r"^other\s+income"),
    ("total_income", r"^total\s+income"),
    ("cost_of_materials", r"cost\s+of\s+(?:materials|goods)"),
    ("employee_costs", r"employee\s+benefits?\s+expenses?"),
    ("finance_costs", r"^finance\s+costs?"),
    ("depreciation", r"depreciation\s+and\s+amorti[sz]ation"),
    ("total_expenses", r"^total\s+expenses"),
    ("pbt", r"(?:restated\s+)?profit\s*/?\(?(?:loss)?\)?\s+before\s+tax"),
    ("tax_expense", r"^(?:total\s+)?tax\s+expenses?"),
    ("pat", r"(?:restated\s+)?(?:net\s+)?profit\s*/?\(?(?:loss)?\)?\s+(?:after\s+tax|for\s+the\s+(?:year|period))"),
    ("ebitda", r"\bEBITDA\b"),
    ("total_assets", r"^total\s+assets"),
    ("net_worth", r"(?:^total\s+equity$|^net\s*worth|equity\s+attributable\s+to\s+(?:the\s+)?owners)"),
    ("borrowings_lt", r"(?:long[\s-]?term|non[\s-]?current)\s+borrowings"),
    ("borrowings_st", r"(?:short[\s-]?term|current)\s+borrowings"),
    ("total_debt", r"^total\s+(?:borrowings|debt)"),
    ("receivables", r"trade\s+receivables"),
    ("inventory", r"^inventor(?:y|ies)"),
    ("cash", r"cash\s+and\s+cash\s+equivalents"),
    ("current_assets", r"^total\s+current\s+assets"),
    ("current_liabilities", r"^total\s+current\s+liabilities"),
    ("cfo", r"net\s+cash\s+(?:flows?\s+)?[^,;.]{0,40}?operat(?:ing|ions)"),
    ("cfi", r"net\s+cash\s+(?:flows?\s+)?[^,;.]{0,40}?investing\s+activit"),
    ("cff", r"net\s+cash\s+(?:flows?\s+)?[^,;.]{0,40}?financing\s+activit"),
    ("capex", r"(?:purchase|acquisition)\s+of\s+property,?\s+plant"),
]
FLOW_LABEL = r"proceeds|repayments?\b|\bincrease\b|\bdecrease\b"
ENUM_PREFIX = r"^\(?(?:[a-z]|[ivx]{1,4}|\d{1,2})[.)]\s*"
ROMAN_TAIL = r"\s*\(\s*[IVX][IVX\s=+\-]*\)\s*$"
STATEMENT_ANCHORS = [
    r"restated\s+(?:consolidated\s+|standalone\s+)?statement\s+of\s+profit\s+and\s+loss",
    r"restated\s+(?:consolidated\s+|standalone\s+)?statement\s+of\s+assets\s+and\s+liabilities",
    r"restated\s+(?:consolidated\s+|standalone\s+)?(?:statement\s+of\s+)?cash\s+flows?",
    r"summary\s+(?:of\s+)?(?:restated\s+)?financial\s+information",
    r"balance\s+sheet",
    r"statement\s+of\s+profit\s+and\s+loss",
    r"cash\s+flow\s+statement",
]

# --- fixed values: canonical chapters (key, titles, heading pattern) ------------
CHAPTERS = [
    ("offer_summary", ["offer document summary", "summary of the offer document"],
     r"(?:OFFER DOCUMENT SUMMARY|SUMMARY OF THE OFFER DOCUMENT)"),
    ("risk_factors", ["risk factors", "internal risk factors"], r"RISK FACTORS"),
    ("general_information", ["general information"], r"GENERAL INFORMATION"),
    ("capital_structure", ["capital structure"], r"CAPITAL STRUCTURE"),
    ("objects_of_offer", ["objects of the offer", "objects of the issue"],
     r"OBJECTS OF THE (?:OFFER|ISSUE)"),
    ("basis_for_offer_price",
     ["basis for offer price", "basis for issue price", "basis for the offer price"],
     r"BASIS FOR (?:THE )?(?:OFFER|ISSUE) PRICE"),
    ("tax_benefits", ["statement of special tax benefits", "statement of tax benefits"],
     r"STATEMENT OF (?:SPECIAL )?TAX BENEFITS"),
    ("industry_overview", ["industry overview", "our industry"],
     r"(?:INDUSTRY OVERVIEW|OUR INDUSTRY)"),
    ("our_business", ["our business", "business overview"],
     r"(?:OUR BUSINESS|BUSINESS OVERVIEW)"),
    ("key_regulations", ["key regulations and policies"], r"KEY REGULATIONS AND POLICIES"),
    ("history_corporate",
     ["history and certain corporate matters", "history and corporate structure"],
     r"HISTORY AND (?:CERTAIN )?CORPORATE (?:MATTERS|STRUCTURE)"),
    ("management", ["our management", "board of directors and management"], r"OUR MANAGEMENT"),
    ("promoters",
     ["our promoters and promoter group", "our promoters", "promoters and promoter group"],
     r"(?:OUR )?PROMOTERS?(?: AND PROMOTER GROUP)?"),
    ("group_companies", ["our group companies", "group companies"],
     r"(?:OUR )?GROUP COMPAN(?:Y|IES)"),
    ("dividend_policy", ["dividend policy"], r"DIVIDEND POLICY"),
    ("financial_statements",
     ["financial statements", "restated financial statements", "financial information",
      "restated financial information"],
     r"(?:RESTATED )?(?:CONSOLIDATED )?FINANCIAL (?:STATEMENTS|INFORMATION)"),
    ("other_financial_info", ["other financial information"], r"OTHER FINANCIAL INFORMATION"),
    ("capitalisation", ["capitalisation statement", "capitalization statement"],
     r"CAPITALI[SZ]ATION STATEMENT"),
    ("indebtedness", ["financial indebtedness"], r"FINANCIAL INDEBTEDNESS"),
    ("mdna",
     ["management's discussion and analysis",
      "management discussion and analysis of financial condition"],
     r"MANAGEMENT'?S? DISCUSSION AND ANALYSIS"),
    ("litigation",
     ["outstanding litigation and material developments", "outstanding litigations"],
     r"OUTSTANDING LITIGATIONS? AND MATERIAL DEVELOPMENTS?"),
    ("government_approvals", ["government and other approvals"],
     r"GOVERNMENT AND OTHER APPROVALS"),
    ("regulatory_disclosures", ["other regulatory and statutory disclosures"],
     r"OTHER REGULATORY AND STATUTORY DISCLOSURES"),
    ("terms_of_offer", ["terms of the offer", "terms of the issue"],
     r"TERMS OF THE (?:OFFER|ISSUE)"),
    ("offer_structure", ["offer structure", "issue structure"], r"(?:OFFER|ISSUE) STRUCTURE"),
    ("offer_procedure", ["offer procedure", "issue procedure"], r"(?:OFFER|ISSUE) PROCEDURE"),
    ("material_contracts", ["material contracts and documents for inspection"],
     r"MATERIAL CONTRACTS AND DOCUMENTS"),
]
CORE_CHAPTERS = [
    "risk_factors", "capital_structure", "objects_of_offer", "basis_for_offer_price",
    "industry_overview", "our_business", "promoters", "dividend_policy",
    "financial_statements", "litigation", "offer_structure", "mdna",
]
HEADING_PREFIX = r"(?:SECTION\s+[IVXLC]+\s*[-–:.]?\s*)?"
TITLE_THRESHOLD = 82.0

# --- fixed values: sectors --------------------------------------------------------
PROFILE_SECTOR = {
    "consumer cyclical": "Consumer Discretionary",
    "consumer defensive": "Consumer Discretionary",
    "financial services": "Financials",
    "basic materials": "Materials",
    "communication services": "Technology",
    "utilities": "Energy",
    "industrials": "Industrials",
    "technology": "Technology",
    "healthcare": "Healthcare",
    "real estate": "Real Estate",
    "energy": "Energy",
}
SECTOR_BUCKETS = [
    ("insurance", r"insurance|policyholder"),
    ("asset_management", r"asset management|mutual fund|aum"),
    ("fin_services", r"broking|lending|nbfc|fintech|financial products|investment platform"),
    ("consumer", r"consumer|retail|food|beverage|fmcg|apparel|eyewear|appliances|electronics"),
    ("pharma_health", r"pharma|drug|formulation|clinical|hospital|diagnostic"),
    ("energy_infra", r"solar|renewable|power|energy|epc|infrastructure|construction"),
    ("industrial", r"manufactur|engineering|granite|mining|chemical|textile|packaging"),
    ("workspace_realty", r"workspace|real estate|leasing|coworking"),
    ("tech_platform", r"platform|technology|software|digital|e-commerce|online"),
]
BUCKET_SECTOR = {
    "insurance": "Financials",
    "asset_management": "Financials",
    "fin_services": "Financials",
    "consumer": "Consumer Discretionary",
    "pharma_health": "Healthcare",
    "energy_infra": "Energy",
    "industrial": "Industrials",
    "workspace_realty": "Real Estate",
    "tech_platform": "Technology",
}
NAME_SECTORS = [
    ("Financials",
     r"\b(?:bank|nbfc|financ|finserv|fincorp|capital\b|securit|broking|brokerage|insur|"
     r"assurance|asset manage|funds? manage|mutual fund|wealth|microfin|credit\b|lending|"
     r"fintech|bajaj fin|investment\b|invest manage)"),
    ("Real Estate",
     r"\b(?:realty|real estate|estates?\b|developer|properti|property|builder|township|"
     r"infratech|housing\b(?! finance))"),
    ("Healthcare",
     r"\b(?:pharma|health|hospital|medic|medi |drug|lab\b|labs\b|laborator|diagnostic|"
     r"life ?science|bio ?tech|biotech|surgical|remedies|therapeut|nutrit|speciality|"
     r"parenteral|wellness|research\b|crop ?science|vaccin)"),
    ("Technology",
     r"\b(?:tech\b|techno|software|infotech|digital|digitek|cyber|e-?commerce|internet|"
     r"computer|analytic|infosys|datamatic|softech|it services|semiconduct|electronic)"),
    ("Energy",
     r"\b(?:power|energy|solar|renewable|wind\b|oil\b|oils\b|gas\b|gases|petro|coal|"
     r"electric|utilit|bioenerg|ethanol|hydro)"),
    ("Materials",
     r"\b(?:steel|cement|chemical|metal|alloy|mining|mineral|polymer|paper|plastic|glass|"
     r"fertili|pigment|granite|ceramic|stainless|wires?\b|copper|aluminium|zinc|carbon|"
     r"resin|adhesive|agrolife|agro ?chem)"),
    ("Consumer Discretionary",
     r"\b(?:food|beverage|retail|apparel|textile|garment|spin|twistex|texworld|hotel|"
     r"restaurant|jewel|diamond|consumer|fmcg|dairy|agro|footwear|furniture|cosmetic|"
     r"entertain|media|travel|tourism|leisure|educat|edtech|coffee|tea\b|brewer|distiller|"
     r"studds|accessories|mattress|wakefit)"),
    ("Industrials",
     r"\b(?:engineering|industr|manufactur|machin|tools?\b|infra|construct|logistic|"
     r"transport|cargo|freight|forwarder|shipping|defence|aerospace|auto|motors?\b|"
     r"bearing|electrical|packaging|mechatronic|pumps?\b|valves?\b|castings?\b|"
     r"fabricat|equipment|instrument)"),
]
FINANCIAL_INDUSTRY = (
    r"bank|credit|capital market|asset management|insurance|financial|lending|mortgage|"
    r"savings|thrift|shell company|closed-end fund"
)
REALTY_INDUSTRY = r"real estate|reit|property"
INVIT_NAME = r"\binvit\b|infrastructure investment trust"
REIT_NAME = r"\breit\b|real estate investment trust"

# --- fixed values: filings, reservation and indicator blocks ------------------------
TITLE_BLACKLIST = r"corrigendum|addendum|\bnotice\b|clarification"
ARCHIVE_BLACKLIST = TITLE_BLACKLIST + r"|abridged"
RESERVATION_PATTERNS = {
    "pct_qib": [
        r"shares_offered_qib_percentage[^%]{0,60}?([\d.]+)\s*%",
        r"QIB\b[^%]{0,40}?Not (?:more|less) than\s+([\d.]+)\s*%",
        r"qib_percentage[^%]{0,60}?([\d.]+)\s*%",
    ],
    "pct_retail": [
        r"shares_offered_rii_percentage[^%]{0,60}?([\d.]+)\s*%",
        r"Retail\b[^%]{0,40}?Not (?:more|less) than\s+([\d.]+)\s*%",
        r"(?:retail|rii)_percentage[^%]{0,60}?([\d.]+)\s*%",
    ],
    "pct_nii": [
        r"shares_offered_nii_percentage[^%]{0,60}?([\d.]+)\s*%",
        r"\bNII\b[^%]{0,40}?Not (?:more|less) than\s+([\d.]+)\s*%",
        r"(?<![a-z])nii_percentage[^%]{0,60}?([\d.]+)\s*%",
    ],
}
ANCHOR_SHARE = 0.6
KPI_MARKER = "Key Performance Indicator"
KPI_BLOCK_CHARS = 800
KPI_PATTERNS = {
    "kpi_roe": r"\bROE\b",
    "kpi_roce": r"\bROCE\b",
    "kpi_debt_equity": r"Debt\s*/\s*Equity",
    "kpi_pat_margin": r"PAT\s+Margin",
    "kpi_ebitda_margin": r"EBITDA\s+Margin",
    "kpi_pb": r"Price to Book Value",
}
KPI_PE = r"P\s*/\s*E\s*\(x\)\s+(-?[\d.]+)(?:\s+(-?[\d.]+))?"

# --- fixed values: objects, litigation and risk classes -------------------------------
OBJECT_CATEGORIES = [
    ("debt_repayment", r"repayment|prepayment|redemption.*debenture|borrowings"),
    ("capex", r"capital\s+expenditure|purchase\s+of\s+(?:machinery|equipment)|setting\s+up"
              r"|expansion|construction|new\s+facility"),
    ("working_capital", r"working\s+capital"),
    ("acquisition", r"acquisition|inorganic|investment\s+in\s+subsidiar"),
    ("general_corporate", r"general\s+corporate\s+purposes?"),
]
LITIGATION_KINDS = [
    ("criminal", r"criminal\s+proceedings?\D{0,80}?(\d{1,4})"),
    ("tax", r"tax\s+(?:proceedings?|matters?|litigations?)\D{0,80}?(\d{1,4})"),
    ("statutory", r"(?:statutory|regulatory)\s+(?:proceedings?|actions?)\D{0,80}?(\d{1,4})"),
    ("material_civil", r"material\s+civil\s+litigations?\D{0,80}?(\d{1,4})"),
]
SEVERITIES = ["low", "medium", "high", "critical"]
SEVERITY_PENALTY = {"critical": 18.0, "high": 10.0, "medium": 4.0, "low": 1.0}
RISK_CLASSES = [
    "customer_concentration", "supplier_concentration", "litigation", "debt_burden",
    "working_capital", "negative_cash_flow", "promoter_pledging", "regulatory",
    "industry_cyclicality", "forex_exposure", "key_personnel", "one_time_revenue",
    "government_dependency", "competition",
]
CONCENTRATION_BANDS = {
    "customer_concentration": ("customers?", "customer", (30.0, 50.0, 70.0)),
    "supplier_concentration": ("suppliers?|vendors?", "supplier", (40.0, 60.0, 80.0)),
}
RISK_PATTERNS = [
    ("regulatory",
     r"[^.\n]{0,120}(?:revocation|non[- ]renewal|failure\s+to\s+(?:obtain|maintain|renew))\s+"
     r"[^.\n]{0,60}(?:licen[cs]es?|approvals?|permits?)[^.\n]{0,100}",
     "medium", "Business depends on regulatory licences/approvals"),
    ("industry_cyclicality", r"[^.\n]{0,120}cyclical[^.\n]{0,120}", "medium",
     "Industry described as cyclical"),
    ("forex_exposure",
     r"[^.\n]{0,120}(?:foreign\s+(?:currency|exchange)\s+(?:risk|fluctuations?)"
     r"|exchange\s+rate\s+fluctuations?)[^.\n]{0,120}",
     "low", "Foreign-currency exposure disclosed"),
    ("key_personnel",
     r"[^.\n]{0,120}(?:depend\w*\s+(?:heavily\s+|significantly\s+)?on\s+(?:our\s+)?"
     r"(?:promoters?|key\s+manage|senior\s+manage))[^.\n]{0,120}",
     "medium", "Dependence on promoters / key personnel"),
    ("government_dependency",
     r"[^.\n]{0,120}(?:government\s+(?:contracts?|tenders?|customers?)"
     r"|public\s+sector\s+(?:undertakings?|customers?))[^.\n]{0,120}",
     "medium", "Revenue dependence on government/PSU clients"),
    ("one_time_revenue",
     r"[^.\n]{0,120}(?:non[- ]recurring|one[- ]time)\s+(?:revenue|income|gains?)[^.\n]{0,120}",
     "medium", "One-time / non-recurring revenue flagged"),
    ("competition", r"[^.\n]{0,120}(?:highly|intensely)\s+competitive[^.\n]{0,120}", "low",
     "Highly competitive industry"),
]
LEADERSHIP_CLAIM = (
    r"(?:one of the |the )?(?:largest|leading|market leader|top\s+(?:three|five|3|5))"
)
GROWTH_CLAIM = r"(?:strong|robust|significant|substantial)\s+growth"
GROWTH_CLAIM_MIN_CAGR = 0.08

# --- fixed values: score weights by lens ------------------------------------------------
CATEGORIES = [
    "business_quality", "financial_health", "growth", "valuation", "promoter_quality",
    "governance", "risk_level", "competitive_position", "capital_efficiency",
    "cash_generation",
]
LENSES = {
    "balanced": [0.12, 0.12, 0.12, 0.14, 0.10, 0.08, 0.12, 0.06, 0.07, 0.07],
    "conservative": [0.10, 0.14, 0.06, 0.12, 0.10, 0.12, 0.18, 0.04, 0.06, 0.08],
    "growth": [0.12, 0.08, 0.18, 0.10, 0.10, 0.08, 0.08, 0.10, 0.08, 0.08],
}
FORENSIC_CAP = 55.0

# --- fixed values: bands (threshold, points); "above" lists score lower-is-better --------
BANDS = {
    "operating_margin_level": [(25, 20), (15, 15), (8, 10), (3, 5), (-999, 0)],
    "margin_stability": [(6, 0), (3, 5), (1.5, 8), (-1, 10)],
    "revenue_scale": [(1000, 10), (250, 7), (50, 4), (-1, 2)],
    "debt_to_equity": [(2.5, 0), (1.5, 4), (0.75, 10), (0.3, 19), (-1, 25)],
    "current_ratio": [(1.5, 15), (1.1, 11), (0.9, 6), (-1, 0)],
    "interest_cover": [(8, 10), (4, 7), (2, 4), (-999, 0)],
    "contingent_liabilities": [(50, 0), (30, 3), (10, 6), (-1, 10)],
    "cagr": [(25, 20), (15, 16), (8, 10), (0, 5), (-999, 0)],
    "absolute_pe": [(60, 1), (30, 4), (15, 7), (-1, 10)],
    "growth_adjusted_pe": [(2, 2), (1, 6), (-1, 10)],
    "post_issue_holding": [(60, 15), (45, 12), (30, 7), (-1, 3)],
    "ofs_share_of_issue": [(75, 0), (50, 5), (25, 10), (-1, 15)],
    "dilution_size": [(20, 3), (10, 6), (-999, 10)],
    "rpt_intensity": [(10, 0), (2, 6), (-1, 10)],
    "returns_vs_peers": [(5, 15), (0, 11), (-5, 6), (-999, 2)],
    "return_on_capital": [(20, 15), (12, 11), (6, 6), (-999, 1)],
    "cfo_to_pat": [(1.0, 20), (0.8, 14), (0.5, 8), (-999, 0)],
}
CALL_POINTS = {
    "undervalued": 30.0, "fairly_valued": 22.0, "fairly_valued_expensive": 12.0,
    "overvalued": 4.0,
}
CALL_LABELS = {
    "undervalued": "Undervalued vs peers",
    "fairly_valued": "Fairly valued vs peers",
    "fairly_valued_expensive": "Expensive side of fair",
    "overvalued": "Overvalued vs peers",
    "indeterminate": "Valuation indeterminate",
}
QUALITY_TIERS = [
    (75, "Strong fundamentals"), (60, "Solid fundamentals"), (45, "Mixed fundamentals"),
]
QUALITY_FLOOR = "Weak fundamentals"
RISK_TIERS = [
    (75, "low risk profile"), (55, "moderate risk profile"), (35, "elevated risk profile"),
]
RISK_FLOOR = "high risk profile"

# --- fixed values: patterns of issue details -----------------------------------------------
_GAP, _PCT = r"[^%\n]{0,160}?", r"([\d]{1,2}(?:\.\d+)?)\s*%"
PRE_ISSUE, POST_ISSUE = r"pre[\s-]?(?:offer|issue)", r"post[\s-]?(?:offer|issue)"
ISSUE_PATTERNS = {
    "band": rf"price\s+band\s*[:of]*\s*{RUPEE}\s*([\d,\.]+)\s*(?:to|–|-)\s*{RUPEE}?\s*([\d,\.]+)",
    "fixed": rf"(?:issue|offer)\s+price\s*(?:of|:)?\s*{RUPEE}\s*([\d,]+(?:\.\d+)?)\s*(?:/-|per|each|\s)",
    "face": rf"face\s+value\s+of\s*{RUPEE}\s*([\d\.]+)",
    "fresh": rf"fresh\s+issue\s+of[^.]*?aggregating\s+(?:up\s+to\s+)?{AMOUNT}",
    "ofs": rf"offer\s+for\s+sale\s+of[^.]*?aggregating\s+(?:up\s+to\s+)?{AMOUNT}",
    "lot": r"(?:bid\s+lot|lot\s+size|minimum\s+(?:bid|order)\s+(?:lot|quantity))\D{0,40}?(\d{1,4})\s+equity\s+shares",
    "exchanges": r"\bNSE\b.{0,40}\bBSE\b|\bBSE\b.{0,40}\bNSE\b",
    "pre_a": rf"{PRE_ISSUE}{_GAP}promoters?{_GAP}{_PCT}",
    "pre_b": rf"promoters?{_GAP}{PRE_ISSUE}{_GAP}{_PCT}",
    "post_a": rf"{POST_ISSUE}{_GAP}promoters?{_GAP}{_PCT}",
    "post_b": rf"promoters?{_GAP}{POST_ISSUE}{_GAP}{_PCT}",
}
ISSUER_PE_PATTERNS = {
    "a": r"p\s*/\s*e\s*(?:ratio)?[^\n]{0,120}?(?:cap|upper|higher)[^\n]{0,80}?price\s+band[^\d]{0,40}([\d]{1,3}(?:\.\d+)?)",
    "b": r"price\s+band[^\n]{0,120}?p\s*/\s*e[^\d]{0,60}([\d]{1,3}(?:\.\d+)?)\s*times",
}
COMPANY_CAPS = r"^([A-Z][A-Z0-9&.,()\- ]{3,80}LIMITED)\s*$"
COMPANY_MIXED = r"^([A-Z][A-Za-z0-9&.,()\- ]{3,80}(?:LIMITED|Limited))\s*$"
TOC_LINE = r"^(.{4,80}?)[\s.·]{3,}(\d{1,4})\s*$"

# --- fixed values: table columns and rows ----------------------------------------------------
PE_COLUMN = r"p\s*[/\\]?\s*e\b|\bpe\s*ratio\b|price\s*(?:/|to)\s*earning"
EPS_COLUMN = r"\beps\b|earning[s]?\s+per\s+share"
EPS_BASIC_COLUMN = r"eps.*basic|basic.*eps"
RONW_COLUMN = r"ronw|return on net"
PERCENT_COLUMN = r"%|percentage"
NOT_A_PEER = r"peer|company name|^name$|average|nifty"
FISCAL_ROW = r"fiscal|financial year|fy\s*\d|20\d\d"
NOT_PROMOTER = r"public|non[- ]promoter"
PAGE_UNIT = r"(?:₹|rs\.?|inr)?\s*(?:in\s+)?(lakhs?|lacs|crores?|millions?|billions?)"
UNIT_CAPTION = r"(?:₹|rs\.?|rupees|inr)\s*(?:in\s+)?(" + UNIT_WORDS + ")"
UNIT_BRACKET = r"\(\s*(?:all\s+amounts?\s+)?(?:₹|rs\.?|inr)?\s*in\s+(lakhs?|lacs|crores?|millions?|mn)"

# --- fixed values: values and headings of borderless statements --------------------------------
STATEMENT_NUMBER = r"\(?-?\d{1,3}(?:,\d{2,3})+(?:\.\d+)?\)?|\(?-?\d+\.\d+\)?"
NON_CURRENT_HEADING = r"non[\s-]?current\s+liabilit"
CURRENT_HEADING = r"^current\s+liabilit"
BARE_BORROWINGS = r"^borrowings?$"

# --- fixed values: disclosures -------------------------------------------------------------------
RELATED_PARTY = r"related\s+party\s+(?:transactions?|disclosures?)"
RELATED_PARTY_AMOUNTS = [
    rf"(?:total|aggregate)[^\n]{{0,80}}related\s+party[^\n]{{0,80}}?{STRICT_AMOUNT}",
    rf"related\s+party\s+transactions?[^\n]{{0,120}}?(?:aggregat\w+|total\w*)[^\n]{{0,60}}?{STRICT_AMOUNT}",
]
CONTINGENT = r"contingent\s+liabilit(?:y|ies)"
CONTINGENT_AMOUNTS = [rf"contingent\s+liabilit(?:y|ies)[^\n]{{0,200}}?{STRICT_AMOUNT}"]
TOTAL_ROW = r"^\s*total"
CONTINGENT_ROW = r"^\s*total|contingent\s+liabilit"
LITIGATION_AMOUNT = rf"aggregate\s+amount[^.\n]{{0,120}}?{AMOUNT}"
NO_DIVIDEND = r"(?:not\s+(?:declared|paid)|no\s+dividend)"
DIVIDEND = r"dividend\s+of\s+₹|declared\s+(?:and\s+paid\s+)?dividends?"
PLEDGE = (r"([^\n.]{0,150}pledg\w+[^\n.]{0,150}promot\w+[^\n.]{0,100}"
          r"|[^\n.]{0,150}promot\w+[^\n.]{0,80}pledg\w+[^\n.]{0,150})")
NO_PLEDGE = (r"(?:none|nil|no|not)\s+(?:of\s+the\s+)?(?:equity\s+)?shares?\s+.{0,40}pledg"
             r"|pledg\w+\s*:?\s*(?:nil|none)")
QUALIFIED_OPINION = r"qualified\s+opinion|adverse\s+opinion|disclaimer\s+of\s+opinion"
EMPHASIS = r"emphasis\s+of\s+matter"

# --- fixed values: promoters ----------------------------------------------------------------------
PROMOTER_STATED = (
    r"([A-Z][a-zA-Z.]+(?:[ \t]+[A-Z][a-zA-Z.]+){1,3})\s*(?:,\s*aged\s+\d+\s+years?)?\s*,?\s+"
    r"(?:is|are)\s+(?:one\s+of\s+)?(?:our|the)\s+Promoters?"
)
PROMOTERS_LISTED = r"[Oo]ur\s+Promoters?\s+(?:are|is)\s+([^.]{5,200})\."
EXPERIENCE = r"(?:experience|track record)\s+of\s+(?:over|more than|approximately|around)?\s*(\d{1,2})\s+years"
INDEPENDENT_DIRECTOR = r"independent\s+director"
WOMAN_DIRECTOR = r"woman\s+director"
CONFLICT = r"(?:conflict\s+of\s+interest|similar\s+(?:line\s+of\s+)?business|common\s+pursuits)"
PAST_VENTURE = r"(?:previously\s+(?:founded|promoted)|erstwhile\s+(?:venture|company)|disassociat\w+)"

# --- fixed values: quantified risks -----------------------------------------------------------------
CONCENTRATION = r"top\s+(?:ten|five|10|5|three|3)?\s*(?:{noun})[^.\n]{{0,200}}?([\d]{{1,2}}(?:\.\d+)?)\s*%"
DEPENDENCE = r"depend\w*\s+on\s+(?:a\s+)?(?:limited|few|small)\s+(?:number\s+of\s+)?(?:{noun})"
NEGATIVE_WORKING_CAPITAL = r"[^.\n]{0,120}negative\s+working\s+capital[^.\n]{0,120}"
NEGATIVE_CASH_FLOW = r"negative\s+cash\s+flows?"
EXPORT_SHARE = r"exports?[^.\n]{0,140}?([\d]{1,2}(?:\.\d+)?)\s*%[^.\n]{0,80}(?:revenue|turnover)"
PARAGRAPH_BREAK = r"\n\s*\n|\n(?=\d{1,3}\.\s)"
SPECIFIC_FIGURE = r"\d+(?:\.\d+)?\s*%|₹\s*[\d,]+"

# Column names of the landed tables (left) and of the wide dataset.
GAIN = "% Gain/Loss (Issue price v/s close price on Listing)"
BASE_NAMES = {
    "company": "Name", "detail_url": "URL", "Pricing Method": "Pricing",
    "Opening Date": "Apply Date", "Closing Date": "Close Date", "Listing Date": "List Date",
    "Issue Price (Rs.)": "Offer Price",
    "Total Issue Amount (Incl.Firm reservations) (Rs.cr.)": "Issue Size (cr)",
    "Fresh Capital (Rs.cr.)": "Fresh (cr)", "Offer for sale (Rs.cr.)": "OFS (cr)",
    "Left Lead Manager": "Lead Manager",
}
SUB_NAMES = {
    "QIB (x)": "QIB", "bNII (x)": "bNII", "sNII (x)": "sNII", "NII (x)": "NII",
    "Retail (x)": "Retail", "Employee (x)": "Employee", "Total (x)": "Total Sub",
    "Applications": "Applications",
}
LISTING_NAMES = {
    "ISIN": "ISIN", "NSE Symbol": "NSE Symbol", "BSE Scrip Code": "BSE Scrip Code",
    "Close Price on Listing (Rs.)": "Day1 Close", GAIN: "Listing Gain",
}
OUTCOME_NAMES = {
    "ret_6m": "Ret 6m %", "ret_12m": "Ret 12m %", "ret_24m": "Ret 24m %",
    "bottom_12m_pct": "Bottom 12m %", "sessions_to_bottom": "Sessions to Bottom",
    "peak_24m_pct": "Peak 24m %", "sessions_to_peak": "Sessions to Peak",
    "current_ret": "Current Ret %", "delisted": "Delisted",
}
NUMERIC = ["Offer Price", "Issue Size (cr)", "Fresh (cr)", "OFS (cr)", "QIB", "bNII", "sNII", "NII",
           "Retail", "Employee", "Total Sub", "Day1 Close", "Listing Gain"]
DETAIL_COLS = {
    "Sector": "sector", "% QIB": "pct_qib", "% Retail": "pct_retail", "% anchor": "pct_anchor",
    "ROE": "kpi_roe", "ROCE": "kpi_roce", "D/E": "kpi_debt_equity", "PAT Margin": "kpi_pat_margin",
    "EBITA Margin": "kpi_ebitda_margin", "P/B": "kpi_pb", "Post IPO P/E": "kpi_post_ipo_pe",
}
REPORT_COLS = {
    "ROE": ("roe", 100), "ROCE": ("roce", 100), "D/E": ("debt_equity", 1),
    "PAT Margin": ("pat_margin", 100), "EBITA Margin": ("ebitda_margin", 100),
    "Post IPO P/E": ("post_ipo_pe", 1),
}
TARGETS = ["Sector", "GMP", "Estimated Price", "ROE", "ROCE", "D/E", "PAT Margin", "P/B",
           "Post IPO P/E", "EBITA Margin", "% QIB", "% Retail", "% anchor", "LTP Gain"]
