"""Patterns, word lists, limits and rates that decide the results.

They are stated here once, in plain order, so that every operator and test uses the same text.
Patterns are Java regular expressions; ``functions.text.rx`` adds the flags.
"""

# ---- tokens inside billing text
MONEY = r"\$([0-9][0-9,]*\.\d{2})"
DATE = r"\d{2}/\d{2}/\d{4}"
CODE = r"[A-Z]?\d{4,5}(?:,\d{2})?"
ITEM_CODE = r"\d{5}-\d{4}-\d{2}"
FOUR_AMOUNTS = rf"\s*{MONEY}\s+{MONEY}\s+{MONEY}\s+{MONEY}"

# ---- document layouts
CLAIM_TOTAL = r"^\s*Claim Total:"
ACCOUNT_WORDS = ["Account Total:", "Account Subtotal:"]
ADMISSION_WORDS = ["Payment Summary", "Admission:"]
INPATIENT_WORDS = ["Inpatient Episode:", "Total Charges"]
DIALYSIS_TOTALS = [r"Period Total Charges:", r"^\s*PERIOD TOTAL:"]
PHARMACY_NAMES = ["Pharmacy", "PHARMACY"]
PHARMACY_TABLES = ["RX # FILL DATE", "Rx # Date", "Prescription Fill History", "Pharmacy Expense Report"]

# ---- segment markers, without leading blanks
CLAIM_MARKER = r"(?:Claim ID\s+(\d+)|\*\*\s*CLAIM\s+(\d+)\s*\*\*)"
ACCOUNT_MARKER = r"Account\s+(?:#\s*)?(\d+)\s*$"
ADMISSION_MARKER = rf"Admission:\s*({DATE})\s*\|\s*Discharge:\s*({DATE})\s*\|\s*Diagnosis:\s*(.+)$"
INPATIENT_MARKER = rf"Inpatient Episode:\s*({DATE})\s*[–-]\s*({DATE})\s*$"
DIALYSIS_MARKER = (
    rf"(?:Detail\s+[—-]\s*)?({DATE})\s*(?:to|[–-])\s*({DATE})\s*"
    r"\|\s*(\d+)\s+TREATMENTS?\s*\|\s*(?:Claim|CLM):\s*(CLM\d+)"
)

# ---- rows and totals of a segment
CLAIM_TOTAL_LINE = r"^\s*Claim Total:" + FOUR_AMOUNTS
CLAIM_BLOCK_END = (
    r"^\s*(?:PAYMENT\s+(?:ACH|CHECK|CARD|\$|#)|ADJUST|CONTRACTUAL|Claim Total:|\*\*\s*CLAIM|Claim ID)"
)
ACCOUNT_TOTAL_LINE = r"^\s*Account (?:Total|Subtotal):" + FOUR_AMOUNTS
ACCOUNT_ROW = rf"^\s*({DATE})\s+({CODE})\b.*?{MONEY}"
ADMISSION_LABELS = ["Total Charges:", "Insurance Paid:", "Contractual Adj:", "Patient Balance:"]
INPATIENT_LABELS = ["Total Charges", "Insurance Paid", "Adjustment", "Patient Balance"]
INPATIENT_DIAGNOSIS = r"^Diagnosis:\s*(.+)$"
DIAGNOSIS_STOP = r"^(Rev|Date|Code|Payment Summary|Total Charges)\b"
DIALYSIS_AMOUNTS = [
    rf"^\s*(?:Period Total Charges|PERIOD TOTAL):\s*{MONEY}",
    rf"\bIns Paid:\s*{MONEY}",
    rf"Contractual Adj(?:ustment)?\.?\s*\(\s*{MONEY}\s*\)",
    rf"(?:Ending Balance:?|= Ending Balance)\s*{MONEY}",
]
DIALYSIS_INSURER = r"\bInsurer:\s*([A-Za-z][A-Za-z ]+)"

# ---- provider
CUSTODIAN = r"^RECORDS CUSTODIAN:\s*\n(.+?)(?:\s+\(Billing Records\))?$"
CUSTODIAN_SUFFIX = r"\s+\(Billing Records\)$"
STATEMENT_SUFFIX = r"\s+(?:Patient Billing Statement|Patient Account Statement|Pharmacy Expense Report)$"

# ---- payer
PAYER_LABEL = r"\b(?:Insurer|Payer|Insurance|Ins)\s*:\s*([A-Za-z][^\n|]*)"
PAYER_TABLE = rf"^Patient Name\s+Date of Birth\s+Insurance\s*\n.+?{DATE}\s+([A-Za-z][^\n]+)$"
PAYER_INLINE = r"^.*\bInsurance\s+([A-Za-z][A-Za-z &./'-]*?)\s*$"
PAYER_STOP = (
    r"\b(?:DOB|Date of Birth|Patient|Patient ID|ID|Phone|Tel|Order|Ref|Plan Type|Due Date|Amount|Paid|Charge|Adj)\b"
)
PAYER_EDGE_CHARS = " :-—|,.;"
PAYER_CODE_SUFFIX = r"\s+\([A-Z0-9 -]+\)$"
PAYER_GENERIC = ["insurance", "ins", "payer", "plan", "payment", "reason"]
UNNAMED_PAYER = "Insurance Payment"
UNNAMED_PAYER_WORDS = [r"\bInsurance\b", r"\bPayment\b"]
UNNAMED_PAYER_EXCEPT = r"\bInsurance Paid\b|\bInsurance Payments\b"
PAYER_SLASH = r"(?:^|\s)/\s*([^$]+?)\s+\$"
PAYER_CONTINUED = (
    r"\$\d[\d,]*\.\d{2}\s+([A-Za-z][A-Za-z -]{0,40}?)(?=\s+(?:PAYMENT|ADJUST|CONTRACTUAL|CLAIM)|$)"
)
PAYER_SLASH_WRAPPED = (
    r"(?:^|\s)/\s*([A-Za-z][A-Za-z &.'-]{1,80}?)(?=\s+(?:PAYMENT|ADJUST|CONTRACTUAL|CLAIM|Page\s+\d+)|$)"
)
CLAIM_ROW_INSIDE = rf"\b\d{{5,}}\s+{CODE}\s+{DATE}\s+"
COLUMN_NOISE = r"^(PAYMENT|ADJUST|CONTRACTUAL|Claim Total|\()"
COLUMN_CLINICIAN = r"\s+[A-Z][A-Z'-]+(?:\s+[A-Z][A-Z'-]+)?$"
TITLE_NAME = r"\b[A-Z][A-Za-z&.'-]{2,}(?:\s+[A-Z][A-Za-z&.'-]{2,})*\b"
NAME_STOP_WORDS = ["the", "and", "for", "with"]

# ---- pharmacy
PHARMACY_SECTION_START = ["RX # FILL DATE", "Rx # Date", "Date Rx #", "Prescription Fill History"]
PHARMACY_SECTION_END = ["*** END OF PATIENT PROFILE", "Payment Summary", "Total fills:"]
PHARMACY_TOTALS = [
    rf"^\s*TOTALS?:\s*{MONEY}\s+{MONEY}\s+{MONEY}\s*$",
    rf"^\s*TOTAL\s+{MONEY}\s+{MONEY}\s+{MONEY}\s*$",
]
PHARMACY_SUMMARY = (
    rf"Payment Summary\s+Patient Paid\s*{MONEY}\s+Insurance Paid\s*{MONEY}\s+"
    rf"Others \(Third Parties\)\s*{MONEY}\s+Grand Total\s*{MONEY}"
)
PHARMACY_REPORT = "Pharmacy Expense Report"
PHARMACY_RECORD = "Pharmacy Record"
PARTY_DETAIL = r"Third[- ]Party Payer Detail\s+.*?(?=Payment Summary|Grand Total|Page\s+\d+|$)"
PARTY_DETAIL_HEADER = r"^(Third[- ]Party|Payer(?: Name)?\b)"
PARTY_DETAIL_END = r"(?:\s+BIN\s+\S+|\s+\$).*$"
BIN_MARKER = r"\(BIN\b"
PRESCRIBER_LINE = r"^[A-Z][A-Z'-]{3,}$"
PRESCRIBER_ROW = rf"\b{ITEM_CODE}\b\s+(.*?)\s+\d+\s+\d+\s+{MONEY}"
DRUG_ROW = rf"{DATE}\s+(.+?)\s+{ITEM_CODE}\b"
DRUG_STRENGTH = r"\b([A-Za-z][A-Za-z-]*)[^\S\r\n]+\d+(?:\.\d+)?[^\S\r\n]*(?:mg|mcg|u/mL|mL)\b"
DRUG_EXTRA_WORDS = ["inhaler", "refill"]
PARTY_COLUMN_HEADER = r"3rd Party\s+Prescriber"
FILL_ROW = rf"\b\d{{7}}\s+{DATE}\b"
PARTY_COLUMN_TAIL = (
    rf"^(?:(.*?)\s+)?[A-Z][A-Z'-]+\s+[A-Z][A-Z'-]+\s+\d+\s+\d+\s+{MONEY}\s+{MONEY}"
)
FRAGMENT_HEADER = r"^\s*(?:RX #|Date Rx #|Page\s+\d+|TOTALS?:|TOTAL\b)"
FRAGMENT_CLINICIAN = r"\b[A-Z][A-Z'-]+\s+[A-Z][A-Z'-]+\s+\d+\s+\d+\s+"
FRAGMENT_TOKENS = rf"{DATE}|\b\d{{7}}\b|\b{ITEM_CODE}\b|{MONEY}"
FRAGMENT_NUMBER = r"\b\d+(?:\.\d+)?(?:mg|mcg|u/mL|mL)?\b"
FRAGMENT_UNIT = r"\b(?:mg|mcg|u/mL|mL)\b"
FRAGMENT_EDGE_CHARS = " ,.;:()"
PARTY_CODE = r"\s+\([A-Z0-9 -]+\)"
PARTY_CODE_TAIL = r"\s+[A-Z0-9]+\)$"
PARTY_FRAGMENT_ENDINGS = ["health", "party"]
PARTY_LONG_LIST = 50
PARTY_MIN_COUNT = 3
PARTY_MIN_SHARE = 0.03

# ---- page kinds, in rule order: any phrase, or all phrases of a list
PAGE_KIND_RULES = [
    ("cover", ["records pertaining to", "records custodian"]),
    ("certification", ["certification of records"]),
    ("lab_report", ["laboratory report", ["test name", "reference range"]]),
    ("pharmacy_ledger", ["rx #", "fill date", "3rd party", ["ndc", "copay"]]),
    ("billing_ledger", ["billing summary", "claim id", "claim total", "contractual adjustment"]),
    ("prescription", ["clinical note", "prescriber:", ["diagnosis:", "npi:"]]),
]
BILLING_KINDS = ["billing_ledger", "pharmacy_ledger"]
NOISE_KINDS = ["cover", "certification", "lab_report", "prescription", "empty"]

# ---- report
DATE_TOKEN = r"(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
CENTURY_PIVOT = 70
MISSING_INVOICE_VALUE = "__missing_invoice__"
MISSING_INVOICE_LABEL = "Invoice not found"
NUMERIC_TEXT = r"^\s*-?[0-9]+(\.[0-9]+)?\s*$"

# ---- evaluation: fields scored, in order (truth name, prediction name)
SCORED_FIELDS = [
    ("treatmentDate", "treatment_date"),
    ("cptCodes", "cpt_codes"),
    ("description", "description"),
    ("provider", "provider"),
    ("insurers", "insurers"),
    ("thirdParties", "third_parties"),
    ("totalCharges", "total_charges"),
    ("insPaid", "ins_paid"),
    ("adjustment", "adjustment"),
    ("payments", "payments"),
    ("balance", "balance"),
    ("page", "page"),
]

# ---- prices in USD per million tokens: model, input, cached input, output
MODEL_PRICES = [
    ("gpt-5.4", 1.25, 0.125, 10.0),
    ("gpt-5.4-mini", 0.25, 0.025, 2.0),
    ("gpt-5.4-nano", 0.05, 0.005, 0.40),
]
DEFAULT_PRICE_MODEL = "gpt-5.4-mini"

# ---- limits
MAX_PAGES = 400
PAGE_MISSING = "(out of range)"
PAGE_BLANK = "(no extractable text on this page)"
STALL_MESSAGE = "Recovered after worker stall; max attempts ({}) exhausted"
MIN_CHARS_ON_IMAGE_PAGE = 20
MIN_IMAGE_AREA_RATIO = 0.20
MAX_FILE_BYTES = 25 * 1024 * 1024
FILE_MAGIC = "%PDF-"
ERROR_MAX_CHARS = 500
ERROR_PATH_MASK = "<pdf-volume>"
OUTLINE_CHARS = 100
SEARCH_CHARS = 140
REPORT_PAGE_ROWS = 50
RECENT_FETCHED = 25
RECENT_SHOWN = 5
LIST_LIMIT_DEFAULT = 100
LIST_LIMIT_MAX = 200
RATE_WINDOW_SECONDS = 60
RATE_BUDGET_GENERAL = 120
RATE_BUDGET_UPLOAD = 15
RATE_BUDGET_USER_UPLOAD = 10
MAX_ATTEMPTS = 3
STALL_TIMEOUT_MINUTES = 15
RETENTION_DAYS = 30

# ---- job states
PENDING, PROCESSING, COMPLETED, FAILED, CANCELLED = (
    "pending",
    "processing",
    "completed",
    "failed",
    "cancelled",
)
STATUSES = [PENDING, PROCESSING, COMPLETED, FAILED, CANCELLED]
LIVE_STATUSES = [PENDING, PROCESSING]
