"""Record, flag, cell and word schemas (as DDL), and the fixed values that results depend on."""

from __future__ import annotations

RECORD = (
    "record_id long, input_ord long, kind string, source string, date date, description string, payee string, "
    "amount decimal(18,2), deposit decimal(18,2), withdrawal decimal(18,2), balance decimal(18,2), category string, "
    "reference string, vendor string, tax decimal(18,2), subtotal decimal(18,2), total decimal(18,2), "
    "line_items array<string>, page int, confidence string, extra map<string,string>")
FLAG = ("source string, location string, field string, raw string, reason string, row_key string")
CELL = ("sheet string, row int, col int, vtype string, v_str string, v_num double, v_date date, formula string, number_format string, style_sig string")
WORD = ("source string, page int, word_id int, text string, x0 double, x1 double, top double, size double")

# --- fixed values -----------------------------------------------------------

MONEY_FIELDS = ("deposit", "withdrawal", "amount", "balance", "tax", "subtotal", "total")
TEXT_FIELDS = ("description", "payee", "category", "reference", "vendor", "source")
DATE_TOLERANCE_DAYS = 3
STRONG_SIMILARITY, WEAK_SIMILARITY = 0.55, 0.5
HEADER_ROWS, SAMPLE_ROWS, SAMPLES, ANCHOR_LINES = 30, 26, 5, 40
VENDOR_LINES, MOST_ITEMS, MOST_PROBLEMS, SCORED_ROWS = 12, 20, 12, 200
NOISE_TOKENS = (
    "POS", "PURCHASE", "PAYMENT", "TRANSACTION", "TXN", "TRN", "REF", "CARD", "DEBIT", "CREDIT", "VISA", "MASTERCARD",
    "AUTH", "PENDING", "ONLINE", "TRANSFER", "XX", "XXXX", "THE", "LTD", "LIMITED", "INC", "LLC", "CO")
SYNONYMS = {
    "date": ("transactiondate", "invoicedate", "postingdate", "posteddate", "date", "day"),
    "description": ("description", "details", "particulars", "narrative", "memo", "item", "notes", "note"),
    "payee": ("payee", "merchant", "paidto", "supplier", "customer", "name"),
    "vendor": ("vendor", "company", "supplier", "billedby", "vendorname", "companyname"),
    "category": ("category", "type", "class", "account", "costcentre", "costcenter", "expensetype"),
    "reference": ("reference", "ref", "invoiceno", "invoicenumber", "invoice", "chequeno", "checkno", "documentno", "docno",
                  "transactionid", "txnid", "number", "no"),
    "deposit": ("deposit", "deposits", "credit", "credits", "moneyin", "paidin", "in", "income", "received"),
    "withdrawal": ("withdrawal", "withdrawals", "debit", "debits", "moneyout", "paidout", "out", "expense", "expenses", "spend",
                   "payment", "payments"),
    "amount": ("amount", "netamount", "value", "sum", "net"),
    "balance": ("balance", "runningbalance", "closingbalance"),
    "tax": ("tax", "vat", "gst", "hst", "salestax", "taxamount"),
    "subtotal": ("subtotal", "netofvat", "amountbeforetax", "goods"),
    "total": ("total", "totalamount", "grandtotal", "amountdue", "totaldue", "invoicetotal", "gross"),
    "source": ("source", "sourcefile", "file", "document", "attachment"),
}
COLUMN_ROLES = {
    "date": "date", "posted": "date", "posting": "date", "transaction": "date", "value": "value_date",
    "description": "description", "details": "description", "particulars": "description", "narrative": "description",
    "payee": "description", "merchant": "description", "memo": "description", "reference": "reference", "ref": "reference",
    "cheque": "reference", "check": "reference", "category": "category", "type": "category", "debit": "withdrawal",
    "debits": "withdrawal", "withdrawal": "withdrawal", "withdrawals": "withdrawal", "payments": "withdrawal",
    "paid out": "withdrawal", "money out": "withdrawal", "credit": "deposit", "credits": "deposit", "deposit": "deposit",
    "deposits": "deposit", "paid in": "deposit", "money in": "deposit", "amount": "amount", "balance": "balance",
}
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".tif", ".tiff", ".heic")
#: A folder scan leaves .gif and .heic out; a file named explicitly is taken whatever its suffix.
FOLDER_SUFFIXES = (".pdf", ".json", ".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff")
CURRENCY = "$£€₹¥"
MONEY_PATTERN = (r"^(\()?\s*[$£€₹¥]?\s*([-+])?\s*(\d{1,3}(?:[,\s.]\d{3})*(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
                 r"\s*(\))?\s*([Cc][Rr]|[Dd][Rr]|-)?$")
#: Grouped by commas or not, with a point: what MONEY_PATTERN would read of it is the text without commas.
PLAIN_MONEY = r"^(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)(?:\.[0-9]{1,2})?\z"
MONEY_TOKEN = r"^\(?[$£€₹¥]?-?\d[\d,\s.]*\d?(?:[.,]\d{2})?\)?(?:\s?(?:[Cc][Rr]|[Dd][Rr]))?$"
CURRENCY_SHAPED = r"[$£€₹¥]|\d[.,]\d{2}\b|\(|\)|(?:[Cc][Rr]|[Dd][Rr])$"
REFERENCE_PATTERN = r"(?i)\b(?:REF|REFERENCE|CHQ|CHEQUE|CHECK|TXN|TRN)\b[:#\s]*([A-Z0-9-]{3,})\b"
YEAR_PATTERN = r"\b((?:19|20)\d{2})\b"
TOTAL_WORDS = r"(?i)\b(total|totals|sum|subtotal|balance c/?f|grand total|net)\b"
TOTAL_FORMULA = r"(?i)\b(SUM|SUBTOTAL|SUMIF|SUMIFS|COUNT|AVERAGE)\b"
NOT_A_LABEL = r"^[\d\s.,$£€%()+-]+$"
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
DATE_AT_START = (r"(?i)^\s*(\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?|\d{4}-\d{2}-\d{2}|\d{1,2}\s+MONTH(?:\s+\d{2,4})?"
                 r"|MONTH\s+\d{1,2}(?:,?\s+\d{2,4})?)").replace("MONTH", MONTH)
STATEMENT_NOISE = r"(?i)^\s*(page\s+\d+|continued|statement period|opening balance|closing balance|balance (brought|carried) forward|total\b|subtotal\b)"
STATEMENT_HINTS = (r"(?i)\b(statement|account\s*(?:number|no|summary)|sort\s*code|opening\s*balance|closing\s*balance"
                   r"|balance\s*(?:brought|carried)\s*forward|withdrawals?|deposits?|transactions?|iban|routing)\b")
INVOICE_HINTS = (r"(?i)\b(invoice|bill\s*to|remit\s*to|due\s*date|purchase\s*order|subtotal|vat|gst|tax\s*invoice"
                 r"|payment\s*terms|amount\s*due)\b")
DATED_ROW = r"(?m)^\s*\d{1,4}[/-]\d{1,2}[/-]\d{1,4}"
INVOICE_NUMBER = (r"(?i)\b(?:(?:invoice|inv|bill|document)\s*(?:number|no\.?|num|#)?\s*[:#]\s*"
                  r"|(?:invoice|inv)\s*(?:number|no\.?|#)\s+)([A-Za-z0-9][A-Za-z0-9/_-]{2,})")
DATE_LABEL = r"(?i)\b(invoice\s*date|date\s*of\s*issue|issue\s*date|bill\s*date|dated|date)\b\s*[:#]?\s*(.{4,30})"
OTHER_DATE = r"(?i)\b(due|payment|period|delivery|service)\s*date\b|\bdue\b"
TOTAL_LABELS = (
    ("total", r"(?i)\b(?:total\s*due|amount\s*due|balance\s*due|grand\s*total|invoice\s*total|total)\b"),
    ("tax", r"(?i)\b(?:vat|gst|hst|sales\s*tax|tax)\b"),
    ("subtotal", r"(?i)\b(?:sub[\s-]*total|net\s*(?:amount|total)?|amount\s*before\s*tax)\b"),
)
ITEM_HEADER = r"(?i)\b(description|item|details|service|product|qty|quantity)\b"
#: Words in lower case of which a text has one if the pattern is found in it: looking for these is much cheaper.
NEEDED = {DATE_LABEL: ("date",), ITEM_HEADER: ("description", "item", "details", "service", "product", "qty", "quantity"),
          **dict(zip((p for _, p in TOTAL_LABELS), (("total", "due"), ("vat", "gst", "hst", "tax"), ("total", "net", "tax"))))}
VENDOR_NOISE = r"(?i)^\s*(invoice|tax invoice|bill|statement|receipt|proforma)\s*$"
MONEY_ROLES = ("withdrawal", "deposit", "amount", "balance")
INVOICE_ONLY, BANK_ONLY = ("vendor", "tax", "subtotal", "total"), ("deposit", "withdrawal", "balance")
NO_AMOUNT = "Without an amount nothing can be compared."
#: Widths by which the outermost statement columns reach beyond their captions (half of each counts).
LEFT_MARGIN, RIGHT_MARGIN, LEAST_OVERLAP = 40.0, 60.0, 0.25
