"""Row shapes shared by all operators, as Spark DDL."""

MONEY_COLUMNS = ["total_charges", "ins_paid", "adjustment", "payments", "balance"]
MONEY_TYPE = "decimal(18,2)"

RECORD = (
    "struct<invoice_number:string,treatment_date:string,cpt_codes:array<string>,description:string,"
    "provider:string,insurers:array<string>,third_parties:array<string>,"
    + ",".join(f"{name}:{MONEY_TYPE}" for name in MONEY_COLUMNS)
    + ",page:string>"
)
RECORD_FIELDS = [
    "invoice_number", "treatment_date", "cpt_codes", "description", "provider", "insurers",
    "third_parties", *MONEY_COLUMNS, "page",
]
FLAG = "struct<row:int,fields:array<string>,reason:string,page:string,severity:string>"
RESULT = f"struct<records:array<{RECORD}>,flagged:array<{FLAG}>>"
PAGES = "doc_id string, page_num int, page_content string"
TOKEN_USAGE = "map<string,bigint>"

JOB_COLUMNS = {
    "id": "string",
    "owner_id": "string",
    "pdf_filename": "string",
    "pdf_path": "string",
    "status": "string",
    "content_hash": "string",
    "result": RESULT,
    "error": "string",
    "token_usage": TOKEN_USAGE,
    "cost_usd": "double",
    "processing_duration_seconds": "double",
    "attempts": "int",
    "started_at": "timestamp",
    "completed_at": "timestamp",
    "created_at": "timestamp",
    "updated_at": "timestamp",
}
JOBS = ", ".join(f"{name} {kind}" for name, kind in JOB_COLUMNS.items())
