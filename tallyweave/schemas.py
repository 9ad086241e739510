"""Explicit schemas of the engine's tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 6)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, INT, TEXT, TIME, FLAG = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType(), T.BooleanType()

LEDGER = _struct(
    id=LONG, provider=TEXT, source_file_name=TEXT, source_file_sha=TEXT, event_timestamp=TIME, ingestion_timestamp=TIME, asset_type=TEXT, symbol=TEXT, isin=TEXT, asset_name=TEXT,
    action=TEXT, quantity=MONEY, unit_price=MONEY, currency=TEXT, fees=MONEY, total_amount=MONEY, fx_rate=MONEY, local_total_amount=MONEY, tax_year=INT, account_country=TEXT,
    additional_metadata=TEXT, verification_status=TEXT, consensus_log=TEXT, openfigi_detected=TEXT,
)
STAGED = T.StructType([*LEDGER.fields, T.StructField("approved_financial_record_id", LONG)])
CHUNKS = _struct(
    id=LONG, document_name=TEXT, document_sha=TEXT, jurisdiction=TEXT, source_type=TEXT, confidence_level=TEXT, page_number=INT, text_content=TEXT, chunk_index=INT, parent_chunk_id=LONG,
    parent_text_content=TEXT, created_at=TIME, embedding=T.ArrayType(T.FloatType()),
)
MERGERS = _struct(id=LONG, old_isin=TEXT, new_isin=TEXT, old_symbol=TEXT, new_symbol=TEXT, effective_date=TIME, exchange_ratio=MONEY, old_nav=MONEY, new_nav=MONEY, created_at=TIME)
MANIFEST = _struct(id=LONG, file_sha=TEXT, file_name=TEXT, provider=TEXT, account_country=TEXT, status=TEXT, transaction_count=INT, error_message=TEXT, processed_at=TIME)
INCOME = _struct(id=LONG, tax_year=INT, jurisdiction=TEXT, income_type=TEXT, source_document_sha=TEXT, payload_json=TEXT, created_at=TIME)
STAGED_INCOME = _struct(
    id=LONG, tax_year=INT, jurisdiction=TEXT, income_type=TEXT, source_document_sha=TEXT, source_file_name=TEXT, payload_json=TEXT, voter_outputs_json=TEXT, discrepancies_json=TEXT,
    verification_status=TEXT, approved_tax_income_record_id=LONG, created_at=TIME,
)
PROFILES = _struct(id=LONG, tax_year=INT, fiscal_residence_country=TEXT, domicile_country=TEXT, residency_type=TEXT, marginal_tax_rate=T.DecimalType(5, 4), notes=TEXT)
CLASSIFICATIONS = _struct(isin=TEXT, asset_name=TEXT, tax_regime=TEXT, domicile_country=TEXT, is_ucits=FLAG, classification_source=TEXT, notes=TEXT, created_at=TIME, updated_at=TIME)
REMITTANCES = _struct(id=LONG, financial_record_id=LONG, remittance_date=TIME, amount_eur=MONEY, notes=TEXT, created_at=TIME)
INCOME_PAYLOAD = _struct(
    income_type=TEXT, tax_year=INT, employer_name=TEXT, employer_registration_number=TEXT, employment_id=TEXT, start_date=TEXT, end_date=TEXT, gross_pay_eur=MONEY, pay_for_income_tax_eur=MONEY,
    income_tax_paid_eur=MONEY, taxable_benefits_eur=MONEY, pay_for_usc_eur=MONEY, usc_paid_eur=MONEY, lpt_deducted_eur=MONEY, prsi_paid_eur=MONEY, employer_prsi_paid_eur=MONEY,
    prsi_classes=T.ArrayType(_struct(prsi_class=TEXT, insurable_weeks=INT)), prsi_class=TEXT, prsi_weeks=INT,
)
EXTRACTION = _struct(
    event_date=TIME, asset_type=TEXT, symbol=TEXT, isin=TEXT, action=TEXT, quantity=MONEY, unit_price=MONEY, currency=TEXT, fees=MONEY, total_amount=MONEY, fx_rate=MONEY, asset_name=TEXT, provider=TEXT
)
MESSAGE = _struct(id=TEXT, role=TEXT, content=TEXT, timestamp=TEXT, tool_calls=TEXT, usage=TEXT)
SESSION = _struct(id=TEXT, title=TEXT, created_at=TEXT, updated_at=TEXT, messages=T.ArrayType(MESSAGE), _corrupt_record=TEXT)

#: The words that columns of a kind may hold.
ACTIONS = ("buy", "sell", "dividend", "tax_payment", "salary_payout", "corporate_action")
ASSET_TYPES = ("stock", "etf", "cash", "tax_payment", "salary", "pension")
STATUSES = ("pending_verification", "pending_approval", "verified", "approved", "escalated_to_user")
REGIMES = ("cgt_standard", "exit_tax", "offshore_distributing", "offshore_non_distributing", "etc_commodity")
RESIDENCIES = ("resident_domiciled", "resident_non_domiciled", "non_resident")
