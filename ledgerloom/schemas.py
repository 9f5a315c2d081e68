"""Explicit schemas of the inputs. Statement sections are one struct that holds the fields of all variants, all nullable."""

from __future__ import annotations

CASH_ITEM = "account_id string, account_name string, available double, blocked double, in_transit double, total double"
FIXED_ITEM = "instrument_id string, instrument_type string, issuer string, issue_date date, maturity_date date, purchase_date date, face_rate double, negotiated_rate double, valuation_rate double, rate_basis string, payment_frequency string, nominal_value double, market_value double"
TX_ITEM = "`date` date, value_date date, description string, reference string, category string, debit double, credit double, balance_after double, currency string"
SECTION = (
    f"section_type string, title string, subtotal double, items array<struct<{', '.join((CASH_ITEM, FIXED_ITEM, TX_ITEM))}>>, fund struct<name string, code string, administrator string, objective string>, "
    "movements struct<previous_balance double, additions double, withdrawals double, returns double, new_balance double, units double, unit_value_end double, currency string>, "
    "historical_returns struct<monthly double, semi_annual double, ytd double, last_year double, last_2_years_annualized double, last_3_years_annualized double>, "
    "account_id string, account_type string, currency string, totals struct<debits double, credits double, net double, ending_balance double>"
)
STATEMENT = (
    "schema_version string, extraction_metadata struct<extracted_at string, source_file string, source_type string, page_count int, extraction_method string, confidence_global double, needs_review boolean, warnings array<string>>, "
    "issuer struct<name string, type string, nit string, country string>, account_holder struct<full_name string, id_type string, id_number string, address string, city string, phone string, email string, advisor struct<name string, email string, phone string>>, "
    "period struct<start_date date, end_date date, issue_date date>, currency string, summary struct<total_assets double, total_liabilities double, net_worth double, previous_balance double, period_change double, period_change_pct double>, "
    f"alerts_raw array<string>, raw_extracted_text string, sections array<struct<{SECTION}>>"
)
HISTORY = "fecha_extracto date, total_portafolio double, renta_fija double, fic double, efectivo double, rendimiento_fic_mensual double, tasa_valoracion_promedio double"
TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, `left` int, top int, width int, height int, conf double, text string"
