"""Row types of the tables that the engine reads and writes."""

from __future__ import annotations

DOC_TYPES = ("10-K", "10-Q", "transcript")
QUARTERS = ("Q1", "Q2", "Q3", "Q4")
LABELS = ("Consistent", "Contradictory", "Unverifiable")
BUCKETS = ("both_ok", "nli_hallucination", "lucky_nli", "both_fail", "unverifiable_nli")

CHUNK = """
chunk_id string, ticker string, company_name string, doc_type string, fiscal_year int, fiscal_period string,
is_table boolean, section string, filing_date string, report_date string, quarter_period_label string,
quarter_months array<string>, subsection string, subsubsection string, speaker_name string, speaker_role string,
call_date string, text string
"""
INDEXED_CHUNK = CHUNK.rstrip() + ", global_id long"
CLAIM = """
claim_id string, ticker string, company_name string, fiscal_year int, fiscal_quarter string, speaker string,
claim string, intended_label string, is_golden_claim boolean, regenerate boolean
"""
GOLDEN = """
claim_id string, ticker string, company_name string, fiscal_year int, fiscal_quarter string, speaker string,
claim string, expected_nli_label string, is_in_filing boolean, is_in_table boolean, ground_truth_reference string
"""
JUDGMENT = "reasoning string, classification string, confidence_score double, matched_passage_index int"
SCORE = """
claim_id string, ticker string, fiscal_year int, fiscal_quarter string, expected string, predicted string,
nli_correct boolean, retrieval_hit boolean, bucket string, nli_confidence double,
matched_figures array<string>, missing_figures array<string>
"""
