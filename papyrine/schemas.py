"""Column types of the corpus tables."""

from __future__ import annotations

JOURNALS = "issn string, name string, field string, publisher string"
ARTICLES = (
    "doi string, title string, authors string, year int, journal_issn string, journal_name string, "
    "publisher string, created_at timestamp, updated_at timestamp"
)
PAGES = (
    "doi string, page_url string, html string, abstract string, pdf_url string, pdf_downloaded boolean, "
    "pdf_file_path string, match_score int, scraped_at timestamp, error_message string"
)
LOG = "id long, doi string, stage string, status string, error_message string, processed_at timestamp"
FILES = (
    "doi string, source string, source_url string, pdf_url string, pdf_file_path string, match_score double, "
    "downloaded_at timestamp, verify_status string, verify_method string, verify_score double, verify_model string, "
    "verify_reason string, verified_at timestamp"
)
CANDIDATES = (
    "doi string, source string, candidate_url string, pdf_url string, match_score double, status string, "
    "error_message string, checked_at timestamp"
)
PUBLISHED = (
    "doi string, bib_key string, source_page_path string, extraction_depth string, analyst_model string, "
    "verifier_model string, status string, error_message string, ingested_at timestamp"
)
RUNS = (
    "id long, run_id string, stage string, status string, detail string, started_at timestamp, finished_at timestamp"
)
