"""Schemas of the pipeline's records."""

from __future__ import annotations

WRITEUP = (
    "source string, url string, challenge_title string, challenge_name string, challenge_category array<string>, "
    "challenge_source string, content string, cleaned_content string"
)
TRICK = (
    "technique_name string, title string, category string, description string, conditions array<string>, "
    "implementation_steps array<string>, key_code string, example string, example_challenge string, "
    "detection_signs array<string>, source_writeups array<string>, original_terms array<string>, confidence double, created_at string"
)
CHUNK = "chunk_id string, technique_name string, section_title string, content string, token_count int"
QUESTION = "q_id string, technique_name string, question_text string"
