"""Prompts: a system part that never changes, so that services can cache it, and the user's part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACT = (
    "You read write-ups of security competitions and note every reusable trick. Answer with a JSON array of objects with "
    "technique_name (snake case), title, category, description, conditions, implementation_steps, key_code, example, "
    "example_challenge, detection_signs, confidence (0 to 1) and source_indexes (numbers of the write-ups it is from). "
    "Answer [] where there is none, and nothing but the array."
)
QUESTIONS = (
    "You write the questions with which a competitor would look for a technique file. Answer with a JSON array of 6 to 12 "
    "short English questions: how to, when to and by symptom, each with the class of attack by name."
)
JUDGE = (
    "You are shown pairs of techniques or tricks. Answer with a JSON object whose `verdicts` lists, for each pair, its "
    "pair_id and a verdict: merge if both are the same, else keep."
)
_BEFORE, _AFTER = "List the tricks of these write-ups.\n\n<writeups>\n", "\n</writeups>"


def extraction_message(writeups: str) -> str:
    """The user's part for the numbered write-ups, whose text stays as it is."""
    return f"{_BEFORE}{writeups}{_AFTER}"


def extraction_prompt(writeups: Column) -> Column:
    """struct(system, user) of the numbered write-ups of a batch."""
    return F.struct(F.lit(EXTRACT).alias("system"), F.concat(F.lit(_BEFORE), writeups, F.lit(_AFTER)).alias("user"))
