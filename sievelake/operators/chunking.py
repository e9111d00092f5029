"""Markdown files to sections and chunks, and back from sections to records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.config import SETTINGS, Settings
from sievelake.functions.text import chunk_id, trick_id, word_set
from sievelake.storage import map_texts

_FENCE = re.compile(r"```.*?```", re.S)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def sections(content: str) -> list[tuple[str, str]]:
    """(title, text) at each '## ' heading outside fenced blocks; what comes before the first is 'overview'."""
    fenced = [m.span() for m in _FENCE.finditer(content)]
    heads, at = [], 0
    for line in content.split("\n"):
        if line.startswith("## ") and not any(a < at < b for a, b in fenced):
            heads.append(at)
        at += len(line) + 1
    starts = heads if heads[:1] == [0] else [0, *heads]
    stops = [*(s - 1 for s in starts[1:]), len(content)]
    texts = [content[a:b] for a, b in zip(starts, stops, strict=True)]
    return [(text.split("\n", 1)[0][3:].strip() if start in heads else "overview", text) for start, text in zip(starts, texts, strict=True)]


def overlap_tail(text: str, size: int) -> str:
    """The end of a chunk that the next one repeats: from the last line break, else the last space, of its last `size` characters."""
    if len(text) <= size:
        return text
    for mark in ("\n", " "):
        at = text.rfind(mark, len(text) - size)
        if at > 0:
            return text[at + 1 :]
    return text[-size:]


def _pack(parts: list[str], limit: int, overlap: int, glue: str, too_long=None) -> list[str]:
    """Parts joined up to the limit; each new chunk begins with the overlap of the one before."""
    out: list[str] = []
    held = ""
    for part in parts:
        if too_long and len(part) > limit:
            out += [held] * bool(held) + too_long(part)
            held = ""
        elif held and len(held) + len(part) > limit:
            out.append(held)
            held = overlap_tail(held, overlap) + glue + part
        else:
            held = held + glue + part if held else part
    return out + [held] * bool(held)


def split_section(text: str, settings: Settings = SETTINGS) -> list[str]:
    """One chunk if it fits, else packed paragraphs, of which overlong ones are packed sentences."""
    limit, overlap = settings.chunk_chars, settings.overlap_chars
    if len(text) <= limit:
        return [text]
    return _pack(text.split("\n\n"), limit, overlap, "\n\n", lambda p: _pack(_SENTENCE.split(p), limit, overlap, " "))


def chunk_files(files: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """chunk_id, technique_name, section_title, content, token_count of files (name, content); ids count through a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number = 0
                for title, text in sections(content or ""):
                    for part in split_section(text, settings):
                        rows.append((name, number, title, part.strip(), max(1, len(part) // settings.chars_per_token)))
                        number += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["technique_name", "n", "section_title", "content", "token_count"])

    found = map_texts(files.select("name", "content"), run, "technique_name string, n int, section_title string, content string, token_count int")
    return found.select(chunk_id(F.col("technique_name"), F.col("n")).alias("chunk_id"), "technique_name", "section_title", "content", "token_count")


def trick_sections(files: DataFrame) -> DataFrame:
    """technique, n, title, section: split at each '\\n## ', fences or not; text before the first heading goes."""
    split = files.select(F.col("name").alias("technique"), F.posexplode(F.split("content", r"\n(?=## )", -1)).alias("n", "section"))
    return split.where(F.col("section").startswith("## ")).withColumn("title", F.trim(F.substring(F.substring_index("section", "\n", 1), 4, 1_000_000)))


_PARSED = (
    "description string, conditions array<string>, implementation_steps array<string>, key_code string, example string, "
    "detection_signs array<string>, example_challenge string"
)


def parse_section(section: str) -> tuple:
    """The fields of a rendered section, in the order of _PARSED."""
    plain = {"Description:": 0, "Example challenge:": 6}
    blocks = {"Implementation:": 2, "Key code/payload:": 3, "Example:": 4, "Detection signs:": 5}
    out: list = ["", [], [], None, None, [], None]
    filling: int | None = None
    fence: list[str] | None = None
    for line in section.splitlines()[1:]:
        bare = line.strip()
        if line.startswith("```"):
            if fence is None:
                fence = []
            else:
                if filling is not None:
                    out[filling] = "\n".join(fence).strip() or None
                fence = filling = None
        elif fence is not None:
            fence.append(line)
        elif bare in blocks:
            filling = blocks[bare]
        elif bare.startswith("Conditions:"):
            out[1] = [c.strip() for c in bare[11:].split(";") if c.strip()]
            filling = None
        elif label := next((p for p in plain if bare.startswith(p)), None):
            out[plain[label]] = bare[len(label) :].strip()
            filling = None
        elif bare.startswith("- ") and filling in (2, 5):
            out[filling].append(bare[2:].strip())
    return tuple(out)


def parse_tricks(files: DataFrame) -> DataFrame:
    """id, technique, title, the parsed fields, content and the word sets of title and content of each section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = list(zip(*(parse_section(s) for s in batch.column(3).to_pylist()), strict=True)) or [[]] * 7
            types = [pa.list_(pa.string()) if "array" in f else pa.string() for f in _PARSED.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p, t) for p, t in zip(parsed, types, strict=True))], names=[*batch.schema.names, *(f.split()[0] for f in _PARSED.split(", "))])

    cut = trick_sections(files).select("technique", "n", "title", "section")
    found = map_texts(cut, run, f"technique string, n int, title string, section string, {_PARSED}")
    ident = trick_id(F.col("technique"), F.col("title")).alias("id")
    content = F.trim(F.col("section")).alias("content")
    return found.select(ident, "*", content, word_set(F.col("title")).alias("title_tokens"), word_set(F.col("section")).alias("content_tokens")).drop("section")
