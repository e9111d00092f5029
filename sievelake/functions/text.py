"""Scalar functions over text, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions.tables import KEYWORD_TAGS

WORD = r"[\p{L}\p{N}_]+"
_SPACE = r"[\s\u0085   -     　\x1c-\x1f]"

# --- Fixed values: tags too common to be a hint, acronyms, opposites ---
NOISY_TAGS = [
    "c", "c++", "sh", "shell", "web", "exploit", "python", "rev", "c#", "go", "rust", "lua", "java", "php", "perl", "ruby",
    "game", "aws", "cloud", "gcp", "azure", "docker", "k8s", "windows", "linux", "mobile", "x86", "x64", "arm", "mips",
    "injection", "pwn", "misc", "osint", "golang", "dotnet", "javascript", "js", "network", "fuzz", "cve", "browser",
]
ACRONYMS = [
    "sql", "xss", "ssti", "rsa", "xxe", "ssrf", "lfi", "rfi", "idor", "jwt", "cors", "csrf", "xpath", "ldap", "http",
    "dns", "xml", "cve", "osint", "lsb", "aes", "api", "ftp", "smtp", "tcp", "udp", "url", "cli", "gui", "json", "yaml",
    "wasm", "v8", "ptrace", "gdb", "ida", "ntfs", "iis",
]
ANTONYMS = {
    "overflow": "underflow", "encode": "decode", "encrypt": "decrypt", "obfuscate": "deobfuscate", "obfuscation": "deobfuscation",
    "compress": "decompress", "pack": "unpack", "zip": "unzip", "serialize": "deserialize", "serialization": "deserialization",
    "remote": "local", "read": "write", "patch": "unpatch", "sign": "verify",
}
# --- End of fixed values ---


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def normalise(text: Column) -> Column:
    """Runs of newlines, spaces and underscores shortened; link remains and URLs dropped, in that order."""
    for pattern, new in ((r"\n{3,}", "\n\n"), (r" {2,}", " "), (r"_{3,}", "---"), (r"\[(?:__|http[^\]]*)\]\([^)]*\)", ""), (r"http\S+", "")):
        text = F.regexp_replace(text, pattern, new)
    return text


#: White space of Python's str.strip but for the newline, which ends a line.
_INNER = _SPACE[:-1].replace(r"\s", r"\t\x0b\f\r ") + "]"
#: A line that is a rule or a bare URL, with the newline before it.
_NOISE = rf"(?:(?<![^\n])|\n){_INNER}*(?:[-_*](?:[\s&&[^\n]]|[-_*])+[-_*]|https?://[^\s]+){_INNER}*(?=\n|\z)"


def drop_noise_lines(text: Column) -> Column:
    """Without lines that are rules or bare URLs; blank lines closed up, ends stripped. One pass over the whole text."""
    return strip(F.regexp_replace(F.regexp_replace(text, _NOISE, ""), r"\n{3,}", "\n\n"))


def clean_text(text: Column) -> Column:
    return drop_noise_lines(normalise(F.coalesce(text, F.lit(""))))


def worthwhile(text: Column, least: int) -> Column:
    return F.length(strip(text)) >= least


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / chars_per_token).cast("int"))


def words(text: Column) -> Column:
    """Word tokens in order, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def keyword_pattern(keywords: list[str]) -> str:
    """One alternation, longest keyword first."""
    quoted = ["".join(c if c.isalnum() or c in " _" else "\\" + c for c in k) for k in sorted(keywords, key=len, reverse=True)]
    return r"\b(?:" + "|".join(quoted) + r")\b"


def keyword_hints(text: Column, table: dict[str, list[str]] | None = None, noisy: list[str] | None = None) -> Column:
    """Sorted distinct tags of the keywords in a text, without the noisy ones: one regex pass and a map lookup."""
    table = KEYWORD_TAGS if table is None else table
    entries = [x for k, tags in table.items() for x in (F.lit(k), F.array(*map(F.lit, tags)))]
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(keyword_pattern(list(table))), F.lit(0)))
    of = F.create_map(*entries)
    tags = F.flatten(F.transform(found, lambda k: F.try_element_at(of, k)))
    return F.array_sort(F.array_except(F.array_distinct(tags), F.array(*map(F.lit, NOISY_TAGS if noisy is None else noisy))))


def categorise(given: Column, hints: Column) -> Column:
    """The first category that is not blank, else the first hint, else 'uncategorized'."""
    first = F.filter(F.coalesce(given, F.array().cast("array<string>")), lambda c: strip(c) != "")
    return F.coalesce(F.lower(strip(F.get(first, F.lit(0)))), F.get(hints, F.lit(0)), F.lit("uncategorized"))


def clean_name(name: Column) -> Column:
    """A name in snake case, without parentheses."""
    return F.translate(strip(F.lower(name)), " -()", "__")


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct token arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over those of the smaller set; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def legacy_text_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two texts; 1 if both are empty or null, 0 if one is or has no words."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((x == "") & (y == ""), F.lit(1.0)).otherwise(jaccard(word_set(x), word_set(y)))


def legacy_list_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two lists of texts; 1 if both are empty or null, 0 if one is or has no words."""
    none = F.array().cast("array<string>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    both = jaccard(word_set(F.array_join(x, " ")), word_set(F.array_join(y, " ")))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(both)


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays, in double; 0 if either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(technique: Column, number: Column) -> Column:
    return F.concat(technique, F.lit("__c"), number.cast("string"))


def trick_id(technique: Column, title: Column) -> Column:
    return F.concat(technique, F.lit("::"), F.substring(F.sha1(title), 1, 10))


def title_case(name: Column) -> Column:
    """Snake case to title case; listed acronyms upper."""

    def word(w: Column) -> Column:
        rest = F.lower(F.substring(w, F.lit(2), F.length(w)))
        return F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), rest))

    return F.array_join(F.transform(F.split(name, "_"), word), " ")


def antonym_swap(a: Column, b: Column) -> Column:
    """Whether two snake-case names have equally many words and differ in exactly one, by an antonym."""
    of = F.create_map(*[F.lit(x) for pair in ANTONYMS.items() for x in pair])
    pairs = F.filter(F.arrays_zip(F.split(a, "_").alias("x"), F.split(b, "_").alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"]))
    same = F.size(F.split(a, "_")) == F.size(F.split(b, "_"))
    one = F.get(pairs, F.lit(0))
    swap = F.try_element_at(of, one["x"]).eqNullSafe(one["y"]) | F.try_element_at(of, one["y"]).eqNullSafe(one["x"])
    return same & (F.size(pairs) == 1) & swap


def word_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the word sets of two snake-case names."""
    x, y = F.array_distinct(F.split(a, "_")), F.array_distinct(F.split(b, "_"))
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def lcs_ratio(a: Column, b: Column) -> Column:
    """200 * LCS(a, b) / (len a + len b), by a fold over a that keeps one row of the table; for short, blocked pairs."""
    other = F.split(b, "")
    start = F.transform(F.concat(F.array(F.lit("")), other), lambda _: F.lit(0))

    def row(last: Column, c: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            diagonal, above = F.get(last, i - 1), F.get(last, i)
            left = F.element_at(acc, -1)
            return F.concat(acc, F.array(F.when(F.get(other, i - 1) == c, diagonal + 1).otherwise(F.greatest(above, left))))

        return F.aggregate(F.sequence(F.lit(1), F.size(other)), F.array(F.lit(0)), cell)

    table = F.aggregate(F.split(a, ""), start, row)
    total = F.length(a) + F.length(b)
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(total == 0, F.lit(100.0)).when(empty, F.lit(0.0)).otherwise(200.0 * F.element_at(table, -1) / total)


def python_title(text: Column) -> Column:
    """Each letter after a non-letter upper, the others lower, as str.title() does."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def infer_title(url: Column, text: Column) -> Column:
    """From the URL's last path segment, else the first line under 120 characters, else the URL."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.element_at(F.when(F.size(segments) > 0, segments), -1)
    named = F.when(last != "index", python_title(F.translate(last, "-_", "  ")))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: (strip(s) != "") & (F.length(strip(s)) < 120))
    first = strip(F.regexp_replace(strip(F.get(lines, F.lit(0))), "^#+", ""))
    return F.coalesce(named, first, url)


def masked_key(key: Column) -> Column:
    return F.when(F.coalesce(F.length(key), F.lit(0)) == 0, "(empty)").when(F.length(key) <= 10, "***").otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.right(key, F.lit(4))))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100, 1)).otherwise(F.lit(0.0))


def embed_text(title: Column, description: Column, most: int = 800) -> Column:
    return F.substring(strip(F.concat_ws(". ", title, description)), 1, most)


def significant_tokens(title: Column, least: int = 4) -> Column:
    return F.filter(word_set(title), lambda t: F.length(t) >= least)


def kept_questions(questions: Column, least: int = 8) -> Column:
    return F.filter(questions, lambda q: q.isNotNull() & (F.length(q) > least))


def prompt_block(number: Column, source: Column, title: Column, categories: Column, content: Column) -> Column:
    """One numbered document of a prompt."""
    kinds = F.when(F.size(categories) > 0, F.array_join(categories, ", ")).otherwise("unknown")
    n = number.cast("string")
    return F.concat(
        F.lit("<writeup_"), n, F.lit(">\nSource: "), source, F.lit("\nChallenge: "), title, F.lit("\nCategory: "), kinds,
        F.lit("\nContent:\n"), content, F.lit("\n</writeup_"), n, F.lit(">"),
    )
