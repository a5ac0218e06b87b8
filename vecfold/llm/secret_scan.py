"""Secret scan: fixed patterns, and strings that a tokenizer's vocabulary finds hard to spell.

Text that a byte-pair vocabulary has seen costs few tokens; random keys cost one token for two
characters or fewer. Runs of key characters that mix letters and digits are tokenized, and a
run with few characters a token is reported unless its form is that of a known digest or identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm.texts import whole

# Fixed patterns and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

# What the token test looks at: runs of key characters, long enough and with letters and digits.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
MOST_CHARS_PER_TOKEN = 2.2
# Known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 in hex) and identifiers (UUID, dates in paths and names).
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
IDENTIFIER = re.compile(
    r"(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|sha(?:1|256|384|512)[-=][A-Za-z0-9+/=]+"
    r"|[A-Za-z]*(?:[_/-][A-Za-z]+)*(?:[_/-][0-9]+)+(?:[_/-][A-Za-z]+)*)",
    re.IGNORECASE,
)


@lru_cache
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-pair vocabulary of a ``.tiktoken`` file, with the splitting pattern of its family."""
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; matches that are too short still use up their text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a run of 24 or more is a whole run: a shorter start of it would have been longer
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def random_spans(text: str, encoding: tiktoken.Encoding, most: float = MOST_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs with at most ``most`` characters per token."""
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if not MIXED.match(run) or DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
            continue
        if len(run) <= most * len(encoding.encode_ordinary(run)):
            found.append((m.start(), 3, m.end()))
    return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_texts(texts, path: str, most: float = MOST_CHARS_PER_TOKEN) -> pd.DataFrame:
    encoding = encoder(path)
    rows = []
    for text in texts:
        base = base_spans(text)
        counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
        more = random_spans(text, encoding, most)
        digest = hashlib.sha256(spelled(base).encode()).hexdigest()
        rows.append((*counts, digest, spelled(sorted(base + more))))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, path: str, most: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per row of ``docs``.

    A null text counts as empty and has no spans. Offsets are code points of the whole text, ends
    exclusive. ``path`` names a ``.tiktoken`` file that every executor has.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        return scan_texts(texts, path, most)

    return docs.select("doc_id", scanned(whole()).alias("of")).select("doc_id", "of.*")


def mask(text: str, spans: list[tuple[int, int, int]], label: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced, one label for each stretch."""
    parts, at = [], 0
    stretches: list[list[int]] = []
    for start, _, end in sorted(spans):
        if stretches and start < stretches[-1][1]:
            stretches[-1][1] = max(end, stretches[-1][1])
        else:
            stretches.append([start, end])
    for start, end in stretches:
        parts += [text[at:start], label]
        at = end
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, path: str, most: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """``docs`` with secrets masked in ``text`` (null stays null) and ``n_chars`` counted again."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        encoding = encoder(path)
        return pd.Series([
            None if t is None else mask(t, base_spans(t) + random_spans(t, encoding, most)) for t in texts
        ], dtype=object)

    out = docs.withColumn("text", cleaned(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
