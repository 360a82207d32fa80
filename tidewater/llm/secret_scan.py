"""Operator 10: scan whole texts for secrets: fixed patterns plus a token-efficiency test.

Natural words cost a byte-pair vocabulary few tokens, random strings many: a candidate
run of key characters whose characters-per-token ratio lies below ``RATIO`` is taken for
a random string.  Known digests (plain hex of MD5, SHA-1, SHA-2 length) and identifiers
(UUIDs, numbers and dates, names whose parts cost as few tokens as words) are not candidates; the fixed patterns
report digests anyway.  Strings of letters alone are candidates like others.  Of a candidate
that touches a fixed pattern, the parts outside it are tested.

Defined cases: a null text is an empty one (no spans); spans are in code points, end
exclusive; kinds at one start are in the order assign, access, hex, random; rows are
independent, so repeated rows repeat their result; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, small_batches

#: Kinds in their order, patterns and the characters each needs at least.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A random string has fewer characters per token than this.
RATIO = 2.2
#: Random strings hold at least so many different characters.
DISTINCT = 8
#: Least length of a candidate, or of its part beside a known span; characters that join the two.
LEAST, JOINS = 16, "+/_=-"
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
#: Letter parts of a name, and the characters a token at which they read as words.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORDLIKE = 2.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def identifier(s: str, tokens_in) -> bool:
    """Numbers and dates, and names whose letter parts read as words."""
    parts = PARTS.findall(s)
    letters = sum(map(len, parts))
    return letters <= 2 or letters >= WORDLIKE * tokens_in(" " + " ".join(parts).lower())


def left_over(start: int, end: int, known: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of start .. end that no ``known`` span (in order) covers."""
    for a, _, b in known:
        if a >= end:
            break
        if b <= start:
            continue
        if a > start:
            yield start, a
        start = b
    if start < end:
        yield start, end


def random_spans(text: str, tokens_in, known: Iterable[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """Candidates that cost many tokens, or what the ``known`` spans leave of them; ``tokens_in(s)`` counts tokens."""
    out, known = [], sorted(known)
    for m in CANDIDATE.finditer(text):
        for a, b in left_over(m.start(), m.end(), known):
            s = text[a:b]
            if len(s) < LEAST or len(set(s)) < DISTINCT:
                continue
            bare = s.lstrip(JOINS) if a > m.start() else s  # what joined it to a known span
            bare = bare.rstrip(JOINS) if b < m.end() else bare
            if DIGEST.fullmatch(bare) or UUID.fullmatch(bare):
                continue
            if len(s) < RATIO * tokens_in(s) and not identifier(s, tokens_in):
                out.append((a, 3, b))
    return out


def all_spans(text: str, tokens_in) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return base + random_spans(text, tokens_in, base)


def spelled(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def token_counter(vocabulary: str):
    """Tokens of a short string under a tiktoken rank file on every worker."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(coder.encode_ordinary(s))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every covered stretch replaced by one mask."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def scan(spark: SparkSession, documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans per document."""
    small_batches(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_in = token_counter(vocabulary or default_vocabulary())
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = random_spans(text or "", tokens_in, base)
                n = [sum(k == kind for _, kind, _ in base) for k in range(3)]
                rows.append((*n, len(more), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return documents.select(column(documents, "doc_id").cast("long").alias("doc_id"),
                            column(documents, "text").alias("text")).mapInArrow(task, schema)


def redact(spark: SparkSession, documents: DataFrame, vocabulary: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of a text masked; n_chars follows the text."""
    small_batches(spark)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens_in = token_counter(vocabulary or default_vocabulary())
        for texts in batches:
            yield texts.map(lambda t: t if t is None else redacted(t, all_spans(t, tokens_in), mask))

    out = documents.withColumn("text", clean(column(documents, "text")))
    if "n_chars" in documents.columns:
        changed = F.col("text").isNotNull() & F.col("n_chars").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
