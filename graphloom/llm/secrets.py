"""Secret scans: three base patterns and a token-efficiency test.

The test encodes each long run of key-like characters with a tiktoken vocabulary. Words and names of any language that the vocabulary has seen take
few tokens; random strings take a token for every one or two characters. Known digests, UUIDs, numbers and identifiers built from words are left out
first, whether they are whole runs or parts of one.
"""

from __future__ import annotations

import base64
import functools
import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "inefficient")

#: Runs that the test looks at, and the most characters per token of a random one.
RUN_LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MOST_CHARS_PER_TOKEN = 2.0
#: Characters per token, at least, of the pieces of an identifier, each encoded by itself.
WORD_CHARS_PER_TOKEN = 2.5
#: Most that the mean logarithm of the places of its pairs of letters is in a word of an unknown language; 9.1 in random letters.
WORD_PAIR_RANK = 8.25
#: A name that a key may be glued to: its length at most, and its characters per token at least; and the rank of pairs above which what follows is no word.
NAME_MOST, NAME_CHARS_PER_TOKEN, NOISE_PAIR_RANK, NEAR_LEAST = 48, 3.5, 8.4, 1.15
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
WITHIN_UUID = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern.removeprefix('(?i)')}(?![A-Za-z0-9])", re.IGNORECASE)
#: Parts of a run between separators, and the least length of one that is taken for a word.
PART, WORD_LEAST = re.compile(r"[A-Za-z0-9+]+"), 4
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@functools.cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def pair_ranks(vocabulary: str) -> dict[str, float]:
    """Logarithm of the place in the vocabulary of each pair of letters, and under "" that of a pair it lacks."""
    enc = encoding(vocabulary)
    pairs = {a + b: enc._mergeable_ranks.get((a + b).encode()) for a in string.ascii_lowercase for b in string.ascii_lowercase}
    return {"": math.log(enc.n_vocab)} | {x: math.log(n + 1) for x, n in pairs.items() if n is not None}


def chars_per_token(run: str, vocabulary: str) -> float:
    return len(run) / len(encoding(vocabulary).encode_ordinary(run))


def is_identifier(run: str, vocabulary: str) -> bool:
    """Whether a run consists of words by the vocabulary: pieces of letters of three on average, cheap in tokens taken one by one, or made of
    pairs of letters that the vocabulary has early (words it doesn't know), with few digits."""
    pieces = PIECE.findall(run)
    letters = [x for x in pieces if not x[0].isdigit()]
    size = sum(map(len, letters))
    if not size or size < 3 * len(letters) or 5 * (sum(map(len, pieces)) - size) > size:
        return False
    if size >= WORD_CHARS_PER_TOKEN * sum(len(encoding(vocabulary).encode_ordinary(x)) for x in letters):
        return True
    rank = pair_ranks(vocabulary)
    pairs = [rank.get(x[k : k + 2], rank[""]) for x in map(str.lower, letters) for k in range(len(x) - 1)]
    return bool(pairs) and sum(pairs) <= WORD_PAIR_RANK * len(pairs)


def is_known(run: str, vocabulary: str) -> bool:
    """Whether a run is a number, a digest of a known length, a UUID, or an identifier."""
    if not re.search("[A-Za-z]", run) or UUID.fullmatch(run) or (len(run) in DIGEST_LENGTHS and re.fullmatch(r"(?i)[0-9a-f]+", run)):
        return True
    return is_identifier(run, vocabulary)


def is_name(text: str, vocabulary: str) -> bool:
    """Whether a run's beginning is a name as programs have them: words that the vocabulary knows, each a token or nearly so."""
    pieces = PIECE.findall(text)
    return text.isascii() and text.isalpha() and all(len(x) >= 2 for x in pieces) and len(text) >= NAME_CHARS_PER_TOKEN * sum(len(encoding(vocabulary).encode_ordinary(x)) for x in pieces)


def is_noise(text: str, vocabulary: str, ratio: float) -> bool:
    """Whether the rest of such a run is no word of any language and takes many tokens."""
    if is_known(text, vocabulary) or chars_per_token(text, vocabulary) > ratio:
        return False
    letters = [x for x in PIECE.findall(text) if not x[0].isdigit()]
    rank = pair_ranks(vocabulary)
    pairs = [rank.get(x[k : k + 2], rank[""]) for x in map(str.lower, letters) for k in range(len(x) - 1)]
    return not pairs or sum(pairs) > NOISE_PAIR_RANK * len(pairs) or 4 * len(letters) > len(text)


def random_stretches(run: str, vocabulary: str, ratio: float) -> list[tuple[int, int, float]]:
    """(start, end, characters per token) of what is random in a run without base spans.

    Words, digests and UUIDs in it are cut off at separators; what lies between them is tested together, as keys hold separators too, and if that isn't random,
    each of its parts. If nothing is found so, the run is tested as a whole."""

    def test(a: int, b: int) -> list[tuple[int, int, float]]:
        part = run[a:b]
        if b - a < RUN_LEAST or is_known(part, vocabulary):
            return []
        per_token = chars_per_token(part, vocabulary)
        return [(a, b, per_token)] if per_token <= ratio else []

    def behind_name(a: int, b: int) -> list[tuple[int, int, float]]:
        """What is random behind a name of cheap words that it is glued to: of all such places the first that leaves hardly more characters per token than any."""
        tries = []
        for at in range(a + WORD_LEAST, min(b - RUN_LEAST, a + NAME_MOST) + 1):
            if is_name(run[a:at], vocabulary) and is_noise(run[at:b], vocabulary, ratio):
                tries.append((chars_per_token(run[at:b], vocabulary), at))
        near = [(at, b, x) for x, at in tries if x <= NEAR_LEAST * min(tries)[0]]
        return near[:1]

    def is_cut(part: str) -> bool:
        if len(part) in DIGEST_LENGTHS and re.fullmatch("(?i)[0-9a-f]+", part):
            return True
        return len(part) >= WORD_LEAST and is_identifier(part, vocabulary)

    whole = [(m.start(), m.end()) for m in WITHIN_UUID.finditer(run)]
    parts = [(m.start(), m.end()) for m in PART.finditer(run) if not any(a <= m.start() < b for a, b in whole)]
    stretches: list[list[tuple[int, int]]] = [[]]
    for a, b in parts:
        if is_cut(run[a:b]) or (stretches[-1] and any(stretches[-1][-1][1] <= x < a for x, _ in whole)):
            stretches.append([])
        if not is_cut(run[a:b]):
            stretches[-1].append((a, b))
    found = []
    for x in filter(None, stretches):
        end = x[-1][1] + len(re.match("=*", run[x[-1][1] :])[0])  # padding
        found += test(x[0][0], end) or [y for a, b in x for y in test(a, b)]
    if not found:
        found = [y for a, b in parts for y in behind_name(a, len(run)) or behind_name(a, b)]
    return found or (test(0, len(run)) if not whole else [])


def find_spans(text: str | None, vocabulary: str, ratio: float = MOST_CHARS_PER_TOKEN) -> list[tuple[int, int, int, float | None]]:
    """(start, place in KINDS, end, characters per token) of every secret, sorted; offsets in code points. Null and empty texts have none."""
    if not text:
        return []
    spans: list[tuple[int, int, int, float | None]] = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if not (runs := list(RUN.finditer(text))):  # the other kinds lie within runs
        return spans
    spans += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if any(len(m[0]) >= HEX_LEAST for m in runs):
        spans += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    base = list(spans)
    for m in runs:
        at = m.start()
        for a, b in [*sorted((a, b) for a, _, b, _ in base if a < m.end() and m.start() < b), (m.end(), m.end())]:
            if a - at >= RUN_LEAST:
                spans += [(at + x, 3, at + y, r) for x, y, r in random_stretches(text[at:a], vocabulary, ratio)]
            at = max(at, b)
    return sorted(spans, key=lambda x: x[:2])


def redact(text: str, spans: list[tuple[int, int, int, float | None]], mark: str = "[SECRET]") -> str:
    """text with each span, or group of overlapping spans, replaced by mark."""
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, ratio: float = MOST_CHARS_PER_TOKEN, with_redacted: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, spans (kind, start, end, chars_per_token) and, with with_redacted, redacted: the text with its secrets replaced.

    Null texts have no spans and stay null. Repeated rows are scanned each. An empty table gives an empty result. Other columns aren't read.
    Nothing is shuffled.
    """
    vocabulary = vocabulary or default_vocabulary()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chars_per_token", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = [find_spans(x, vocabulary, ratio) for x in texts]
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "chars_per_token": r} for a, k, b, r in x] for x in found]
                out = {"doc_id": part.column("doc_id"), "spans": pa.array(rows, span)}
                if with_redacted:
                    out["redacted"] = pa.array([redact(x, y) if y else x for x, y in zip(texts, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, spans array<struct<kind string, start long, end long, chars_per_token double>>" + ", redacted string" * with_redacted)


def redacted_documents(docs: DataFrame, text: str = "text", length: str = "n_chars", vocabulary: str | None = None) -> DataFrame:
    """docs with the secrets of each text replaced, and `length`, where there is such a column, set to the code points of each text that changed."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                spans = [find_spans(x, vocabulary) for x in texts]
                if any(spans):
                    clean = [redact(x, y) if y else x for x, y in zip(texts, spans, strict=True)]
                    at = part.schema.get_field_index(text)
                    part = part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))
                    if (at := part.schema.get_field_index(length)) >= 0:
                        sizes = [len(x) if y else n for x, y, n in zip(clean, spans, part.column(at).to_pylist(), strict=True)]
                        part = part.set_column(at, part.schema.field(at), pa.array(sizes, part.schema.field(at).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
