"""Operator 5: secrets in texts, by patterns and by how badly a tokenizer compresses a string.

A vocabulary learnt on ordinary text needs many tokens for a random string. A run of key characters with
few characters per token is reported, unless it is a digest of a known length, a UUID or an identifier made
of words of the vocabulary. A run that is not reported may hold a random string between separators.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from duskboard.llm.frames import kept_in_worker
from duskboard.llm.spans import Span, scan

BASE = ("assign", "access", "hex")
ORDER = {kind: i for i, kind in enumerate((*BASE, "random"))}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters of the shortest random string.
LEAST = 20
#: A word of an identifier has so many characters per token or more; random letters have about 1.7.
WORD_RATIO = 3
#: Lengths of common digests in hex digits: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
RUNS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: A long string is encoded in parts of so many characters.
PART = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(text: str) -> bool:
    """A digest, a UUID or a number."""
    if UUID.fullmatch(text) or not re.search(r"[A-Za-z]", text):
        return True
    return len(text) in DIGEST_LENGTHS and bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text))


def is_identifier(text: str, tokens: Callable[[str], int]) -> bool:
    """Half of it are words, and its numbers are short. A run of letters is a word if it takes few tokens."""
    runs = RUNS.findall(text)
    if any(len(r) > 4 for r in runs if r.isdigit()):
        return False
    needed = (r for r in runs if len(r) >= 4 and not r.isdigit())
    words = sum(len(r) for r in needed if min(tokens(r), tokens(" " + r.lower())) <= len(r) // WORD_RATIO)
    return 2 * words >= len(text)


def random_parts(text: str, tokens: Callable[[str], int], ratio: float) -> list[tuple[int, int, float]]:
    """Start, end and characters per token of the random strings in a run of key characters: the run itself, else
    what stands between its separators, of LEAST characters or more."""
    out: list[tuple[int, int, float]] = []
    todo = [(0, text, "=/-_+")]
    while todo:
        start, own, separators = todo.pop()
        if len(own) < LEAST or is_known(own):
            continue
        each = len(own) / tokens(own)
        if each < ratio and not is_identifier(own, tokens):
            out.append((start, start + len(own), each))
        elif separators:
            todo += [(start + m.start(), m[0], separators[1:]) for m in re.finditer(f"[^{re.escape(separators[0])}]+", own)]
    return sorted(out)


def finder(vocabulary: str, ratio: float) -> Callable[[str], list[Span]]:
    encoding = kept_in_worker(("tiktoken", vocabulary), lambda: _encoding(vocabulary))

    def tokens(text: str) -> int:
        return sum(len(encoding.encode_ordinary(text[i : i + PART])) for i in range(0, len(text), PART))

    def find(text: str) -> list[Span]:
        out: list[Span] = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [("assign", m.start(), m.end(), 0.9) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            out += [("access", m.start(), m.end(), 0.95) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
        longest = max(map(len, text.split()), default=0)
        if longest >= 16:
            out += [("hex", m.start(), m.end(), 0.6) for m in HEX.finditer(text)]
        if longest >= LEAST:
            for m in RANDOM.finditer(text):
                for a, b, each in random_parts(m[0], tokens, ratio):
                    out.append(("random", m.start() + a, m.start() + b, min(1.0, ratio / each / 2)))
        return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))

    return find


def find_secrets(docs: DataFrame, vocabulary: str, ratio: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets per row, by start: assignments, access keys and hex strings by pattern, and "random"
    strings with fewer than ``ratio`` characters per token. See ``spans.scan`` for nulls, repeats and extra columns.
    An assignment's span is the whole assignment. Kinds may overlap."""
    return scan(docs, lambda: finder(vocabulary, ratio), id_col, text_col)
