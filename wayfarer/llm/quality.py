"""Quality rules by line-first cleaning.

Each line of a document is judged on its own by three groups of rules, the lines that fail are removed, and a document
that loses too much of its text is rejected. Nothing is shuffled: every row is decided where it is read.

Defined results: null or empty texts, and texts without words, have zero counts and fail (fewer words than the minimum).
Null ids pass through. Repeated rows give repeated results. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfarer.llm.common import SPACES, slices, texts

SYMBOLS = "#*$%&|<>"
#: Fixed phrases of page furniture, in lower case.
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|(?:we|site) uses? cookies|accept (?:all )?cookies|"
    r"click here|read more|sign (?:in|up)\b|log ?in\b|subscribe (?:to|now)|enable javascript|lorem ipsum|skip to (?:main )?content|"
    r"back to top|share (?:this|on)|follow us|copyright ©|©|powered by"
)
_MARKS = re.compile(rf"[{re.escape(SYMBOLS)}]")


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of a line's words, but lost_share, which is of the document's word characters."""

    min_words: int = 50
    repeat_percent: int = 50
    marked_share: float = 0.3  #: punctuation: words that hold a symbol
    shouted_share: float = 0.5  #: punctuation: words that end in ! or ? twice, or a line in capitals with such words
    separator_share: float = 0.15  #: navigation: words that are nothing but a separator
    boilerplate_words: int = 30  #: boilerplate: a phrase counts in lines of at most so many words
    lost_share: float = 0.5


_SEPARATORS = frozenset({"|", "||", ">", ">>", "»", "«", "·", "•", "/", "::", "→", "-", "–"})


def line_fails(words: list[str], line: str, rules: Rules = Rules()) -> str | None:
    """The rule that a line with these words fails, or None."""
    n = len(words)
    if _MARKS.search(line) is not None:
        if sum(1 for w in words if w in _SEPARATORS) > rules.separator_share * n:
            return "navigation"
        if sum(1 for w in words if _MARKS.search(w) is not None) > rules.marked_share * n:
            return "punctuation"
    elif n > 3 and sum(1 for w in words if w in _SEPARATORS) > rules.separator_share * n:
        return "navigation"
    if ("!!" in line or "??" in line) and sum(1 for w in words if w.endswith(("!!", "??"))) > rules.shouted_share * n:
        return "punctuation"
    if n <= rules.boilerplate_words and BOILERPLATE.search(line.lower()) is not None:
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, the first finding included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    tri = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    tri ^= tri >> np.uint64(29)
    tri = tri * np.uint64(0xBF58476D1CE4E5B9) + h[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(tri)
    s = tri[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    dup = np.zeros(n - 2, bool)
    dup[order[1:][same]] = True
    dup[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= dup
    hit[1:-1] |= dup
    hit[2:] |= dup
    return int(hit.sum())


def judge(text: str, rules: Rules = Rules()) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the text without the lines that fail."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    seen: set[str] = set()
    dups = lost = 0
    left = []
    for line in text.split("\n"):
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w] if not line.isascii() else line.translate(_BLANK).split(" ") if _odd(line) else line.split()
        own = [w for w in own if w]
        if not own:
            left.append(line)
            continue
        if again := line in seen:
            dups += 1
        seen.add(line)
        if again or line_fails(own, line, rules):
            lost += sum(map(len, own))
        else:
            left.append(line)
    failed = n < rules.min_words or 100 * repeats > rules.repeat_percent * n
    return n, chars, symbols, dups, repeats, failed, not failed and lost <= rules.lost_share * chars, "\n".join(left)


_BLANK = {ord(c): " " for c in SPACES}


def _odd(line: str) -> bool:
    """True if str.split() would also separate at the four ASCII separators that are no white space here."""
    return not line.isprintable() and any(c in line for c in "\x1c\x1d\x1e\x1f")


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row per document: base counts, verdicts and, if with_text, the cleaned text of kept documents (else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = list(zip(*[judge(t, rules) for t in texts(b)], strict=True))
            out = [b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:7])]
            if with_text:
                out.append(pa.array([t if k else None for k, t in zip(cols[6], cols[7], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=_NAMES[: len(out)])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", cleaned string" * with_text)


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
