"""The base counts against brute force; line rules on planted lines."""

import re
from collections import Counter

import pytest

from tests.llm.util import odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


@pytest.mark.parametrize("odd", [False, True])
def test_counts(spark, odd):
    from wayfarer.llm.quality import quality_rules

    docs = odd_docs(spark) if odd else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r)[:7] for r in quality_rules(docs).collect()), key=str)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)


PHRASES = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "we uses cookies", "site use cookies", "site uses cookies", "accept cookies", "accept all cookies", "click here", "read more",
    "subscribe to", "subscribe now", "enable javascript", "lorem ipsum", "skip to content", "skip to main content", "back to top", "share this", "share on", "follow us", "copyright \u00a9", "\u00a9", "powered by",
]


def brute_kept(text):
    """The verdict by plain loops over lines, words and phrases."""
    text = text or ""
    n, chars, _, _, repeats, failed = brute(text)
    seen, lost = set(), 0
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        separators = sum(w in ("|", "||", ">", ">>", "\u00bb", "\u00ab", "\u00b7", "\u2022", "/", "::", "\u2192", "-", "\u2013") for w in words)
        marked = [w for w in words if set(w) & set("#*$%&|<>")]
        low = line.lower()
        phrase = any(p in low for p in PHRASES) or re.search(r"sign (in|up)(?!\w)|log ?in(?!\w)", low)
        bad = separators > 0.15 * len(words) and (marked or len(words) > 3) or len(marked) > 0.3 * len(words)
        bad = bad or sum(w[-2:] in ("!!", "??") for w in words) > 0.5 * len(words) or len(words) <= 30 and phrase
        if bad or line in seen:
            lost += sum(map(len, words))
        seen.add(line)
    return not failed and lost <= 0.5 * chars


@pytest.mark.parametrize("odd", [False, True])
def test_kept(spark, odd):
    from wayfarer.llm.quality import quality_rules

    docs = odd_docs(spark) if odd else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = [(r["doc_id"], brute_kept(r["text"])) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["kept"]) for r in quality_rules(docs).collect()), key=str) == sorted(text, key=str)
    assert odd or 0 < sum(k for _, k in text) < len(text)


def test_empty(spark):
    from wayfarer.llm.quality import quality_rules

    assert quality_rules(odd_docs(spark, [])).collect() == []


PROSE = "The old mill by the river was rebuilt in the spring and opened again to the people of the valley who came with bread and songs"
CASES = [
    (None, PROSE), ("navigation", "Home | News | Sport | Contact | About"), ("punctuation", "buy### now*** cheap$$$ pills%%%"), ("punctuation", "WIN!! BIG!! TODAY!!"),
    ("boilerplate", "Copyright © 2020 All rights reserved"), (None, "A line with one & sign among many other words of plain text"),
]


@pytest.mark.parametrize(("rule", "line"), CASES)
def test_line_rules(rule, line):
    from wayfarer.llm.quality import line_fails

    assert line_fails(line.split(), line) == rule


def test_verdict():
    from wayfarer.llm.quality import judge

    lines = [" ".join(f"{w}{k}" for w in PROSE.split()) for k in range(8)]
    *_, failed, kept, left = judge("\n".join([lines[0], "Home | News | Sport | Contact", *lines[1:], lines[2]]))
    assert (failed, kept) == (False, True)
    assert left == "\n".join(lines)
    spam = [" ".join(f"{a}### {b}" for a, b in zip(line.split(), line.split()[1:], strict=False)) for line in lines]
    assert judge("\n".join(spam))[6] is False
