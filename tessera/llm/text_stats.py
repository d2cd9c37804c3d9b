"""Statistics of whole texts, from their UTF-8 bytes."""

from __future__ import annotations

from operator import eq

import numpy as np

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARKS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"

#: Names of ``describe``'s values, in order.
FEATURES = (
    "log_words", "word_length", "marks", "exclaims", "upper", "digits", "distinct", "stutter",
    "distinct_pairs", "same_lines", "stops", "line_words",
)


def _count(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def words_of(text: bytes) -> list[bytes]:
    """Runs without space, tab, line feed, vertical tab, form feed, return."""
    return text.split()


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    codes: dict = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in windows])
    often = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(often)] |= often
    return int(covered.sum())


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return len(lines), len(lines) - len(set(lines))


def rule_counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, marks, repeated lines, repeated words, lines."""
    words = words_of(text)
    inside = sum(map(len, words)) - _count(text, bytes(range(0x80, 0xC0)))
    lines, again = repeated_lines(text)
    return len(words), inside, _count(text, _MARKS), again, repeated_words(words), lines


def describe(text: bytes) -> tuple[float, ...]:
    """Features of a text's form; an empty text gives zeros."""
    words = words_of(text)
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = sum(map(len, words))
    letters = max(1, size - _count(text, bytes(range(0x80, 0xC0))))
    lines, again = repeated_lines(text)
    pairs = len(set(zip(words, words[1:])))
    return (
        float(np.log1p(n)), letters / n, float(np.log1p(_count(text, _MARKS) / n)), float(np.log1p(text.count(b"!") / n)),
        _count(text, _UPPER) / letters, _count(text, _DIGIT) / letters, len(set(words)) / n**0.8,
        sum(map(eq, words, words[1:])) / n, pairs / max(1, n - 1), again / max(1, lines),
        (text.count(b". ") + text.count(b".\n") + text.count(b",")) / n, float(np.log1p(n / max(1, lines))),
    )
