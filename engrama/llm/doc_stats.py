"""Counts over whole texts that quality rules and classifiers use, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import arrow_text as at

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Byte classes: 0 space, 1 newline, 2 lower, 3 upper, 4 digit, 5 symbol, 6 full stop, 7 comma, 8 ! and ?, 9 other ASCII, 10 lead byte, 11 continuation byte
CLASS = np.full(256, 9, np.uint8)
CLASS[list(b" \t\r\x0b\x0c")] = 0
CLASS[10] = 1
CLASS[ord("a") : ord("z") + 1] = 2
CLASS[ord("A") : ord("Z") + 1] = 3
CLASS[ord("0") : ord("9") + 1] = 4
CLASS[SYMBOLS] = 5
CLASS[ord(".")], CLASS[ord(",")] = 6, 7
CLASS[list(b"!?")] = 8
CLASS[0x80:0xC0] = 11
CLASS[0xC0:] = 10
CLASSES = 12

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_shouts", "n_stops", "n_doubled", "n_bytes")
COUNT_TYPES = ", ".join(f"{c} long" for c in COUNTS)
REPEAT = 5


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the marked bytes each text has."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the keys found twice or more, and of those equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    same[:-1] |= same[1:]
    twice[order] = same
    return twice, later


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    texts = len(offsets) - 1
    solid, kind = ~at.IS_SPACE[data], CLASS[data]
    starts, ends = at.spans(solid, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    word = at.hashes(data, starts, ends)
    out = {"n_words": np.bincount(doc, minlength=texts), "word_chars": per_text(solid & (kind != 11), offsets), "n_symbols": per_text(SYMBOLS[data], offsets)}

    line_starts, line_ends = at.spans(data != 10, offsets)
    sums = np.concatenate([[0], np.cumsum(solid)])
    has_word = sums[line_ends] > sums[line_starts]
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    tag = at.mix(np.arange(texts, dtype=np.uint64) + at.U(0x51ED))
    _, later = repeated(at.mix(at.hashes(data, line_starts, line_ends) ^ tag[line_doc]))
    out["n_dup_lines"], out["n_lines"] = np.bincount(line_doc[later], minlength=texts), np.bincount(line_doc, minlength=texts)

    again = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    out["n_doubled"] = np.bincount(doc[1:][again], minlength=texts)

    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= REPEAT:
        window = at.grams(word, REPEAT)
        inside = doc[REPEAT - 1 :] == doc[: len(window)]
        where = np.flatnonzero(inside)
        twice, _ = repeated(at.mix(window[where] ^ tag[doc[where]]))
        np.add.at(covered, where[twice], 1)
        np.add.at(covered, where[twice] + REPEAT, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered)[:-1] > 0], minlength=texts)
    for name, cls in (("n_upper", 3), ("n_lower", 2), ("n_digits", 4), ("n_shouts", 8), ("n_stops", 6)):
        out[name] = per_text(kind == cls, offsets)
    out["n_bytes"] = np.diff(offsets)
    return out


def count_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, text: str = "text") -> Iterator[pa.RecordBatch]:
    """For each row its columns but the text, and COUNTS; schema is that of the result."""
    for b in batches:
        column = b.column(b.schema.get_field_index(text))
        for lo, hi, data, offsets in at.chunks(column):
            found, rest = counts(data, offsets), b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], pa.int64()) if f.name in found else rest.column(b.schema.get_field_index(f.name)).cast(f.type) for f in schema], schema=schema)


#: Features of the text view: shares of byte classes and class pairs, and repetition.
TEXT_FEATURES = CLASSES * CLASSES + 7


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of TEXT_FEATURES numbers for each text: square roots of shares of pairs of byte classes, then ratios of COUNTS."""
    texts, kind, n = len(offsets) - 1, CLASS[data].astype(np.int64), counts(data, offsets)
    before = np.empty_like(kind)
    if len(kind):
        before[1:], before[0] = kind[:-1], 1
        first = offsets[:-1]
        before[first[first < len(kind)]] = 1  # a text begins as a line does
    doc = np.repeat(np.arange(texts), np.diff(offsets))
    pairs = np.bincount((doc * CLASSES + before) * CLASSES + kind, minlength=texts * CLASSES * CLASSES).reshape(texts, -1)
    size, w = np.maximum(np.diff(offsets), 1)[:, None], np.maximum(n["n_words"], 1)
    ratios = [np.log1p(n["n_words"]) / 8, n["word_chars"] / w / 10, np.minimum(n["n_symbols"] / w, 2), n["n_dup_lines"] / np.maximum(n["n_lines"], 1), n["n_repeat_words"] / w, n["n_doubled"] / w, n["n_upper"] / np.maximum(n["n_upper"] + n["n_lower"], 1)]
    return np.hstack([np.sqrt(pairs / size), np.stack(ratios, 1)]).astype(np.float32)
