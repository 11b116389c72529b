"""License scan: exact phrases by words, and a fuzzy search for short notices.

Text is taken as UTF-8 with A-Z lower-cased. Words are runs of ``[0-9a-z]`` and non-ASCII characters.

The words of a text are joined by one blank, whatever separated them.

* Base: places where the words of a phrase of ``PHRASES`` stand consecutively.
* Fuzzy: a notice of ``NOTICES`` may differ by a few edits (its own ``e``). Split into e + 1 pieces, at least one
  piece stays exact in any such match (pigeonhole), so plain substring search for the pieces finds all candidate
  places; around each, the regex library's bounded-error matching decides and gives span and edits.

A document's score is 1 with a base phrase; else the best fuzzy match's 1 - edits / length; else 0.

Defined cases: a null text is empty (no words, no labels); texts are scanned whole, in slices of bounded size;
repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, slices

#: Phrase -> label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that the fuzzy search adds: (label, text, edits allowed).
NOTICES = [
    ("gpl", "gnu general public license", 3),
    ("apache", "licensed under the apache license", 3),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("cc-by", "creative commons attribution", 3),
    ("bsd", "redistribution and use in source and binary forms", 5),
    ("mpl", "mozilla public license", 2),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("unlicense", "free and unencumbered software released into the public domain", 5),
    ("reserved", "all rights reserved", 2),
]

#: Bytes that are no part of a word become blanks.
_BLANKED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def pieces(notice: str, edits: int) -> list[tuple[str, int]]:
    """``edits`` + 1 pieces of a notice of near equal length, and where they start."""
    cut = np.linspace(0, len(notice), edits + 2).astype(int).tolist()
    return [(notice[a:b], a) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    """Compiled searches; made once in each Python worker. Texts are told as their words, joined by one blank."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, int]] = NOTICES):
        self.base = [(label, b" " + p.encode() + b" ") for p, label in phrases.items()]
        self.fuzzy = [
            (label, len(n), e, [(s.encode(), at) for s, at in pieces(n, e)], regex.compile(rb"(?b)(?:" + regex.escape(n).encode() + rb"){e<=%d}" % e))
            for label, n, e in notices
        ]

    @staticmethod
    def words(text: str) -> list[bytes]:
        return text.encode("utf-8", "replace").lower().translate(_BLANKED).split()

    def base_places(self, plain: bytes) -> list[tuple[str, int]]:
        """(label, index of the first word) of each exact place."""
        padded, hits = b" " + plain + b" ", []
        for label, phrase in self.base:
            at = padded.find(phrase)
            while at >= 0:
                hits.append((label, at))
                at = padded.find(phrase, at + 1)
        if not hits:
            return hits
        blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 0x20)  # one before each word
        return list(zip([label for label, _ in hits], np.searchsorted(blanks, [at for _, at in hits]).tolist(), strict=True))

    def fuzzy_spans(self, plain: bytes) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, notice length) in bytes of ``plain``; of overlapping ones of a notice the first."""
        found = []
        for label, size, edits, seeds, pattern in self.fuzzy:
            windows = []
            for seed, at in seeds:
                hit = plain.find(seed)
                while hit >= 0:
                    windows.append((max(0, hit - at - edits), hit - at + size + edits))
                    hit = plain.find(seed, hit + 1)
            done = -1
            for low, high in sorted(windows):
                if high > done and (m := pattern.search(plain, max(low, done), high)):
                    found.append((label, m.start(), m.end(), sum(m.fuzzy_counts), size))
                    done = m.end()
        return found


SCANNED = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:int,stop:int,edits:int>>"


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    scanner = Scanner()
    span = pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())])
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    for batch in batches:
        out = []
        for texts in slices(batch):
            for text in texts:
                words = scanner.words(text)
                plain = b" ".join(words)
                base = scanner.base_places(plain)
                fuzzy = scanner.fuzzy_spans(plain)
                at = [i for _, i in base]
                labels = {label for label, _ in base}
                score = 1.0 if base else max((1 - e / n for *_, e, n in fuzzy), default=0.0)
                out.append({
                    "n_words": len(words), "n_base": len(base), "first_word": min(at, default=None), "last_word": max(at, default=None),
                    "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {x[0] for x in fuzzy})),
                    "score": score, "spans": [{"label": x[0], "start": x[1], "stop": x[2], "edits": x[3]} for x in fuzzy],
                })
        yield pa.array(out, kind)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the fields of ``SCANNED``; spans are offsets in the text with separators normalized to one space."""
    arrow_batches(docs.sparkSession)
    scan = F.arrow_udf(_scan, SCANNED)
    return docs.select(F.col(id_column).alias("doc_id"), scan(F.col(text_column)).alias("_s")).select("doc_id", "_s.*")
