"""Byte-level BPE over Arrow batches with the tokenizers library: ids, offsets, and exact decoding.

The vocabulary writes each byte as a printable character (``byte_characters``), so a token's bytes are its
characters mapped back. With them, ids decode to bytes by table lookup, a token's byte and character spans are
running sums of lengths, and a token that splits a character is seen by its first byte being a continuation.

Speed: a text is cut before single blanks and line feeds between characters that are no white space. The
splitting pattern of the vocabulary always ends a match there, and between a letter or digit and a mark, so that the
pieces' ids, one after another, are the text's ids. The pieces of a slice of texts are told apart by Arrow; each
different one is encoded once, many at a time as one joined text that is taken apart by byte lengths, and takes its
places in the texts again. Nothing is kept from slice to slice. Texts with other white space are encoded as they are.

Defined cases: a null text is the empty one and has no ids; strings of special tokens are ordinary text;
repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, slices, trimmed

#: Rows and characters of a slice of texts that is encoded together, and bytes of pieces encoded as one text.
ROWS = 8192
TEXT_BYTES = 12 << 20
JOINED_BYTES = 8 << 10

#: White space other than blank and line feed; texts with any of it are encoded as they are.
_RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_HEAD = re.compile("[^ \n]*")
MARKS = rf"(?P<marks>[{re.escape(string.punctuation)}]*)\z"


def odd_blanks(text: str) -> bool:
    """Whether white space stands at an end or next to other white space, or is of a rare kind."""
    return not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _RARE_SPACE)


def default_json() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    for i, b in enumerate(sorted(set(range(256)) - set(plain))):
        table[chr(0x100 + i)] = b
    return table


def _gather(ids: np.ndarray, size: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the runs at ``places`` of ``ids``, which has runs of ``size``, one after another; and their sizes."""
    found = size[places]
    ends = np.cumsum(found)
    return ids[np.repeat((np.cumsum(size) - size)[places] - ends + found, found) + np.arange(ends[-1] if len(ends) else 0)], found


class Codec:
    """A tokenizer file with its byte tables; one in each Python worker. With ``special`` the file's special tokens get their
    own ids where a text spells them, as the library does unless told otherwise; else they are text like any other."""

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        alphabet = byte_characters()
        vocabulary = self.tokenizer.get_vocab()
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # special tokens are no byte-level text
            table[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.table = table
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.begins = np.r_[0, np.cumsum(self.lengths)]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.decimals = [str(i) for i in range(len(table))]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, each with what stands before it, one after another, and how many each has."""
        full = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise("", pieces, " "))
        ends = np.cumsum(pc.binary_length(full).to_numpy(), dtype=np.int64)
        if not len(ends):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.r_[0, ends]
        cuts = offsets[np.r_[np.searchsorted(ends, np.arange(0, ends[-1], JOINED_BYTES)), len(ends)]].tolist()
        raw = full.buffers()[2].to_pybytes()[: ends[-1]]
        ids = np.concatenate(self._plain([raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False) if b > a]))
        return ids, np.diff(np.r_[0, np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1])

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """As _joined; marks after a letter or digit at a piece's end are encoded once for all pieces."""
        core = pc.utf8_rtrim(pieces, string.punctuation)
        marked = pc.and_(pc.less(pc.binary_length(core), pc.binary_length(pieces)), pc.utf8_is_alnum(pc.utf8_slice_codeunits(core, -1)))
        core = pc.if_else(marked, core, pieces).dictionary_encode()
        marks = pc.extract_regex(pieces.filter(marked), MARKS).field("marks").dictionary_encode()
        ids, size = self._joined(core.dictionary)
        found = [np.zeros(0, np.uint32), *self._plain(marks.dictionary.to_pylist())]
        places = np.full((len(pieces), 2), len(size), np.int64)
        places[:, 0] = core.indices.to_numpy()
        places[marked.to_numpy(zero_copy_only=False), 1] += 1 + marks.indices.to_numpy()
        ids, size = np.concatenate([ids, *found]), np.r_[size, [len(x) for x in found]]
        ids, size = _gather(ids, size, places.ravel())
        return ids, size.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        odd = np.fromiter((odd_blanks(t) or any(s in t for s in self.special) for t in texts), bool, len(texts))
        even = pa.array([t for t, o in zip(texts, odd, strict=True) if not o], pa.string())
        cut = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
        # the first piece has no blank before it and is encoded on its own
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = np.diff(cut.offsets.to_numpy()) - 1
        parts = cut.flatten()
        rest = np.ones(len(parts), bool)
        rest[cut.offsets.to_numpy()[:-1]] = False
        parts = parts.filter(pa.array(rest)).dictionary_encode()
        heads = self._plain([t if o else _HEAD.match(t)[0] for t, o in zip(texts, odd, strict=True)])
        ids, size = _gather(*self._pieces(parts.dictionary), parts.indices.to_numpy())
        stops = np.r_[0, np.cumsum(size)][np.cumsum(counts)].tolist()
        return [np.concatenate([h, ids[a:b]]) for h, a, b in zip(heads, [0, *stops], stops, strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; characters that tokens split come together again."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        if not total:
            return b""
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(self.begins[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end character of each token in the decoded text, and whether it starts inside a character.

        A token that splits a character gets the span that covers it.
        """
        raw = np.frombuffer(self.decode(ids), np.uint8)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        leads = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
        if not len(raw):
            return starts, ends, np.zeros(len(ids), bool)
        return leads[starts] - 1, leads[ends - 1], (raw[starts] & 0xC0) == 0x80


@functools.cache
def codec(path: str, special: bool = False) -> Codec:
    return Codec(path, special)


def _round_trip(path: str):
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_split"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for batch in batches:
            rows = []
            for texts in slices(batch, TEXT_BYTES):
                for ids in c.encode(texts):
                    decimal = " ".join(map(c.decimals.__getitem__, ids.tolist()))
                    raw = c.decode(ids)
                    first = c.bytes[c.begins[ids]] if len(ids) else ids
                    rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), int(((first & 0xC0) == 0x80).sum())))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)

    return run


def token_digests(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split (tokens that start inside a character)."""
    arrow_batches(docs.sparkSession, ROWS)
    digest = F.arrow_udf(hinted(trimmed(_round_trip(path or default_json()))), "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_split bigint")
    return docs.select(F.col(id_column).alias("doc_id"), digest(F.col(text_column)).alias("_t")).select("doc_id", "_t.*")


def hinted(f):
    """Arrow UDFs read their kind from the function's hints."""
    f.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return f


def encoded(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", ids_as: str = "ids", offsets: bool = False) -> DataFrame:
    """``docs`` with the ids of the text as an array column, and with ``offsets`` its tokens' character spans."""
    arrow_batches(docs.sparkSession, ROWS)
    path = path or default_json()

    def run(batches):
        c = codec(path)
        for batch in batches:
            found = [ids for texts in slices(batch, TEXT_BYTES) for ids in c.encode(texts)]
            ids = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
            spans = [c.offsets(x) if offsets else (None, None) for x in found]
            yield pa.StructArray.from_arrays([ids, *(pa.array([s[i] for s in spans], pa.list_(pa.int32())) for i in (0, 1))], ["ids", "starts", "ends"])

    out = docs.withColumn("_e", F.arrow_udf(hinted(run), "ids array<int>, starts array<int>, ends array<int>")(F.col(text_column)))
    out = out.withColumn(ids_as, F.col("_e.ids"))
    return (out.withColumns({f"{ids_as}_starts": F.col("_e.starts"), f"{ids_as}_ends": F.col("_e.ends")}) if offsets else out).drop("_e")


def decoded(df: DataFrame, path: str | None = None, ids_column: str = "ids", bytes_as: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its array of ids."""
    path = path or default_json()

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pa.array([None if x is None else c.decode(np.array(x, np.int64)) for x in batch.to_pylist()], pa.binary())

    return df.withColumn(bytes_as, F.arrow_udf(hinted(run), "binary")(F.col(ids_column)))
