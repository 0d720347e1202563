"""BPE encoding by backtracking over Aho-Corasick longest matches, and decoding by an offset table.

A token sequence is the one that merging in rank order gives if and only if each token is what merging gives for its own
string, and each two neighbours are compatible: merging their joined string gives just these two. So the encoder takes the
longest token at each place (one pass of an Aho-Corasick automaton), checks it against its left neighbour in a table of
compatible pairs, and goes back to the next shorter token where the check fails. A place from which no way led on is marked
and never tried again, so the work is linear in the text.

Nulls are empty texts; an empty text has no ids. Texts of any length are worked through in slices.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import regex

from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Cache

#: White space by Unicode's property White_Space (fixed values).
SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0                　"
#: The pattern of the byte-level pre-tokenizer (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Added to the last character of a word's end, where the vocabulary marks ends of words.
END = 0x1000
#: Entries of a generation of each cache: two workers of an executor then hold less than 1 GB at most.
CACHED = 600_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Encoder:
    """A vocabulary file of the tokenizers library (kind BPE, byte level) as automaton, pair table and offset table."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = bool(suffix)
        self.byte_char = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.born: dict[str, int] = {}
        inner = lambda t: t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + END) if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
        for i, (a, b) in enumerate(merges):
            a, b = inner(a), inner(b)
            self.rank.setdefault((a, b), i)
            if a + b not in self.parts:
                self.parts[a + b], self.born[a + b] = (a, b), i
        self.ids = {inner(t): i for t, i in self.vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1 or t in self.parts:  # what no merge makes is never a token of a text
                self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.shorter = Cache(self._shorter, len(self.ids) + 1)
        self.pairs = Cache(lambda pair: self._compatible(*pair), CACHED)
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.size = len(self.names)
        if self.words:
            from tokenizers import Tokenizer

            self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            library = Tokenizer.from_file(path)
            self.normal, self.parted = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
            self.chunks = Cache(self._chunk, CACHED)
            self.pieces = Cache(self._word, CACHED)
            self.decoded = Offsets([n + " " for n in self.names])
        else:
            self.pattern = regex.compile(BYTE_LEVEL)
            self.chunks = Cache(self._piece, CACHED)
            back = {c: b for b, c in enumerate(byte_characters())}
            self.decoded = Offsets([bytes(back[c] for c in t) if i not in self.special.values() else t.encode() for i, t in enumerate(self.names)])
        self.decimal = Offsets([f"{i} " for i in range(len(self.names))])

    def _compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined string leaves this border: no pair across it is merged while both its parts exist. At each
        border, the left parts are the chain of right children of `left`, from its last character on, and likewise on the right."""
        ends, starts = [left], [right]
        while ends[-1] in self.parts:
            ends.append(self.parts[ends[-1]][1])
        while starts[-1] in self.parts:
            starts.append(self.parts[starts[-1]][0])
        never, i, j = len(self.rank) + 1, len(ends) - 1, len(starts) - 1
        while True:
            gone_l = self.born[ends[i - 1]] if i else never
            gone_r = self.born[starts[j - 1]] if j else never
            m = self.rank.get((ends[i], starts[j]))
            if m is not None and m < gone_l and m <= gone_r:
                return False
            if not i and not j:
                return True
            if gone_l <= gone_r:
                i -= 1
            else:
                j -= 1

    def _shorter(self, token: str) -> str | None:
        """The longest token that is a proper prefix of a token."""
        for size in range(len(token) - 1, 0, -1):
            if token[:size] in self.automaton:
                return token[:size]
        return None

    def unsafe(self) -> list[tuple[str, str]]:
        """Pairs of tokens that are compatible although their joined string is a token."""
        known = [t for t in self.ids if len(t) == 1 or t in self.parts]
        splits = ((t[:i], t[i:]) for t in known for i in range(1, len(t)))
        return [(a, b) for a, b in splits if a in self.automaton and b in self.automaton and self._compatible(a, b)]

    def merge(self, word: str) -> list[int]:
        """Ids of one word in byte characters (its last one shifted by END where the vocabulary marks ends)."""
        found = [t for _, t in self.automaton.iter_long(word)]
        pairs, ids = self.pairs, self.ids
        for k in range(1, len(found)):
            if not pairs[found[k - 1], found[k]]:
                found = self._backtrack(word, found[:k], found[k])
                break
        return [ids[t] for t in found]

    def _backtrack(self, word: str, out: list[str], token: str | None) -> list[str]:
        """Goes on from `out`, whose pairs are all compatible, with `token` or the next shorter one at the place after it."""
        pairs, shorter, longest = self.pairs, self.shorter, self.automaton.iter_long
        at, end, dead = sum(map(len, out)), len(word), bytearray(len(word) + 1)
        while True:
            while token is not None and (dead[at + len(token)] or (out and not pairs[out[-1], token])):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += len(token)
                if at == end:
                    return out
                token = next(longest(word, at))[1]
            else:
                dead[at] = 1
                last = out.pop()
                at -= len(last)
                token = shorter[last]

    def _word(self, word: str) -> bytes:
        """Ids of a word in byte characters."""
        return array("I", self.merge(word[:-1] + chr(ord(word[-1]) + END))).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """A run without white space. No normal form and no token reaches over white space. Normal form, case and classes of other
        letters than ASCII are the library's own, as its version of Unicode is not Python's."""
        if chunk.isascii() and chunk.isprintable():
            chunk = chunk.lower()
            if chunk.isalpha():
                return self.pieces[chunk]
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))
        return b"".join([self.pieces[p] for p, _ in self.parted(self.normal(chunk))])

    def _piece(self, piece: str) -> bytes:
        return array("I", self.merge(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.byte_char))).tobytes()

    def _ordinary(self, text: str) -> bytes:
        if not self.words:
            return b"".join(map(self.chunks.__getitem__, self.pattern.findall(text)))
        if CONTROLS.search(text):  # str.split() also splits at these, which aren't white space
            return b"".join(map(self.chunks.__getitem__, filter(None, SPACES.split(text))))
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def blocks(self, text: str | None, size: int = 1 << 19):
        """Ids of a text as little-endian unsigned 32-bit bytes, in blocks."""
        at = 0
        text = text or ""
        for m in self.special_re.finditer(text) if self.special_re and "<|" in text else ():
            yield from self._sliced(text[at : m.start()], size)
            yield np.array([self.special[m[0]]], dtype="<u4").tobytes()
            at = m.end()
        yield from self._sliced(text[at:] if at else text, size)

    def _sliced(self, text: str, size: int):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > size and (m := CUT.search(text, at + size)):  # a letter, a space or line feed, a letter: tokens begin at the white space
                end = m.start() + 1
            yield self._ordinary(text[at:end])
            at = end

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.blocks(text)), dtype="<u4")

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False): token strings joined by a space, or the bytes of byte-level tokens."""
        out = self.decoded.gather(np.asarray(ids, dtype=np.int64))
        return (out[:-1] if self.words else out).decode("utf-8", "replace")

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """The number of ids, sha256 of the ids in decimal joined by spaces, sha256 of the decoded text."""
        ids_hash, text_hash, n, rest, a, b = hashlib.sha256(), hashlib.sha256(), 0, [], b"", b""
        for block in self.blocks(text):
            ids = np.frombuffer(block, dtype="<u4").astype(np.int64)
            if not len(ids):
                continue
            n += len(ids)
            ids_hash.update(a)
            a = self.decimal.gather(ids)
            if self.words:
                text_hash.update(b)
                b = self.decoded.gather(ids)
            else:
                rest.append(ids)
        ids_hash.update(a[:-1])
        if self.words:
            text_hash.update(b[:-1])
        else:
            text_hash.update(self.decode(np.concatenate(rest) if rest else []).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


class RankEncoder(Encoder):
    """The same ids by a compiled merge loop, for operators that need ids fast and not by this module's method.

    That loop merges any two neighbours whose joined bytes are a token, lowest id first. This gives the ids of merging by
    pairs if ids rise as merges go and no two tokens that stay neighbours join to a token, which Encoder.unsafe() looks for
    and the tests prove for both vocabularies. An end of word is byte 0xFF here, which UTF-8 never has.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        back = {c: bytes([b]) for b, c in enumerate(byte_characters())} | {chr(ord(c) + END): bytes([b, 0xFF]) for b, c in enumerate(byte_characters())}
        ranks = {b"".join(back[c] for c in t): i for t, i in self.ids.items() if len(t) == 1 or t in self.parts}
        self.pieces = Made(self._word) if self.words else None
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        size = len(self.names)
        for name in ("automaton", "rank", "parts", "born", "ids", "vocab", "pairs", "shorter", "decoded", "decimal", "names"):
            delattr(self, name)  # workers keep this object, so it keeps only what it needs
        self.size = size
        self.core = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={} if self.words else self.special)

    def _word(self, word: str) -> bytes:
        raw = word.encode() if word.isascii() else bytes(map(self.byte_of.__getitem__, word))
        return array("I", self.core._encode_single_piece(raw + b"\xff")).tobytes()

    def _ordinary(self, text: str) -> bytes:
        return super()._ordinary(text) if self.words else array("I", self.core.encode_ordinary(text)).tobytes()


class Made(dict):
    """Makes a value at each look, for what is made as fast as it is found."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        return self.make(key)


SPACES = re.compile(f"[{re.escape(SPACE)}]+")
CONTROLS = re.compile(r"[\x1c-\x1f]")
CUT = re.compile(r"[A-Za-z][ \n][A-Za-z]")


class Offsets:
    """Strings laid end to end, with the offset of each: decoding is a gather of byte ranges."""

    def __init__(self, strings: list):
        raw = [s if isinstance(s, bytes) else s.encode("utf-8") for s in strings]
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def gather(self, ids: np.ndarray, block: int = 1 << 17) -> bytes:
        out = []
        for i in range(0, len(ids), block):
            size = self.size[ids[i : i + block]]
            end = np.cumsum(size)
            if len(end):
                out.append(self.bytes[np.repeat(self.start[ids[i : i + block]] - (end - size), size) + np.arange(end[-1])].tobytes())
        return b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str, fast: bool = False) -> Encoder:
    """One for each file and Python process. Its caches hold many small tuples that are never garbage, so that the collector
    runs more seldom from here on."""
    gc.set_threshold(500_000, 50, 100)
    return RankEncoder(path) if fast else Encoder(path)


def crc(blocks, end: int | None = None) -> tuple[int, int]:
    """The number of ids in blocks of 32-bit ids and the crc32 of them all, with an end id if given."""
    n = c = 0
    for block in blocks:
        n, c = n + len(block) // 4, zlib.crc32(block, c)
    if end is not None:
        n, c = n + 1, zlib.crc32(np.array([end], dtype="<u4").tobytes(), c)
    return n, c


#: What encode_texts() can return for each row.
OUTPUTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


def encode_texts(df: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each row's text by the vocabulary file at `path`, in place: no shuffle, one row in memory at a time.

    Returns id_col and the chosen `outputs`. A null text is an empty one: no ids, an empty decoded text. Repeated rows and
    null ids are kept as they are; other columns of df are not read.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(o, T._parse_datatype_string(OUTPUTS[o])) for o in outputs])

    def run(batches):
        import pyarrow as pa

        e, arrow = encoder(path), to_arrow_schema(schema)
        for batch in batches:
            out: list[list] = [[] for _ in outputs]
            texts, ids_in, done, held = batch.column(1), batch.column(0), 0, 0
            for row, value in enumerate(texts):
                text = value.as_py()
                found = e.digests(text) if {"ids_sha256", "decoded_sha256"} & {*outputs} else None
                ids = e.encode(text) if not found or {"ids", "decoded"} & {*outputs} else ()
                made = {"n_tokens": found[0] if found else len(ids), "ids_sha256": found and found[1], "decoded_sha256": found and found[2]}
                for o, column in zip(outputs, out):
                    column.append(e.decode(ids) if o == "decoded" else ids.astype("int32") if o == "ids" else made[o])
                held += len(ids)
                if held > 1 << 22 or row == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([ids_in.slice(done, row + 1 - done)] + [pa.array(c, type=arrow.field(i + 1).type) for i, c in enumerate(out)], schema=arrow)
                    out, done, held = [[] for _ in outputs], row + 1, 0

    return df.select(id_col, text_col).mapInArrow(run, schema)
