"""BPE encoding and decoding of a ``tokenizers`` JSON vocabulary with word ends.

Encoding a word takes every vocabulary match from one Aho-Corasick pass, keeps the longest from
each position, and walks left to right: a token may follow another only if the pair is compatible,
that is, if merging their joined text by rank gives the two back. Where it isn't, the next shorter
token is tried, and where none is left, the last token is taken back. Ends that failed are not
visited again, so a word takes linear time. The result is exactly that of merging by rank.
Compatibility is computed once for each pair and kept in a table. Decoding gathers token bytes
from one blob by an offset table.

Words repeat, so each worker keeps the ids of the last distinct short words in a bounded table.

Edge cases: null and empty texts have no tokens; strings of special tokens in a text become their
ids, as the library does by default; texts of any length are encoded whole; null ids and repeated
rows are rows like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import ship, table

#: Words kept by each worker, and the longest of them.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 400_000, 48, 500_000
END = "</w>"
#: Unicode's White_Space, all that the vocabulary's ``\\s`` matches.
SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_OPEN = float("inf")
# Code points (or first-last) that newer Unicode tables call letters or numbers and the vocabulary's library, of Unicode 16, doesn't.
UNKNOWN = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA
18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F""".split()
# Lower case of code points (or first-last) that Python's tables don't know yet.
LOWER = dict(x.split(":") for x in "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB".split())


def _span(x: str) -> range:
    first, _, last = x.partition("-")
    return range(int(first, 16), int(last or first, 16) + 1)


_UNKNOWN = "[" + "".join(f"\\U{_span(x)[0]:08X}-\\U{_span(x)[-1]:08X}" for x in UNKNOWN) + "]"
_LOWER = {c: chr(int(to, 16) + c - _span(x)[0]) for x, to in LOWER.items() for c in _span(x)}
_has_unknown = regex.compile(_UNKNOWN).search
_has_lower = regex.compile("[" + "".join(map(chr, _LOWER)) + "]").search


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [chr(other.get(b, b)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, source: str) -> None:
        """``source`` is the file's JSON."""
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self._special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(words).findall
        for kind in (r"\p{L}", r"\p{N}"):
            words = words.replace(kind, f"[{kind}--{_UNKNOWN}]")
        self._words_with_unknown = regex.compile(words, regex.V1).findall

        # A word is a string with one character for each byte, the last of them moved up by 256.
        byte_of = {c: b for b, c in enumerate(byte_symbols())}

        def text_of(token: str) -> str:
            ends = token.endswith(END) and len(token) > len(END)
            raw = [byte_of[c] for c in (token.removesuffix(END) if ends else token)]
            return "".join(map(chr, [*raw[:-1], raw[-1] + 256 * ends]))

        self._text = {i: text_of(t) for t, i in vocab.items()}
        self._id = {t: i for i, t in self._text.items()}
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._made: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key, whole = (vocab[a], vocab[b]), vocab[a + b]
            self._rank.setdefault(key, rank)
            if whole not in self._made:
                self._parts[whole], self._made[whole] = key, rank
        self._finder = ahocorasick.Automaton()
        for t, i in self._id.items():
            self._finder.add_word(t, (len(t) - 1, i))
        self._finder.make_automaton()
        self._size = {i: len(t) for t, i in self._id.items()}
        self._shorter = {i: next((self._id[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self._id), -1) for t, i in self._id.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, bytes] = {}
        self._word_ids: dict[str, tuple[int, ...]] = {}

        # The offset table: each token's characters and a space, as joined by a vocabulary without a decoder.
        size = max([*vocab.values(), *special.values()]) + 1
        pieces = [b""] * size
        for t, i in [*vocab.items(), *special.items()]:
            pieces[i] = t.encode() + b" "
        self._blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self._length = np.array([len(p) for p in pieces], dtype=np.int64)
        self._start = np.cumsum(self._length) - self._length

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge joins the two across their border.

        Undoes both tokens' merges along the border, latest first. Two symbols that meet there would
        merge if that merge ranks before the merge that used either; among equal ranks the leftmost
        goes first, which is the left symbol's own merge but not the right one's.
        """
        left_used = right_used = _OPEN
        while True:
            rank = self._rank.get((left, right), _OPEN)
            if rank < left_used and rank <= right_used and rank != _OPEN:
                return False
            a, b = self._made.get(left, -1), self._made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, left_used = self._parts[left][1], a
            else:
                right, right_used = self._parts[right][0], b

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, given as text."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        s = raw[:-1] + chr(ord(raw[-1]) + 256)
        # Matches come by their ends, so the longest from each start comes last and stays.
        longest = {end - n: token for end, (n, token) in self._finder.iter(s)}
        size, fits, shorter, last = self._size, self._fits, self._shorter, len(s)
        closed: set[int] = set()  # ends that no encoding goes through
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            end = at + size[token]
            good = end not in closed
            if good and before >= 0:
                good = fits.get((before, token))
                if good is None:
                    if len(fits) >= CACHE_PAIRS:
                        fits.clear()
                    good = fits[before, token] = self._compatible(before, token)
            if good:
                out.append(token)
                if end == last:
                    return tuple(out)
                at, before, token = end, token, longest[end]
            else:
                token = shorter[token]
                while token < 0:
                    closed.add(at)
                    token = out.pop()
                    at -= size[token]
                    before = out[-1] if out else -1
                    token = token if at + size[token] not in closed else shorter[token]

    def chunks(self, text: str) -> list[str]:
        """Normalised text between white space; no pre-token reaches over that."""
        text = unicodedata.normalize("NFC", text)
        for c in SPACES:
            if c in text:
                text = text.replace(c, " ")
        if "Σ" in text:  # letter by letter, without the rule for a final sigma
            text = text.replace("Σ", "σ")
        text = text.lower()
        if not text.isascii() and _has_lower(text):
            text = text.translate(_LOWER)
        return text.split(" ")

    def _packed(self, chunk: str) -> bytes:
        ids: list[int] = []
        keep = len(chunk) <= CACHE_CHARS
        find = self._words if chunk.isascii() or not _has_unknown(chunk) else self._words_with_unknown
        for word in find(chunk):
            got = self._word_ids.get(word)
            if got is None:
                got = self.encode_word(word)
                if keep:
                    if len(self._word_ids) >= CACHE_WORDS:
                        self._word_ids.clear()
                    self._word_ids[word] = got
            ids += got
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if keep:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            self._cache[chunk] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out, get = [], self._cache.get
        for part in self._special.split(text or "") if self._special else [text or ""]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += [get(x) or self._packed(x) for x in self.chunks(part) if x]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text."""
        i = np.frombuffer(ids, dtype="<u4")
        if not len(i):
            return b""
        n = self._length[i]
        shift = self._start[i] - (np.cumsum(n) - n)
        return self._blob[np.repeat(shift, n) + np.arange(n.sum())].tobytes()[:-1]


@lru_cache(maxsize=2)
def codec_of(source: str) -> Codec:
    return Codec(source)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def codec(path: str) -> Codec:
    return codec_of(read_vocabulary(path))


def _shared(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's JSON (a few MB, whatever the input), read on the driver, so that executors need no copy of the file."""
    ship(spark)
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array of int), decoded_sha256 (of the ids' decoded text) of every row; ``vocabulary`` is a path on the driver."""
    shared = _shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.bpe import codec_of

        c = codec_of(shared.value)
        for b in batches:
            packed = [c.encode(t.as_py()) for t in b.column(1)]
            back = pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in packed], pa.string())
            ids = pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, back], ["doc_id", "ids", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of rows of doc_id, ids."""
    shared = _shared(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.bpe import codec_of

        c = codec_of(shared.value)
        for b in batches:
            texts = [c.decode(np.array(x or [], dtype="<u4").tobytes()).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and decoded in one pass."""
    shared = _shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.bpe import codec_of

        c = codec_of(shared.value)
        for b in batches:
            n, ids, texts = [], [], []
            for t in b.column(1):
                packed = c.encode(t.as_py())
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(c.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digests of every document's tokens and of their decoded text."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary())
