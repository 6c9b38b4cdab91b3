"""BPE encoding and decoding with a contiguous rank array per word.

The vocabulary is a public word-level BPE in the format of the ``tokenizers`` library: text is put
into NFC, lower-cased, cut into words by a fixed pattern, each word is spelled in byte symbols with a
word-end mark, and neighbouring symbols are merged by rank. Words are independent, so a bounded table
of the words that were met is kept by each Python worker of an executor, for all of its tasks.

The library's parts know different versions of Unicode; the fixed values below say where they differ
from Python's modules.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: white space by the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: marks that the library's NFC takes for characters of combining class 0, which it doesn't compose or reorder.
APART_MARKS = (
    r"\u07FD\u0898-\u089F\u08CA-\u08D3\u09FE\u0C3C\u0D3B-\u0D3C\u0EBA\u1715\u1ABF-\u1ACE\u1DF6-\u1DFA\uA82C"
    r"\U00010D24-\U00010D27\U00010EAB-\U00010EAC\U00010EFD-\U00010EFF\U00010F46-\U00010F50\U00010F82-\U00010F85"
    r"\U00011070\U0001133B\U0001145E\U00011839-\U0001183A\U00011930\U0001193D-\U0001193E\U00011943\U000119E0"
    r"\U00011A34\U00011A47\U00011A99\U00011D42\U00011D44-\U00011D45\U00011D97\U00011F41-\U00011F42"
    r"\U00016FF0-\U00016FF1\U0001E08F\U0001E130-\U0001E136\U0001E2AE\U0001E2EC-\U0001E2EF\U0001E4EC-\U0001E4EF"
)
#: Letters and numbers that Unicode 16 added; the library's pattern knows these and no later ones.
ADDED_LETTERS = (
    r"\u1C89-\u1C8A\uA7CB-\uA7CD\uA7DA-\uA7DC\U000105C0-\U000105F3\U00010D4A-\U00010D65\U00010D6F-\U00010D85"
    r"\U00010EC2-\U00010EC4\U00011380-\U00011389\U0001138B\U0001138E\U00011390-\U000113B5\U000113B7\U000113D1\U000113D3"
    r"\U00011BC0-\U00011BE0\U00013460-\U000143FA\U00016100-\U0001611D\U00016D40-\U00016D6C\U00018CFF"
    r"\U0001E5D0-\U0001E5ED\U0001E5F0"
)
ADDED_NUMBERS = (
    r"\U00010D40-\U00010D49\U000116D0-\U000116E3\U00011BF0-\U00011BF9\U00016130-\U00016139\U00016D70-\U00016D79"
    r"\U0001CCF0-\U0001CCF9\U0001E5F1-\U0001E5FA"
)
#: Fixed values: (first, last, lower case of the first) of capitals that the library knows and Unicode 15.1 doesn't.
ADDED_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
CAPITALS = {c: lower + c - first for first, last, lower in ADDED_CAPITALS for c in range(first, last + 1)}
APART_MARK = re.compile(f"([{APART_MARKS}])")
#: What few texts hold: only those are put into NFC and lower case by the long way. All of it, and all
#: that Unicode has added of late, lies FAR from the common scripts, which is quicker to tell.
RARE = re.compile(f"[{APART_MARKS}{''.join(map(chr, CAPITALS))}]")
FAR = re.compile("[\u0530-\U0010ffff]")
PATTERN = "(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^" + SPACE + "{letter}{number}]+"
PIECES = regex.compile(PATTERN.format(letter=r"[\p{L}]", number=r"[\p{N}]"))


@cache
def unknown() -> tuple[frozenset[str], regex.Pattern]:
    """(letters and numbers that ``regex`` knows and the library doesn't, the word pattern without them).

    These are among the characters that Python's tables don't assign.
    """
    blank = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))) if unicodedata.category(c) == "Cn")
    later = frozenset(regex.findall(r"[\p{L}\p{N}]", blank)).difference(re.findall(f"[{ADDED_LETTERS}{ADDED_NUMBERS}]", blank))
    without = f"--[{''.join(sorted(later))}]" if later else ""
    return later, regex.compile(PATTERN.format(letter=rf"[\p{{L}}{without}]", number=rf"[\p{{N}}{without}]"))


def words_of(chunk: str) -> list[str]:
    """The words of a run of text, letters and numbers being what the library takes for them."""
    if not FAR.search(chunk):
        return PIECES.findall(chunk)
    later, exact = unknown()
    return (PIECES if later.isdisjoint(chunk) else exact).findall(chunk)


def lowered(text: str) -> str:
    """The text in NFC and lower case as the library has them."""
    if text.isascii():
        return text.lower()
    if not FAR.search(text) or not RARE.search(text):
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    composed = "".join([unicodedata.normalize("NFC", part) for part in APART_MARK.split(text)])
    return composed.replace("Σ", "σ").lower().translate(CAPITALS)


APART = regex.compile(rf"[{SPACE}]+")
#: Fixed value: what ``str.split`` takes for white space and the pattern doesn't.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Words of more symbols are merged with a heap: scanning again and again would take quadratic time.
SHORT = 96
#: Words that a process remembers before it starts anew.
MEMORY = 300_000
NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class WordBpe:
    """Encoder and decoder for one vocabulary, given as the bytes of its JSON file.

    Tokens are handled by id. A pair of neighbours is one integer, ``left << 32 | right``; ``ranks``
    gives its rank and ``merged`` the id that the merge of a rank makes.
    """

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model = spec["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.inner = [ids[c] for c in byte_symbols()]
        self.final = [ids[c + end] for c in byte_symbols()]
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(names) + ")") if names else None
        self.words: dict[str, tuple[str, str]] = {}
        self.chunks: dict[str, tuple[str, str]] = {}

    def merge_short(self, parts: list[int]) -> list[int]:
        """Contiguous arrays of parts and of the ranks between neighbours; the first minimum goes."""
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            part = parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | part, NONE)
            if i < len(ranks):
                ranks[i] = get(part << 32 | parts[i + 1], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges from a heap of (rank, place): for words too long to scan repeatedly."""
        get, n = self.ranks.get, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            right[j] = -1
            for x in (left[i], i):
                if x >= 0 and right[x] >= 0 and (r := get(parts[x] << 32 | parts[right[x]])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[right[x]]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        spelled = word.encode()
        parts = [self.inner[b] for b in spelled]
        parts[-1] = self.final[spelled[-1]]
        return self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts)

    def _word(self, word: str) -> tuple[str, str]:
        ids = self.word(word)
        out = " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])
        if len(word) <= SHORT:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[word] = out
        return out

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """A run of text without white space, which no word crosses."""
        get = self.words.get
        both = [get(w) or self._word(w) for w in words_of(chunk)]
        out = both[0] if len(both) == 1 else (" ".join([x for x, _ in both]), " ".join([y for _, y in both]))
        if len(chunk) <= SHORT:
            if len(self.chunks) >= MEMORY:
                self.chunks.clear()
            self.chunks[chunk] = out
        return out

    def encode_text(self, text: str) -> tuple[int, str, str]:
        """(tokens, ids joined by one space, the decoded text)."""
        ids: list[str] = []
        out: list[str] = []
        get = self.chunks.get
        for section in self.cut.split(text) if self.cut else [text]:
            if section in self.special:
                ids.append(str(self.special[section]))
                out.append(section)
                continue
            lower = lowered(section)
            chunks = APART.split(lower) if SEPARATORS.search(lower) else lower.split()
            both = [get(c) or self._chunk(c) for c in chunks if c]
            if both:
                ids.append(" ".join([x for x, _ in both]))
                out.append(" ".join([y for _, y in both]))
        joined = " ".join(ids)
        return (joined.count(" ") + 1 if joined else 0), joined, " ".join(out)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder of its own, so tokens are joined by one space."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(blob: bytes) -> WordBpe:
    """The worker's encoder for a vocabulary, with the words that it has met in earlier tasks."""
    return WordBpe(blob)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (decimal ids joined by one space) and decoded of every whole text.

    ``vocabulary`` is the path of a tokenizer's JSON file (a fixed file of under 2 MB), read once and
    broadcast. A null text counts as an empty one: no tokens, both strings empty. Special tokens'
    strings in a text become their ids, as the library has it. Texts are read whole however long they
    are; one has to fit into a task. Rows are kept one for one, repeated ones and null doc_ids too;
    other columns are not read.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [bpe.encode_text(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([i for _, i, _ in found], pa.string()),
                        pa.array([d for _, _, d in found], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "token_ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids string, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
