"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens; it accepts exactly the token sequences that the
merge rules produce. It is compiled by one gadget per merge, in rank order. The
gadget for (u, v) -> w: after u, v may no longer follow, so u leads to a copy of
its state without the arc v; and wherever u, then v could be read, an arc w is
added that leads where v led. Since each label leads to the same state from
everywhere, a state is named by the label that was read last.

The compiled table has default arcs: a state's row holds the arcs that it lost,
and the rest is read from the row of the state that it is a copy of; an added
label is read as the label through which it was added. A table without defaults
would have 2.5e9 cells. A second table leads from byte to byte and gives the labels
that end at a place.

A word's encoding is the one path of the automaton whose labels spell it. Each
prefix of a word has one path, so each place of a word has one state: places are
filled from left to right, with no step back, and the path is read from the last
place. Decoding emits the bytes of the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

#: Entries of the word cache; a full one is emptied, and it ends with its task.
CACHE_WORDS = 1 << 18
#: Words of a text that are looked up at once, and characters of short texts.
CHUNK_WORDS = 1 << 17
GROUP_CHARS = 1 << 19
NAMES = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]
KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string()]
#: Ids that are decoded at once.
DECODE_IDS = 1 << 18

# Letters and numbers of later Unicode versions than the vocabulary's
# own library knows, as first and last code point. It takes them for symbols.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_LATER = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in LATER)
_L, _N, _S = rf"[\p{{L}}--[{_LATER}]]", rf"[\p{{N}}--[{_LATER}]]", r"\p{White_Space}"
# The byte-level pre-tokenization pattern of the vocabulary.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?[^{_S}{_L}{_N}]+|{_S}+(?!\P{{White_Space}})|{_S}+"
#: The same over ASCII and Latin letters, for the faster engine.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_SIMPLE = re.compile(rf"[\t-\r\x20-\x7eÀ-ÖØ-öø-ɏ]*")
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_FULL = regex.compile(PATTERN, regex.V1)


def _byte_letters() -> dict[str, int]:
    """The vocabulary writes bytes as letters: printable ones stand for
    themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """The compiled automaton, the special tokens and the arc labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        found = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        n = max(found) + 1
        self.labels = [found.get(i, b"") for i in range(n)]
        self.sizes = array("i", map(len, self.labels))
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # the gadgets: what a label was merged from, at which rank, and the arcs lost
        self.left, self.right, self.born = array("i", [-1]) * n, array("i", [-1]) * n, array("i", [0]) * n
        self.lost: dict[int, int] = {}
        for rank, pair in enumerate(merges, 1):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            u, v, w = vocab[x], vocab[y], vocab[x + y]
            if self.left[w] >= 0 or not self._arc(u, v, rank - 1):
                continue  # no state reads u, then v: an empty gadget
            self.left[w], self.right[w], self.born[w] = u, v, rank
            self.lost[u << 24 | v] = rank
        self.last = len(merges)
        # bytes lead from node to node: the longest end of what was read that begins a label
        self.goto: dict[int, int] = {}
        self.ends, parent = array("i", [-1]), [0]  # the label that a node is, or else the longest that ends it
        for i, label in enumerate(self.labels):
            if i in self.special.values() or not (len(label) == 1 or self.left[i] >= 0):
                continue
            node = 0
            for b in label:
                key = node << 8 | b
                node = self.goto.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    parent.append(key)
            self.ends[node] = i
        self._fall_back(parent)
        self.words: dict[str, bytes] = {}

    def _fall_back(self, parent: list[int]) -> None:
        """Where a node without an arc for a byte leads to, and for each label the
        next shorter one that ends it."""
        depth = array("i", [0]) * len(parent)
        for node in range(1, len(parent)):  # parents come first
            depth[node] = depth[parent[node] >> 8] + 1
        self.fall, self.shorter = array("i", [0]) * len(parent), array("i", [-1]) * len(self.labels)
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            above, byte = parent[node] >> 8, parent[node] & 255
            if above:
                f = self.fall[above]
                while f and f << 8 | byte not in self.goto:
                    f = self.fall[f]
                self.fall[node] = self.goto.get(f << 8 | byte, 0)
            below = self.ends[self.fall[node]]
            if self.ends[node] >= 0:
                self.shorter[self.ends[node]] = below
            else:
                self.ends[node] = below

    def _arc(self, state: int, label: int, at: int) -> bool:
        """Whether label can be read in the state after `state`, as the automaton
        stood after `at` merges: the arc itself, or the default it stands for."""
        born, lost = self.born, self.lost
        while True:
            gone = lost.get(state << 24 | label)
            if gone is not None and gone <= at:
                return False
            age = born[label]
            if age <= born[state]:  # not younger than the state: as in the state it was copied from
                if self.left[state] < 0:
                    return True
                at, state = born[state] - 1, self.right[state]
                if age <= at:
                    continue
            elif self.left[label] < 0:
                return True
            # arcs were added wherever the left part could be read
            label, at = self.left[label], min(at, age)

    def follows(self, state: int, label: int) -> bool:
        return self._arc(state, label, self.last)

    def encode_words(self, words: list[bytes]) -> Iterator[list[int]]:
        """The paths that spell the words. Each byte leads to a node, whose labels
        end at this place; the one whose arc is there names the place's state.
        States depend on what was read only, so in sorted words they are kept for
        what a word has in common with the one before."""
        goto, fall, ends, shorter, sizes, arc, last = self.goto, self.fall, self.ends, self.shorter, self.sizes, self._arc, self.last
        nodes, states, old = [0], [-1], b""
        for word in words:
            at, most = 0, min(len(word), len(old))
            while at < most and word[at] == old[at]:
                at += 1
            del nodes[at + 1 :], states[at + 1 :]
            node, old = nodes[at], word
            for byte in word[at:] if at else word:
                at += 1
                to = goto.get(node << 8 | byte)
                while to is None:
                    node = fall[node]
                    to = goto.get(node << 8 | byte)
                node, label = to, ends[to]
                while (before := at - sizes[label]) and not arc(states[before], label, last):
                    label = shorter[label]
                nodes.append(node)
                states.append(label)
            out = []
            while at:
                out.append(states[at])
                at -= sizes[states[at]]
            yield out[::-1]

    def _words(self, text: str) -> tuple[list[str], Iterator[str]]:
        """Words of a text: the first, and the rest of a long one."""
        pattern = _FAST if _SIMPLE.fullmatch(text) else _FULL
        if len(text) <= GROUP_CHARS:
            return pattern.findall(text), iter(())
        words = (m[0] for m in pattern.finditer(text))
        return list(islice(words, CHUNK_WORDS)), words

    def _learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > CACHE_WORDS:
            self.words.clear()
        new = sorted(w.encode() for w in words - self.words.keys())
        for w, found in zip(new, self.encode_words(new), strict=True):
            self.words[w.decode()] = pack(f"<{len(found)}I", *found)

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Text between special tokens, and the id of the one after it."""
        at = 0
        for m in self._split.finditer(text) if self._split else ():
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:] if at else text, None

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Short texts
        learn their words together; a long one CHUNK_WORDS at a time."""
        whole = [[(*self._words(part), special) for part, special in self._parts(t)] for t in texts]
        self._learn(set().union(*(head for parts in whole for head, _, _ in parts)))
        joined = [[self._joined(head) for head, _, _ in parts] for parts in whole]
        out = []
        for parts, heads in zip(whole, joined, strict=True):
            ids = bytearray()
            for (_, rest, special), head in zip(parts, heads, strict=True):
                ids += head
                while more := list(islice(rest, CHUNK_WORDS)):
                    self._learn(set(more))
                    ids += self._joined(more)
                if special is not None:
                    ids += pack("<I", special)
            out.append(bytes(ids))
        return out

    def _joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        labels, found = self.labels, np.frombuffer(ids, "<u4")
        return b"".join([b"".join([labels[i] for i in found[k : k + DECODE_IDS].tolist()]) for k in range(0, len(found), DECODE_IDS)]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_tokens, ids (binary, little-endian
    unsigned 32-bit), ids_sha256, decoded (string), decoded_sha256.

    Null texts count as empty and have no ids. A special token's string in a text
    becomes its id. Rows stand for themselves, so repeated or null doc_ids do no
    harm, and there are no ties; extra columns are ignored; an empty table gives no
    rows. `path` must be readable on every executor.
    """

    def one(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        tok = load(path)
        ids = tok.encode_all([t for _, t in rows])
        back = [tok.decode(x) for x in ids]
        columns = [[i for i, _ in rows], [len(x) // 4 for x in ids], ids, [hashlib.sha256(x).hexdigest() for x in ids], back, [hashlib.sha256(x.encode()).hexdigest() for x in back]]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, KINDS, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                held: list[tuple[int | None, str]] = []
                size = 0
                for i in range(batch.num_rows):
                    held.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""))
                    size += len(held[-1][1])
                    if size > GROUP_CHARS or i == batch.num_rows - 1:
                        yield one(held)
                        held, size = [], 0
        finally:  # the worker outlives the task
            load(path).words.clear()

    schema = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), schema)
