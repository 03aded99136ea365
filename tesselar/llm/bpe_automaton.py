"""BPE as a deterministic automaton over tokens, built by one merge gadget per merge.

The automaton accepts exactly the token sequences that BPE produces.  It starts with one state, where every byte
loops.  A merge (u, v) -> w changes it by a gadget: the target of u gives up its arc v, every state that has an
arc u (if that target had the arc v) gets an arc w, and w leads to where v led from there.  The target of an arc
depends on its token alone, so a state is named by the last token read.  The 50,000 gadgets are kept in the order
of their merges as tables (arc removed, arcs copied from, target copied from); a transition is looked up by going
back through the gadgets that made its arc, and is then kept in a transition table, since the full table has
billions of entries and words use few of them.

A word is encoded by running the automaton over its bytes: from the state of the last token, the longest
vocabulary entry whose arc exists is taken, and shorter ones on a dead end; just one path spans the word.
Decoding emits the label of each arc, its bytes.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.memo import Memo

# Fixed value: how byte-level BPE splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START = -1


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def recent_letters() -> frozenset[str]:
    """The letters and numbers that the pattern matcher knows but Python's older Unicode tables don't: other libraries
    may not know them either."""
    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    return frozenset(regex.findall(r"[\p{L}\p{N}]", unknown))


class Automaton:
    """Compiled from the vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = self.letters = byte_letters()
        ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}  # when the gadget of a token was applied; -1 for bytes
        self.removed: dict[tuple[int, int], int] = {}  # when the arc (state, token) was removed
        self.table: dict[tuple[int, int], bool] = {}
        self.ids = {bytes([b]): ids[bytes([b])] for b in range(256) if bytes([b]) in ids}
        self.made |= {i: -1 for i in self.ids.values()}
        for when, merge in enumerate(spec["model"]["merges"]):
            u, v = (bytes(letters[c] for c in t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            if u in self.ids and v in self.ids and (w := ids.get(u + v)) is not None:
                self.gadget(when, self.ids[u], self.ids[v], w, u + v)
        self.reach: dict[bytes, int] = {}  # by its first four bytes, how long a token can be
        for token in self.ids:
            self.reach[token[:4]] = max(len(token), self.reach.get(token[:4], 3))
        self.word = regex.compile(WORDS)
        self.recent = recent_letters()
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo = Memo(lambda words: [self.known(w) for w in words])

    def gadget(self, when: int, u: int, v: int, w: int, text: bytes) -> None:
        if self.arc(u, v, when):  # else no path reads u v, and w gets no arc
            self.left[w], self.right[w], self.made[w] = u, v, when
            self.ids[text] = w
        self.removed.setdefault((u, v), when)

    def arc(self, state: int, token: int, when: int) -> bool:
        """Whether the automaton has the arc before gadget `when`."""
        made, removed = self.made, self.removed
        while removed.get((state, token), when) >= when:
            s, t = made[state], made[token]
            if s < 0 and t < 0:
                return True
            if s > t:  # the state was copied from the target of its second part
                when, state = s, self.right[state]
            elif t > s:  # the arc was added where its first part had one; of a run u u u the first two merge
                if self.left[token] == self.right[token] == state:
                    return False
                when, token = t, self.left[token]
            else:
                when, state, token = s, self.right[state], self.left[token]
        return False

    def step(self, state: int, token: int) -> bool:
        if state == START:
            return True
        key = (state, token)
        if (known := self.table.get(key)) is None:
            if len(self.table) >= 2_000_000:
                self.table.clear()
            known = self.table[key] = self.arc(state, token, 1 << 60)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The arcs of the one accepting path whose labels spell the word."""
        ids, reach, table, n = self.ids, self.reach, self.table, len(word)
        if (whole := ids.get(word)) is not None:
            return [whole]
        path: list[int] = []
        starts: list[int] = []  # where each token of the path starts
        dead: set[tuple[int, int]] = set()  # (end, token) that no path goes on from
        at, state, size = 0, START, min(n, reach.get(word[:4], 3))
        while at < n:
            while size:
                token = ids.get(word[at : at + size])
                if token is not None:
                    go = table.get((state, token))
                    if go is None:
                        go = self.step(state, token)
                    if go and not (dead and (at + size, token) in dead):
                        break
                size -= 1
            if size:
                path.append(token)
                starts.append(at)
                at, state = at + size, token
                size = min(n - at, reach.get(word[at : at + 4], 3))
            elif path:  # a dead end: the token before was too long
                dead.add((at, path.pop()))
                start = starts.pop()
                at, state, size = start, path[-1] if path else START, at - start - 1
            else:
                raise ValueError("the vocabulary can't spell this word")
        return path

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text by pre-tokenization, special tokens being words of their own."""
        if self.specials and self.specials.search(text):
            for part in self.specials.split(text):
                yield [part] if part in self.special else self.split(part)
        else:
            yield self.split(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokenization of a text without special tokens; one with letters of a recent Unicode version is split by
        the tokenizers library, whose idea of letters counts."""
        if text.isascii() or self.recent.isdisjoint(text):
            return self.word.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel

        words = ByteLevel(add_prefix_space=False).pre_tokenize_str(text)
        return [bytes(self.letters[c] for c in word).decode("utf-8") for word, _ in words]

    def encode_text(self, text: str) -> list[int]:
        return [i for part in self.words(text) for ids in self.memo(part) for i in ids[0]]

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after another."""
        return b"".join([self.label[i] for i in ids])

    def known(self, word: str) -> tuple[list[int], str, bytes]:
        """A word's ids, the same as text, and what they decode to."""
        ids = [self.special[word]] if word in self.special else self.encode_word(word.encode("utf-8", "replace"))
        return ids, ",".join(map(str, ids)), self.decode(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
        found = [w for part in self.words(text) for w in self.memo(part)]
        ids = ",".join([w[1] for w in found])
        raw = b"".join([w[2] for w in found]).decode("utf-8", "replace").encode()
        n = ids.count(",") + 1 if ids else 0
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One automaton per Python worker and vocabulary file."""
    return _automata.get(path) or _automata.setdefault(path, Automaton(path))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the ids (array<int>) of every text; a null or empty text has none, repeated rows are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for b in batches:
            ids = [a.encode_text(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the text of every array of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for b in batches:
            texts = [a.decode(ids or []).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` long, text string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of every row's text, encoded and decoded in one pass.

    A null text counts as empty (no ids); null ids pass through; repeated rows are alike; an empty table gives no
    rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for b in batches:
            rows = [a.digest(t or "") for t in b.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
