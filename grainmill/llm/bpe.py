"""BPE by deterministic automata: one over tokens, compiled by merge gadgets, and one over bytes.

Compilation starts from the one-state automaton that accepts every string of base
symbols and applies one gadget per merge (a, b), in order of rank: wherever an
a-arc leads to a state with a b-arc, an arc labelled ab is added that goes where that
b-arc went, and the a-arcs are redirected to a copy of their target without the
b-arc. The result accepts exactly the correct tokenisations: each word has one accepted
path that spells it, and so has each of its beginnings.

As all arcs of a label lead to one state, each gadget makes one state, a copy that differs
from its original in one arc. `Automaton` holds the states as these differences.

Spelt out in bytes, the arcs of that automaton are paths through a trie of the labels, and the subset
construction makes them deterministic: a state of `Machine` is the set of places that the paths
from the states behind the last bytes have come to. Each byte leads to one next state and to
the one label that ends there, found in one table; entries are made when they are first met, and
the table is bounded in bytes and made anew beyond that. So a word is read once, byte by
byte, without stepping back, and its labels are read off from its end. Decoding emits the
labels of arcs.

Normalisation and the cutting into words aren't part of this: ASCII is done here, all else by the rules
of the tokenizer file as the tokenizers library applies them, whose Unicode tables differ from Python's.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame

from grainmill.llm.worker import text_slices, tidy

#: White space of the normaliser: Unicode's property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
PIECE_CHARS = 1 << 20


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Automaton:
    """The automaton over tokens.

    State 0 is the first one, with all base symbols. Copies of a label's target form a line, of which each
    differs from the one before it in one arc less; a line begins with a copy of some earlier state. The arc ab is in
    every state there is when its merge is done that has the a-arc, and in later copies of those.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        size = max(vocab.values()) + 1
        self.rank, self.left = [-1] * size, [-1] * size
        #: By state: its line and its place in it. `target` is the state that a label's arcs lead to.
        self.line, self.place, self.target = [0], [0], [0] * size
        #: By line: the merges that made its states, the place at which it lost an arc, and the state that it began as.
        self.made: list[list[int]] = [[-1]]
        self.lost: list[dict[int, int]] = [{}]
        self.began: list[int] = [-1]
        own: dict[int, int] = {}
        for k, (x, y) in enumerate(merges):
            self._gadget(k, vocab[x], vocab[y], vocab[x + y], own)
        self._spell(vocab, merges, suffix)

    def _gadget(self, k: int, a: int, b: int, ab: int, own: dict[int, int]) -> None:
        if self.rank[ab] >= 0:
            raise ValueError("two merges make the same token; its label would have two targets")
        self.rank[ab], self.left[ab], self.target[ab] = k, a, self.target[b]
        line = own.get(a)
        if line is None:
            line = own[a] = len(self.made)
            self.made.append([])
            self.lost.append({})
            self.began.append(self.target[a])
        self.lost[line][b] = len(self.made[line])
        self.target[a] = len(self.line)
        self.line.append(line)
        self.place.append(len(self.made[line]))
        self.made[line].append(k)

    def _spell(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        """The bytes of each label, and whether it ends a word."""
        byte = byte_symbols()
        made = {vocab[x + y] for x, y in merges}
        self.labels = list(vocab.values())
        self.ends = [False] * len(self.rank)
        self.spelt: list[bytes] = [b""] * len(self.rank)
        for text, i in vocab.items():
            if i not in made:
                bare = text.removesuffix(suffix) if len(text) > 1 else text
                self.ends[i], self.spelt[i] = bare != text, bytes(byte[c] for c in bare)
        for x, y in merges:
            i = vocab[x + y]
            self.ends[i], self.spelt[i] = self.ends[vocab[y]], self.spelt[vocab[x]] + self.spelt[vocab[y]]

    def arc(self, state: int, label: int) -> bool:
        """Has the state an arc with this label? It leads to target[label]."""
        line, place = self.line[state], self.place[state]
        while True:
            if self.lost[line].get(label, place + 1) <= place:
                return False
            if self.rank[label] >= 0:
                there = bisect_right(self.made[line], self.rank[label], hi=place + 1) - 1
                if there >= 0:  # the state that the line was when the merge made the arc beside its left part's
                    place, label = there, self.left[label]
                    continue
            elif line == 0:
                return True
            line, place = self.line[self.began[line]], self.place[self.began[line]]


class Machine:
    """The deterministic automaton over bytes; its transitions are made as they are met and kept in `table`."""

    def __init__(self, automaton: Automaton, budget: int = 128 << 20):
        self.automaton, self.budget = automaton, budget
        self._child: dict[int, int] = {}
        #: By node of the trie: the label spelt there, within and at the end of a word.
        self._label: tuple[list[int], list[int]] = ([-1], [-1])
        self._leaf = [True]
        for i in automaton.labels:
            node = 0
            for x in automaton.spelt[i]:
                below = self._child.get(node << 8 | x)
                if below is None:
                    below = self._child[node << 8 | x] = len(self._leaf)
                    self._leaf[node] = False
                    self._leaf.append(True)
                    for kind in self._label:
                        kind.append(-1)
                node = below
            self._label[automaton.ends[i]][node] = i
        self._forget()

    def _forget(self) -> None:
        self.table: dict[int, int] = {}
        self.states: list[tuple] = []
        self._number: dict[tuple, int] = {}
        self.bytes = 0
        self._state(((0, 0),))

    def _state(self, paths: tuple) -> int:
        found = self._number.get(paths)
        if found is None:
            found = self._number[paths] = len(self.states)
            self.states.append(paths)
            self.bytes += 300 + 130 * len(paths)
        return found

    def _step(self, key: int) -> int:
        """The next state and, above it, 1 + the label that ends there; key: state, is it the last byte, byte."""
        state, last, byte = key >> 9, key >> 8 & 1, key & 255
        paths, found = [], -1
        for origin, node in self.states[state]:
            node = self._child.get(node << 8 | byte, -1)
            if node < 0:
                continue
            label = self._label[last][node]
            if label >= 0 and self.automaton.arc(origin, label):
                if found >= 0:
                    raise ValueError("two paths spell the same bytes")
                found = label
            if not self._leaf[node]:
                paths.append((origin, node))
        if found < 0:
            raise ValueError("no path spells this word")
        paths.append((self.automaton.target[found], 0))
        if self.bytes > self.budget:
            self._forget()
            return found + 1 << 32 | self._state(tuple(paths))
        self.bytes += 180
        made = self.table[key] = found + 1 << 32 | (0 if last else self._state(tuple(paths)))
        return made

    def encode(self, word: bytes) -> list[int]:
        """The labels of the accepted path that spells a word."""
        state, ends, n = 0, [], len(word) - 1
        for i, x in enumerate(word):
            key = state << 9 | (i == n) << 8 | x
            there = self.table.get(key) or self._step(key)
            state = there & 0xFFFFFFFF
            ends.append((there >> 32) - 1)
        out, at = [], len(word)
        while at:
            out.append(ends[at - 1])
            at -= len(self.automaton.spelt[out[-1]])
        out.reverse()
        return out


class _Recent:
    """A table bounded in bytes: two generations, the older of which is dropped; what is too large isn't kept."""

    def __init__(self, make, size: int):
        self.make, self.size, self.used, self.new, self.old = make, size, 0, {}, {}

    def miss(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        need = 200 + 4 * len(key) + len(found)
        if need > self.size >> 4:
            return found
        self.used += need
        if self.used > self.size:
            self.old, self.new, self.used = self.new, {}, need
        self.new[key] = found
        return found


class Tokenizer:
    """Encoder and decoder of a tokenizer file with lower-casing, word ends and byte symbols.

    special=True takes the special tokens' strings in a text as those tokens, False
    as ordinary text.
    """

    def __init__(self, spec: bytes, special: bool = True):
        d = json.loads(spec)
        model = d["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.machine = Machine(Automaton(model["vocab"], merges, model["end_of_word_suffix"]))
        self.specials = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*model["vocab"].values(), *self.specials.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for text, i in [*model["vocab"].items(), *self.specials.items()]:
            self.labels[i] = text.encode()
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        #: Within ASCII the classes of letters, digits and white space don't depend on a Unicode version.
        self._words = re.compile(split.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", "\t-\r "))
        self._normalise = tokenizers.Tokenizer.from_str(spec.decode()).normalizer.normalize_str
        self._split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(split), "removed", invert=True).pre_tokenize_str
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if special and self.specials else None
        self._word, self._chunk = _Recent(self._encode_word, 32 << 20), _Recent(self._encode_chunk, 64 << 20)

    def _encode_word(self, word: str) -> bytes:
        ids = self.machine.encode(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_plain(self, text: str) -> bytes:
        words = self._words.findall(text.lower()) if text.isascii() else [w for w, _ in self._split(self._normalise(text))]
        known, miss = self._word.new, self._word.miss
        return b"".join([known.get(w) or miss(w) for w in words])

    def _encode_chunk(self, chunk: str) -> bytes:
        if self._special is None or "<" not in chunk:
            return self._encode_plain(chunk)
        parts = self._special.split(chunk)
        return b"".join(struct.pack("<I", self.specials[p]) if k % 2 else self._encode_plain(p) for k, p in enumerate(parts))

    def encode_pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, piece by piece."""
        for piece in _pieces(text):
            chunks = piece.split() if not _CONTROL.search(piece) else _CHUNK.findall(piece)
            miss, out = self._chunk.miss, []
            for c in chunks:
                found = self._chunk.new.get(c)
                out.append(found if found is not None else miss(c))
            yield b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.encode_pieces(text or "")), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        return b" ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(struct.pack(f"<{len(ids)}I", *ids)).decode()


#: Control characters that str.split() takes for white space and the normaliser doesn't.
_CONTROL = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile(f"[^{WHITE}]+")
_GAP = re.compile(f"[{WHITE}]")


def _pieces(text: str) -> Iterator[str]:
    """Cuts at white space, about PIECE_CHARS each."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE_CHARS) if at + PIECE_CHARS < len(text) else None
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


_loaded: dict[tuple[bytes, bool], Tokenizer] = {}


def tokenizer_of(spec: bytes, special: bool = True) -> Tokenizer:
    """The compiled tokenizer, kept by the worker process."""
    key = (hashlib.sha256(spec).digest(), special)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(spec, special)
    return _loaded[key]


def digest_text(tok: Tokenizer, text: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids, and SHA-256 of the text decoded from them."""
    n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
    for ids in tok.encode_pieces(text):
        if ids:
            if n:
                text_sha.update(b" ")
            n += len(ids) // 4
            ids_sha.update(ids)
            text_sha.update(tok.decode_bytes(ids))
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null counts as empty: no tokens, and the digests of nothing. Rows that repeat each give
    a row; a null doc_id stays null; other columns are left aside.
    """
    with open(tokenizer_path, "rb") as f:
        spec = f.read()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(spec)
        for part in (x for batch in batches for x in text_slices(batch, "text")):
            n, ids, text = zip(*[digest_text(tok, t or "") for t in part.column(1).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer_path: str, special: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null counts as empty."""
    with open(tokenizer_path, "rb") as f:
        spec = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(spec, special)
        for batch in batches:
            ids = pa.array([np.frombuffer(b"".join(tok.encode_pieces(t or "")), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text, from doc_id and ids: the arcs' labels with a space between."""
    with open(tokenizer_path, "rb") as f:
        spec = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(spec)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tok.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
